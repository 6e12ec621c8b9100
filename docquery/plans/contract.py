"""All queries of the library, with their DuckDB SQL."""

from __future__ import annotations

from docquery.plans import graphs, rankings, tables, texts, vectors  # noqa: F401  they register their queries
from docquery.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
