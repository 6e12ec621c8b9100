"""Citations, contexts and the retrieval-only answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"
NOTICE = "\n\n[...]"


def citation(number: Column, year: Column, section: Column, article: Column, paragraph: Column) -> Column:
    """`UU No. n Tahun t, section, Pasal p ayat (a)`; parts that are null are
    left out, others of number, year and article say `?`."""
    say = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(
        F.lit("UU No. "), say(number), F.lit(" Tahun "), say(year), F.coalesce(F.concat(F.lit(", "), section), F.lit("")), F.lit(", Pasal "), say(article),
        F.coalesce(F.concat(F.lit(" ayat ("), paragraph.cast("string"), F.lit(")")), F.lit("")),
    )


def assemble(hits: DataFrame, by: str, order: str, head: Column, text: Column) -> DataFrame:
    """(by, context): `[head]` and text of the hits in order. Hits are few."""
    part = F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce(text, F.lit("")))
    parts = hits.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order), part.alias("part")))).alias("parts"))
    return parts.select(by, F.array_join(F.transform("parts", lambda p: p["part"]), SEPARATOR).alias("context"))


def truncate_context(context: Column, most: int = 2000) -> Column:
    """A context of more than most characters is cut at the last separator that
    starts by then, or there if there is none, and says so."""
    head = F.substring(context, 1, most + len(SEPARATOR))
    at = F.length(head) - F.length(F.substring_index(head, SEPARATOR, -1)) - len(SEPARATOR)
    cut = F.when(F.contains(head, F.lit(SEPARATOR)) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(F.substring(context, 1, most))
    return F.when(F.length(context) > most, F.concat(cut, F.lit(NOTICE))).otherwise(context)


def uncertain(score: Column, lexical: Column, least: float = 0.62) -> Column:
    """The best hit is weak and no term supports it."""
    return (F.coalesce(lexical, F.lit(0.0)) == 0) & (F.coalesce(score, F.lit(0.0)) < least)
