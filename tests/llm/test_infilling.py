import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docquery.llm.infilling import fill_in_middle, restored

ROWS = [
    (0, ""), (1, None), (2, "ab, cd\nef é\U0001f600x"), (3, "has <P> in it"), (4, "<S>"), (5, "almost <P and M> <"), (None, "no id"), (7, "same"), (7, "same"),
    (8, "nul\0 char"), (9, "combining é and   lines\r\n"), (10, "long words " * 60_000), (11, "<" * 50), (-12, "negative id text"),
] + [(i, f"Text number {i}, of {i * 7 % 13} parts. <{i}>") for i in range(100, 300)]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_python(spark):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in ROWS], "doc_id long, text string, form string, id string, n string").repartition(3)
    found = fill_in_middle(df)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected(*r) for r in ROWS), key=repr)
    back = found.select("doc_id", restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in ROWS), key=repr)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_settings_and_empty_table(spark):
    df = spark.createDataFrame([(str(i), f"some text {i}") for i in range(100)], "name string, body string")
    found = fill_in_middle(df, id_col="name", text_col="body", rate=100, spm=100)
    assert {r.form for r in found.collect()} == {"spm"} and found.columns[0] == "name"
    assert {r.form for r in fill_in_middle(df, "name", "body", rate=0).collect()} == {"plain"}
    other = fill_in_middle(df, "name", "body", seed="2", rate=100, spm=100)
    assert sorted(r.output for r in other.collect()) != sorted(r.output for r in found.collect())
    assert fill_in_middle(df.limit(0), "name", "body").collect() == []


@pytest.mark.parametrize("odd", [False, True])
def test_query_equals_its_sql(spark, tmp_path, odd):
    from docquery.llm.oracles import INFILLING
    from docquery.llm.queries import op11_infilling

    rows = [r for r in ROWS if r[0] is not None] if odd else [(i, f"text {i} " * (i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_infilling(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(INFILLING)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    for r in got.collect():
        assert r.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r.doc_id}
