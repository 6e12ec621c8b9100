import duckdb
import pytest

from docquery.llm.common import WORDS
from docquery.llm.mixing import mix_sources, repeated

SCHEMA = "doc_id long, text string, source string, mix string, size string"


def filled(sizes, weights, cap):
    """Round by round: share what is left by weight, clamp, go on."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        share, total = left, sum(weights[s] for s in open_)
        for s in sorted(open_, key=str):
            give = min(share * weights[s] / total, cap * sizes[s] - target[s])
            target[s] += give
            left -= give
        open_ = {s for s in open_ if target[s] < cap * sizes[s] - 1e-9}
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rows = [(i, " ".join(["w"] * ((i * 7 + seed) % 23)), [None, "a", "b", "é", "Z"][i * i % 5 if i % 3 else 1], "x", "y") for i in range(300)]
    rows += [(5, None, "empty", "x", "y"), (5, None, "empty", "x", "y"), (None, "a b c", "b", "x", "y"), (7, "long " * 20000, "Z", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict(True) for r in mix_sources(df, seed=str(seed)).collect()]
    assert len(got) == len(rows) and set(got[0]) == {"doc_id", "text", "source", "mix", "size"}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORDS.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken, longest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        m, s = r["mix"], r["source"]
        assert m["size"] == len(WORDS.findall(r["text"] or "")) and m["source_size"] == sizes[s]
        assert m["target"] == pytest.approx(want[s], abs=1e-6) and 0 <= m["taken"] <= 3 * m["size"]
        taken[s] += m["taken"]
        longest[s] = max(longest[s], m["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    again = [r.asDict(True) for r in mix_sources(df.repartition(3), seed=str(seed)).collect()]
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id int, text string, source string")
    mixed = mix_sources(df)
    assert sum(r.mix["copies"] for r in mixed.collect()) == repeated(mixed).count()
    assert mix_sources(df.limit(0)).collect() == []
    assert repeated(mixed).columns == df.columns


def test_query_equals_its_sql(spark, tmp_path):
    from docquery.llm.oracles import SOURCE_MIX
    from docquery.llm.queries import op10_source_mix

    rows = [(i, "w " * (i % 9), None if i % 4 == 0 else f"s{i % 7}") for i in range(200)] + [(3, None, "s1"), (3, None, "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op10_source_mix(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(SOURCE_MIX).fetchall())
