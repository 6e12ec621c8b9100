"""The versioned table of chunks: deletes, repeats, crashes, compaction."""

import pytest
from pyspark.sql import functions as F

from docquery.streaming import versions as v

SCHEMA = "doc_id long, text string, gone boolean"


def lines(df):
    """A chunk per line; a text of `none` has no chunks."""
    return df.where("text <> 'none'").select("doc", F.posexplode(F.split("text", "\n")).alias("position", "chunk"))


@pytest.fixture
def apply(spark, tmp_path):
    path = str(tmp_path / "table")

    def run(version, *rows):
        return v.apply_changes(spark.createDataFrame([(*r, False)[:3] for r in rows], SCHEMA), path, version, lines, gone="gone")

    run.path = path
    return run


def held(spark, path, at=None):
    return sorted((tuple(r) for r in v.current(spark, path, at).select("doc", "position", "chunk").collect()), key=repr)


def test_shorter_documents_leave_no_stale_tail(spark, apply):
    assert apply(1, (1, "a\nb\nc"), (2, "x\ny"), (None, "n"))
    assert apply(3, (1, "a"), (2, None, True), (4, "late"), (9, "never", True))
    assert held(spark, apply.path) == sorted([(1, 0, "a"), (4, 0, "late"), (None, 0, "n")], key=repr)
    assert apply(5, (1, "none"), (None, "m\nn"))
    assert held(spark, apply.path) == sorted([(4, 0, "late"), (None, 0, "m"), (None, 1, "n")], key=repr)
    assert held(spark, apply.path, 1) == sorted([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y"), (None, 0, "n")], key=repr)
    assert held(spark, apply.path, 4) == held(spark, apply.path, 3) and v.versions(spark, apply.path) == [1, 3, 5]
    apply(7, (1, "back\nagain"), (2, "back"))
    assert {(1, 0, "back"), (1, 1, "again"), (2, 0, "back")} <= set(held(spark, apply.path))


def test_only_what_differs_is_written(spark, apply):
    apply(1, (1, "a"), (2, "b"))
    apply(2, (1, "a"), (2, "c"), (2, "b2"), (3, "d"), (3, "d"))
    written = spark.read.parquet(f"{apply.path}/rows/version=2").collect()
    assert sorted((r.doc, r.chunk) for r in written) == [(2, "c"), (3, "d")]


def test_repeats_change_nothing_and_old_versions_are_refused(spark, apply):
    apply(1, (1, "a"))
    apply(2, (1, "b"))
    before = held(spark, apply.path)
    assert not apply(2, (1, "something else")) and held(spark, apply.path) == before
    with pytest.raises(ValueError):
        v.apply_changes(spark.createDataFrame([(1, "z", False)], SCHEMA), apply.path, 0, lines)
    assert apply(3) and held(spark, apply.path) == before


def test_a_crash_before_the_commit_is_made_good(spark, apply, monkeypatch):
    apply(1, (1, "a\nb"))
    write, calls = v._write, []

    def broken(rows, path, version, base):
        rows.write.mode("overwrite").parquet(f"{path}/rows/version={version}")
        calls.append(version)
        raise OSError("lost")

    monkeypatch.setattr(v, "_write", broken)
    with pytest.raises(OSError):
        apply(2, (1, "half"), (5, "new"))
    assert calls == [2] and held(spark, apply.path) == [(1, 0, "a"), (1, 1, "b")]
    monkeypatch.setattr(v, "_write", write)
    assert apply(2, (1, "whole"), (5, "new"))
    assert held(spark, apply.path) == [(1, 0, "whole"), (5, 0, "new")]


def test_compaction_and_vacuum(spark, apply):
    apply(1, (1, "a\nb"), (2, "x"))
    apply(3, (2, None, True), (3, "y"))
    assert v.compact(spark, apply.path) == 4
    apply(5, (1, "c"))
    assert held(spark, apply.path) == [(1, 0, "c"), (3, 0, "y")] and held(spark, apply.path, 1) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x")]
    v.vacuum(spark, apply.path)
    assert v.versions(spark, apply.path) == [4, 5] and held(spark, apply.path) == [(1, 0, "c"), (3, 0, "y")]
    assert held(spark, apply.path, 4) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "y")]
    with pytest.raises(ValueError):
        v.current(spark, apply.path, 3)


def test_a_whole_set_replaces_the_table(spark, apply):
    apply(1, (1, "a"), (2, "b"), (None, "n"))
    whole = spark.createDataFrame([(2, "b"), (7, "q")], "doc_id long, text string")
    assert v.replace_all(whole, apply.path, 2, lines)
    assert held(spark, apply.path) == [(2, 0, "b"), (7, 0, "q")]
    assert sorted((r.doc, r.gone) for r in spark.read.parquet(f"{apply.path}/rows/version=2").where("doc is not null").collect()) == [(1, True), (7, False)]
    v.replace_all(whole.limit(0), apply.path, 3, lines)
    assert held(spark, apply.path) == []


def test_a_stream_of_changes(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    put = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    go = lambda: v.follow(spark, source, SCHEMA, path, mark, lines, gone="gone").awaitTermination()
    put((1, "a\nb\nc", False), (2, "x", False))
    go()
    put((1, "a", False), (2, None, True))
    go()
    assert held(spark, path) == [(1, 0, "a")] and v.versions(spark, path) == [1, 3]
    go()
    assert v.versions(spark, path) == [1, 3] and len(held(spark, path, 1)) == 4


def test_reserved_columns_and_no_table(spark, tmp_path):
    with pytest.raises(ValueError):
        v.current(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        v.apply_changes(df, str(tmp_path / "t"), 1, lambda d: d.select("doc", F.lit(1).alias("Version")))
