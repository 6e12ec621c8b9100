"""Exports in files of their own, calls of models, side inputs."""

import base64
import hashlib
import json
import os
import threading

import numpy as np
import pytest

from docquery.operators import calls, chunking, store
from docquery.operators import summaries as sm
from docquery.sources import artifacts, files
from docquery.sources.optional import side_input

CHUNKS = "nomor_uu string, tahun_uu string, tentang string, position long, id string, pasal string, ayat int, bab string, text string, embedding array<float>"


def made(spark, n_docs=5, extra=False):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(n_docs):
        for i in range(1 + 7 * d % 11):
            v = rng.normal(size=4).tolist() if d else [0.0] * 4
            rows.append((str(d), str(2000 + d % 2), f'tent"ang {d}', i, f"{d}-{i}", str(i), i if i % 2 else None, None, f'a "q" \\ é\n\t{i}\x01', v))
    df = spark.createDataFrame(rows, CHUNKS).repartition(4)
    return rows, df.selectExpr("*", "1 AS kind", "2 AS codes", "3 AS top_x") if extra else df


def wanted(rows):
    docs = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0], r[3])):
        docs.setdefault((r[1], r[0]), []).append(r)
    out = {}
    for (year, number), own in docs.items():
        v = np.array([r[9] for r in own], np.float32).astype(float)
        top = np.abs(v).max()
        scale = top / 127 if top else 1.0
        codes = np.clip(np.rint(v / scale), -127, 127).astype(np.int8)
        head = {"nomor_uu": number, "tahun_uu": year, "tentang": own[0][2], "vec_scale": scale, "vec_b64": base64.b64encode(codes.tobytes()).decode()}
        chunks = [dict(zip(("id", "pasal", "ayat", "bab", "text"), r[4:9])) for r in own]
        out[f"uu-{number}-{year}.json"] = json.dumps({**head, "chunks": chunks}, ensure_ascii=False).encode()
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_files_are_whole_and_the_manifest_fits(spark, tmp_path, extra):
    rows, df = made(spark, extra=extra)
    path = str(tmp_path / "out")
    os.makedirs(path)
    (tmp_path / "out" / "uu-99-1990.json").write_text("old")
    artifacts.write_export_files(df, path, "v1", 4, "m")
    want = wanted(rows)
    assert sorted(os.listdir(path)) == sorted([*want, "manifest.json"])
    for name, raw in want.items():
        assert (tmp_path / "out" / name).read_bytes() == raw
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (m["version"], m["dim"], m["model"]) == ("v1", 4, "m")
    assert m["docs"] == [{"key": n[:-5], "file": n, "chunks": len(json.loads(raw)["chunks"]), "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()} for n, raw in want.items()]
    assert files.read_manifest(spark, f"{path}/manifest.json").count() == len(want)
    back = files.read_exports(spark, path).collect()
    assert sorted((r.id, r.text) for r in back) == sorted((r[4], r[8]) for r in rows)
    artifacts.write_export_files(df.where("nomor_uu = '2'"), path, "v2", 4, "m")
    assert sorted(os.listdir(path)) == ["manifest.json", "uu-2-2000.json"]


def test_a_stopped_export_leaves_the_old_one(spark, tmp_path):
    rows, df = made(spark)
    path = str(tmp_path / "out")
    artifacts.write_export_files(df, path, "v1", 4, "m")
    before = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)}
    bad = df.withColumn("embedding", store.F.when(store.F.col("id") != "4-3", store.F.col("embedding")))
    with pytest.raises(Exception, match="has no vector of 4"):
        artifacts.write_export_files(store.checked_export(bad, "embedding", 4), path, "v2", 4, "m")
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)} == before
    artifacts.write_export_files(df.limit(0), path, "v3", 4, "m")
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["docs"] == [] and os.listdir(path) == ["manifest.json"]


def test_null_keys_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, None, 0, "b", None, None, None, None, [1.0, -1.0]), (None, None, None, 0, "b", None, None, None, None, [1.0, -1.0])]
    artifacts.write_export_files(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "o"), "v", 2, "m")
    got = json.loads((tmp_path / "o" / "uu--.json").read_text())
    assert len(got["chunks"]) == 2 and base64.b64decode(got["vec_b64"]) == bytes([127, 129, 127, 129])


def _refusing():
    def refuses(text):
        if "bad" in text:
            raise ValueError("refused " + "x" * 200)
        return f"Penjelasan: {text} {text}"

    return refuses


refuses = _refusing()  # a function of a function is sent whole


def test_a_failing_row_does_not_stop_the_others(spark, tmp_path):
    rows = [(i, f"text number {i}" + (" bad" if i % 5 == 0 else "")) for i in range(40)] + [(None, "null key here"), (7, "text number 7"), (41, None), (42, "")]
    df = spark.createDataFrame(rows, "k long, prompt string").repartition(3)
    got = calls.answers(df.withColumn("answer", calls.F.lit(1)), "k", "prompt", refuses, tries=3).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.k is not None and r.k < 40 and r.k % 5 == 0:
            assert r.answer is None and r.error.startswith("ValueError: refused") and len(r.error) == 120 and r.tries == 3
        elif r.k == 41:
            assert (r.answer, r.error, r.tries) == (None, "no prompt", 0)
        else:
            assert r.error is None and r.tries == 1
    assert calls.answers(df.limit(0), "k", "prompt", refuses).collect() == []
    spent = calls.answers(df.coalesce(1), "k", "prompt", refuses, workers=1, tries=3, budget=4).where("error like 'Value%'").agg({"tries": "sum"}).first()[0]
    assert spent == 8 + 4


def test_calls_are_bounded(spark):
    def counted(text, now=[0, 0], lock=threading.Lock()):  # noqa: B006
        import time

        with lock:
            now[0] += 1
            now[1] = max(now)
        time.sleep(0.002)
        with lock:
            now[0] -= 1
        return str(now[1])

    # The lock lives in the worker process, so it is made there.
    def call(text):
        import builtins

        if not hasattr(builtins, "counted_"):
            import threading as t

            builtins.counted_ = ([0, 0], t.Lock())
        return counted(text, *builtins.counted_)

    counted.__defaults__ = None
    got = calls.answers(spark.range(200).selectExpr("id", "string(id) AS p").coalesce(1), "id", "p", call, workers=3).collect()
    assert 1 < max(int(r.answer) for r in got) <= 3


def test_a_second_run_does_only_the_rest(spark, tmp_path):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(i, f"text number {i}" + (" bad" if i % 4 == 0 else "")) for i in range(20)] + [(90, "x")], "k long, prompt string")
    assert calls.add_answers(df, path, "k", "prompt", refuses, sm.tidy_model_summary, tries=1) == 1
    assert calls.add_answers(df, path, "k", "prompt", lambda t: "Penjelasan :  " + "y" * 700, sm.tidy_model_summary) == 2
    assert spark.read.parquet(path).where("batch = 2").count() == 6
    got = {r.k: r for r in calls.last_answers(spark, path, "k").collect()}
    assert len(got) == 21 and all(r.error is None for r in got.values())
    assert got[4].answer == "y" * 600 and got[4].batch == 2 and got[5].answer == "text number 5 text number 5"
    assert calls.add_answers(df, path, "k", "prompt", refuses) == 3
    assert spark.read.parquet(path).where("batch = 3").count() == 0


@pytest.mark.parametrize("answer, tidy", [("Penjelasan: cukup panjang sekali", "cukup panjang sekali"), ("penjelasan:pendek", None), ("", None), (None, None), ("z" * 900, "z" * 600)])
def test_tidy_model_summary(spark, answer, tidy):
    [r] = spark.createDataFrame([(answer,)], "a string").select(sm.tidy_model_summary(calls.F.col("a")).alias("s")).collect()
    assert r.s == tidy


def test_side_inputs(spark, tmp_path):
    src, kept = tmp_path / "in", str(tmp_path / "kept")
    read = lambda: spark.read.schema("src string, dst string").option("mode", "FAILFAST").json(str(src))
    assert side_input(spark, read, kept)[:2] == (None, "absent")
    src.write_text('{"src": "a", "dst": "b"}\n')
    first = side_input(spark, read, kept)
    assert first.state == "fresh" and [tuple(r) for r in first.rows.collect()] == [("a", "b")]
    src.write_text('{"src": "c", "dst": "d"}\n{"src": "e", \n')
    broken = side_input(spark, read, kept)
    assert broken.state == "kept" and broken.error and [tuple(r) for r in broken.rows.collect()] == [("a", "b")]
    os.remove(src)
    assert side_input(spark, read, kept)[:2] == (None, "absent")
    assert side_input(spark, read, kept, absent_is_none=False).state == "kept"
    src.write_text("{broken")
    assert side_input(spark, read, str(tmp_path / "none")).state == "absent"
    src.write_text('{"src": "c", "dst": "d"}\n')
    assert [tuple(r) for r in side_input(spark, read, kept).rows.collect()] == [("c", "d")]
    with pytest.raises(ZeroDivisionError):
        side_input(spark, lambda: 1 / 0, kept)


def test_graphs(spark, tmp_path):
    g = {"version": "v", "docs": {"uu-1-2000": {"nomor_uu": "1"}}, "nodes": ["a", "b"], "edges": [{"from": "a", "to": "b", "kind": "internal"}]}
    (tmp_path / "graph.json").write_text(json.dumps(g, indent=1))
    edges, nodes = files.read_graph_object(spark, str(tmp_path / "graph.json"))
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "internal")] and sorted(r.node for r in nodes.collect()) == ["a", "b"]
    files.write_graph(edges, nodes, str(tmp_path / "lines"))
    again, names = files.read_graph(spark, str(tmp_path / "lines"))
    assert again.collect() == edges.collect() and sorted(names.collect()) == sorted(nodes.collect())


def test_a_head_changes_only_its_own_fields(spark):
    answer = "---\nSumber: UU 1\nNomor: 99\nStruktur: Bab I Pasal 7\n----\nIsi\n===CHUNK_BOUNDARY===\ntanpa kepala\n===CHUNK_BOUNDARY===\n---\nSumber:\n---\nkosong"
    df = spark.createDataFrame([(1, answer)], "k int, a string")
    own = chunking.F.create_map(*(chunking.F.lit(x) for x in ("nomor_uu", "5", "sumber", "file", "pasal", "0")))
    got = chunking.parse_model_chunks(df, "k", "a", own).orderBy("position").collect()
    assert [r.metadata for r in got] == [
        {"nomor_uu": "5", "sumber": "UU 1", "struktur": "Bab I Pasal 7", "pasal": "7"},
        {"nomor_uu": "5", "sumber": "file", "pasal": "0"},
        {"nomor_uu": "5", "sumber": "", "pasal": "0"},
    ]
    assert [r.body for r in got] == ["Isi", "tanpa kepala", "kosong"]
    assert chunking.parse_model_chunks(df, "k", "a", chunking.F.lit(None).cast("map<string,string>")).where("position = 1").first().metadata == {}
