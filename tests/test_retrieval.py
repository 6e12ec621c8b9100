"""Questions, vectors, ranking, graph, summaries, answers, tables."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import answers, graph, questions, ranking, store, vectors
from docquery.operators import stats as st
from docquery.operators import summaries as sm
from docquery.profile import INDONESIAN_LAW
from docquery.sources import files
from docquery.streaming import ingest


def test_questions():
    q = questions.parse_question("Apa sanksi Pasal 33A UU No. 31 Tahun 1999 tentang korupsi?")
    assert (q.article, q.law, q.year, q.old) == ("33a", "31", "1999", False)
    assert q.titles == ("korupsi",) and q.words == ("1999", "korupsi")
    assert "tipikor" in q.groups[1] and "melawan hukum" in q.phrases and q.intents == (0,)
    assert questions.parse_question("kuhp lama").old and len(questions.parse_question("kuhp lama").titles) == 2
    assert questions.parse_question("").groups == ()


def test_stems():
    assert {"setubuh", "bersetubuh"} <= set(questions.stem_variants("bersetubuh"))
    assert "pukul" in questions.stem_variants("memukul") and "kirim" in questions.stem_variants("mengirim")
    assert "tulis" in questions.stem_variants("penulis") and questions.stem_variants("abc") == []
    assert all(len(v) >= 4 for v in questions.stem_variants("perbuatannya"))


def test_dense_top_k_equals_a_full_sort(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist(), "s") for i, x in enumerate(v)] + [(None, None, "s")], "vec_id int, embedding array<float>, score string").repartition(4)
    q = spark.createDataFrame([(k, v[k].tolist()) for k in (3, 9)], "qid int, vector array<float>")
    got = vectors.dense_top_k(q, df, 5).orderBy("qid", "rank").collect()
    for k in (3, 9):
        scores = v.astype(float) @ v[k].astype(float)
        want = sorted(range(300), key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [r.vec_id for r in got if r.qid == k] == want
    with pytest.raises(ValueError):
        vectors.dense_top_k(q, df, 5, max_queries=1)
    assert vectors.dense_top_k(q, df.limit(0), 5).collect() == []


def test_quantisation(spark):
    rng = random.Random(3)
    rows = [("a", [rng.uniform(-1, 1) for _ in range(6)]) for _ in range(20)] + [("z", [0.0] * 6)]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    df = df.join(vectors.group_scales(df, "g", "v"), "g")
    coded = df.withColumn("c", vectors.quantize(F.col("v"), F.col("scale"))).withColumn("b", vectors.to_base64(F.col("c"))).withColumn("back", vectors.from_base64(F.col("b"))).withColumn("u", vectors.dequantize(F.col("c"), F.col("scale")))
    for r in coded.collect():
        assert list(r.c) == list(r.back)
        assert all(abs(c * r.scale - x) <= r.scale / 2 + 1e-12 for c, x in zip(r.c, r.v))
        assert sum(x * x for x in r.u) == pytest.approx(0 if r.g == "z" else 1)
    half = spark.createDataFrame([([0.5, 1.5, -0.5, 300.0],)], "v array<double>").select(vectors.quantize(F.col("v"), F.lit(1.0)).alias("c")).first().c
    assert list(half) == [0, 2, 0, 127]


def test_lexical_weights(spark):
    texts = ["korupsi suap", "suap", *["lain"] * 98]
    chunks = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    terms = spark.createDataFrame(
        [(1, "group", 0, ["korupsi"], None), (1, "group", 1, ["suap"], None), (1, "phrase", 0, ["korupsi suap"], None), (1, "intent", 0, ["lain"], 0.16), (1, "intent", 1, ["suap"], 0.1)],
        "qid int, kind string, place int, members array<string>, weight double",
    )
    m = ranking.term_matches(chunks, terms, "k", "text")
    w = {(r.kind, r.place): (r.df, r.weight) for r in ranking.term_weights(m, terms, 100).collect()}
    idf = lambda d: 0.5 * (np.log(100 / d) / np.log(100)) ** 2
    assert w["group", 0] == (1, pytest.approx(idf(1))) and w["group", 1] == (2, pytest.approx(idf(2)))
    assert w["phrase", 0] == (1, pytest.approx(0.7)) and w["intent", 1] == (2, 0.16)
    weights = ranking.term_weights(m, terms, 100)
    total = {r.k: r.lexical for r in ranking.lexical_scores(m, weights, "k").collect()}
    assert total[0] == pytest.approx(idf(1) + idf(2) + 0.7 + 0.16) and total[5] == pytest.approx(0.16)
    old = {r.k: r.lexical for r in ranking.lexical_scores(m, weights, "k", "reference").collect()}
    assert old[0] == pytest.approx(2 * idf(2) + 0.7 + 0.16)


def test_named_article_ranks_first(spark):
    asked, _ = questions.frames(spark, {1: "sanksi Pasal 2 UU 31 Tahun 1999"})
    chunks = spark.createDataFrame(
        [("31", "1999", "2", "korupsi", None, None), ("31", "1999", "3", "korupsi", None, None), ("1", "1946", "2", "kuhp lama", None, "UU No. 1 Tahun 2023"), ("31", "1999", "2", "korupsi", "PENJELASAN", None)],
        "c_law string, c_year string, c_article string, c_title string, section string, superseded string",
    )
    cols = [F.col(c) for c in ("law", "year", "article", "titles", "old", "words", "c_law", "c_year", "c_article", "c_title", "section", "superseded")]
    got = [round(r.b, 6) for r in chunks.join(F.broadcast(asked)).select("*", ranking.metadata_boost(*cols).alias("b")).collect()]
    assert got == [0.55, 0.20, -0.25, 0.40]


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(9)], "qid int, k int, s double")
    assert [r.k for r in ranking.top_k(df, 4, "s", "k").orderBy("rank").collect()] == [2, 5, 8, 1]
    assert [r.k for r in ranking.top_k(df, 4, "s", "k", by=None).orderBy("rank").collect()] == [2, 5, 8, 1]


def test_citation_edges(spark):
    far = " kata" * 40
    articles = spark.createDataFrame(
        [
            ("uu-1-2020", "1", "Lihat Pasal 5 dan Pasal 1. Juga Pasal 7 UU Nomor 2 Tahun 2021 Pasal 9."),
            ("uu-1-2020", "2", f"UU Nomor 3 Tahun 2022.{far}{far} Pasal 4"),
            ("uu-2-2021", "1", "Undang-Undang Nomor 1 Tahun 2020 dan UU Nomor 99 Tahun 1999"),
        ],
        "doc string, label string, text string",
    )
    docs = spark.createDataFrame([("uu-1-2020",), ("uu-2-2021",), ("uu-3-2022",)], "doc string")
    edges = {(r.src, r.dst, r.kind) for r in graph.citation_edges(articles, docs).collect()}
    assert ("uu-1-2020#1", "uu-1-2020#5", "internal") in edges and ("uu-1-2020#1", "uu-1-2020#7", "internal") in edges
    assert ("uu-1-2020#1", "uu-2-2021#7", "lintas") in edges and ("uu-1-2020#2", "uu-3-2022", "lintas") in edges
    assert ("uu-1-2020#2", "uu-1-2020#4", "internal") in edges and ("uu-2-2021#1", "uu-1-2020", "lintas") in edges
    assert not any(d.startswith("uu-99") or s == d for s, d, _ in edges)
    first = {(r.src, r.dst) for r in graph.citation_edges(articles, docs, nearest=False).collect()}
    assert ("uu-1-2020#1", "uu-2-2021#5") in first


def test_expansion_adds_three_and_keeps_hits(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "k") for _ in range(40)})
    hits = ["n0", "n3", "n5"]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, kind string, position int")
    h = spark.createDataFrame([(1, n, i + 1, 1.0 - i / 10) for i, n in enumerate(hits)], "qid int, node string, rank int, score double")
    got = [(r.node, round(r.score, 6)) for r in graph.expand_hits(h, graph.adjacency(df, "position")).orderBy("rank").collect()]
    out = {}
    for a, b, _ in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    want, seen = [(n, 1.0 - i / 10) for i, n in enumerate(hits)], set(hits)
    for n, s in list(want):
        for m in out.get(n, []):
            if m not in seen and len(want) < 6:
                seen.add(m)
                want.append((m, round(s * 0.85, 6)))
    assert got == [(n, round(s, 6)) for n, s in want]


def test_sentences_and_summaries(spark):
    long = "Setiap orang yang dengan sengaja melakukan perbuatan itu dipidana penjara lima tahun."
    text = f"Pendek. {long} Ya. (2) {long}"
    units = spark.createDataFrame([(1, text), (2, None), (3, "x")], "k int, t string")
    got = {r.k: r.u for r in units.select("k", sm.sentence_units(F.col("t")).alias("u")).collect()}
    assert got == {1: [f"{long} Ya.", f"(2) {long}"], 2: [], 3: []}
    rows = spark.createDataFrame([(1, "Umum saja. Setiap orang dilarang itu. Ia berhak dan wajib."), (2, "kata " * 100)], "k int, t string")
    out = {r.k: r.summary for r in sm.extractive_summary(rows, "k", "t", INDONESIAN_LAW).collect()}
    assert out[1] == "Ia berhak dan wajib." and out[2].endswith("kata…") and len(out[2]) <= 281


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "B", "dua"), (1, 1, "A", "satu"), (2, 1, "C", None)], "q int, r int, h string, t string")
    got = {r.q: r.context for r in answers.assemble(hits, "q", "r", F.col("h"), F.col("t")).collect()}
    assert got == {1: "[A]\nsatu\n\n---\n\n[B]\ndua", 2: "[C]\n"}
    cut = lambda s: spark.createDataFrame([(s,)], "c string").select(answers.truncate_context(F.col("c"), 20)).first()[0]
    assert cut("x" * 20) == "x" * 20 and cut("a" * 10 + answers.SEPARATOR + "b" * 20) == "a" * 10 + answers.NOTICE and cut("c" * 30) == "c" * 20 + answers.NOTICE


def test_store(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 9), ("z", 3), ("z", 3)], "k string, v int")
    assert sorted(map(tuple, store.upsert(a, b, "k").collect())) == [("x", 1), ("y", 9), ("z", 3)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    f = spark.createDataFrame([("a", "eins"), ("b", "zwei")], "key string, text string")
    m = store.manifest(f, "key", F.col("text"))
    assert {(r.key, r.bytes, r.sha256) for r in m.collect()} == {("a", 4, sha("eins")), ("b", 4, sha("zwei"))}
    assert store.verified(f, m, "key", F.col("text")).count() == 2
    with pytest.raises(Exception, match="digest differs"):
        store.verified(f, m.withColumn("sha256", F.lit("0")), "key", F.col("text")).collect()
    old = spark.createDataFrame([("a", sha("eins"), "eins"), ("b", "0", "alt"), ("c", "1", "weg")], "key string, sha256 string, text string")
    plan = store.delta_plan(old, m, "key")
    assert {r.key: r.action for r in plan.collect()} == {"a": "keep", "b": "fetch", "c": "delete"}
    assert {r.key for r in store.apply_delta(old.select("key", "text"), plan, f, "key").collect()} == {"a", "b"}
    bad = spark.createDataFrame([([1.0],), (None,)], "v array<double>")
    with pytest.raises(Exception, match="no vector"):
        store.checked_export(bad, "v", 1).collect()
    assert st.progress(f, f.limit(1), "key").first().percent == 50


def test_files(spark, tmp_path):
    (tmp_path / "uu-10-2015_Tentang-Hal_ini.pdf").write_bytes(b"one|two")
    (tmp_path / "catatan.pdf").write_bytes(b"bad")
    read = files.binary_files(spark, str(tmp_path))
    meta = {tuple(r) for r in read.select(*files.file_metadata(F.col("path"))).collect()}
    assert meta == {("10", "2015", "Tentang Hal ini"), ("", "", "catatan")}

    def pages_of(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("|")

    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in files.page_texts(read, pages_of).collect()}
    assert got["catatan.pdf"] == (None, "ValueError: no pages") and got["uu-10-2015_Tentang-Hal_ini.pdf"][0] == "<<<PAGE 1>>>\none\n<<<PAGE 2>>>\ntwo"
    export = {"nomor_uu": "1", "tahun_uu": "2020", "tentang": "t", "vec_scale": 0.5, "vec_b64": "AA==", "chunks": [{"id": "1-2020-pasal-1-0", "pasal": "1", "ayat": None, "bab": None, "text": "isi"}]}
    (tmp_path / "uu-1-2020.json").write_text(json.dumps(export))
    assert [(r.position, r.pasal, r.text) for r in files.read_exports(spark, str(tmp_path)).collect()] == [(0, "1", "isi")]


def test_incremental_ingest(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(src)
    ingest.ingest_stream(spark, src, "doc_id long, text string", out, mark).awaitTermination()
    spark.createDataFrame([(2, "B"), (3, "c")], "doc_id long, text string").write.mode("append").parquet(src)
    ingest.ingest_stream(spark, src, "doc_id long, text string", out, mark).awaitTermination()
    assert sorted(map(tuple, ingest.current(spark, out).collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_quotes_and_search_take_all_documents(spark, tmp_path, monkeypatch):
    import re
    import zlib

    from docquery.plans import rankings
    from docquery.plans import vectors as plans

    monkeypatch.setattr(plans, "QUERIES_AT_ONCE", 2)
    rng = random.Random(3)
    words = ["thing", "rents", "the", "that", "water", "trash", "a", "zero"]
    texts = [". ".join(" ".join(rng.choices(words, k=20)).capitalize() for _ in range(rng.randrange(1, 5))) + "." for _ in range(90)] + ["w" * 900, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def embed(text):
        out = np.zeros(32)
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            out[codes[w][0]] += codes[w][1]
        return (out / (np.linalg.norm(out) or 1)).astype(np.float32).astype(float)

    seen = spark.createDataFrame([(w,) for w in [*words, "w" * 900]], "w string")
    codes = {r.w: (r.i, 1 if zlib.crc32(r.w.encode()) % 2 == 0 else -1) for r in seen.select("w", F.expr("pmod(xxhash64(w), 32)").alias("i")).collect()}
    vectors = [embed(t) for t in texts]
    got = {}
    for r in plans.hash_embedding_topk(spark, str(tmp_path)).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id, r.score))
    assert sorted(got) == [0, 20, 40, 60, 80]
    for q, found in got.items():
        scores = [vectors[q] @ x for x in vectors]
        want = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 12), i))[:3]
        assert [x[:2] for x in sorted(found)] == [(n + 1, i) for n, i in enumerate(want)] and all(abs(scores[i] - s) < 1e-5 for _, i, s in found)
    asked = embed("the thing that rents")
    quotes = {r.doc_id: (r.unit_no, r.score) for r in rankings.best_sentence(spark, str(tmp_path)).collect()}
    units = {}
    for r in sm.explode_units(df, ["doc_id"], "text", 800).collect():
        units.setdefault(r.doc_id, []).append((-round(float(embed(r.unit) @ asked), 9), r.unit_no))
    assert set(quotes) == set(units) and len(quotes) > 80
    assert all(quotes[i][0] == min(u)[1] and abs(quotes[i][1] + min(u)[0]) < 1e-5 for i, u in units.items())


def test_exports_in_parts(spark, tmp_path):
    """A document of several parts reads back as one, with every chunk's own vector."""
    rows = [("1", "2000", "t", p, f"id-{p}", "1", None, None, f"text {p}", [float(p % 5), -100.0 if p == 9 else 1.0]) for p in range(20)] + [(None, "2000", "u", 3, "x", None, 2, "b", None, [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "nomor_uu string, tahun_uu string, tentang string, position long, id string, pasal string, ayat int, bab string, text string, embedding array<double>")
    parts = store.export_payloads(chunks, span=8)
    assert sorted((r.key, r.start, r.n_chunks) for r in parts.collect()) == [("uu--2000", 0, 1), ("uu-1-2000", 0, 8), ("uu-1-2000", 8, 8), ("uu-1-2000", 16, 4)]
    files.write_exports(parts, str(tmp_path / "lines"))
    back = files.read_exports(spark, str(tmp_path / "lines"), lines=True, dim=2).collect()
    scale = 100 / 127
    want = [("1", p, f"text {p}", [round(p % 5 / scale), -127 if p == 9 else round(1 / scale)]) for p in range(20)]
    assert sorted((r.nomor_uu, r.position, r.text, r.codes) for r in back) == sorted([("", 0, None, [0, 0]), *want], key=lambda x: x[:2])
    m = {r.key: r for r in store.export_manifest(parts, "v1", 2, "hash").collect()}
    lines = (tmp_path / "lines").glob("part-*")
    assert m["uu-1-2000"].chunks == 20 and m["uu--2000"].chunks == 1
    assert m["uu-1-2000"].bytes + m["uu--2000"].bytes == sum(len(x) for f in lines for x in f.read_bytes().splitlines())


def test_words_are_hashed_and_counted_in_one_pass(spark):
    """No pass over the words per component; the zero vector and null stay."""
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.hash_embedding(F.col("t"), 8).alias("v"))
    assert "array_remove" not in df._jdf.queryExecution().optimizedPlan().toString()
    some, *none = (r.v for r in df.collect())
    assert abs(sum(x * x for x in some) - 1) < 1e-6 and none == [[0.0] * 8] * 2


def test_a_task_keeps_its_best(spark):
    """The best of several batches, and of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, [float(i * 37 % 50), 1.0]) for i in range(50)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "qid long, vector array<double>")
        got = vectors.dense_top_k(q, df, 3)
        found = sorted((r.qid, r["rank"], r.score) for r in got.collect())
        assert found == [(1, 1, 49.0), (1, 2, 48.0), (1, 3, 47.0), (2, 1, 0.0), (2, 2, -1.0), (2, 3, -2.0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_units_are_joined_without_copies(spark):
    text = "Short. " + "x" * 70 + ". And short. More. " + "y" * 60 + "."
    df = spark.createDataFrame([(text,), ("",), ("Short. Again.",)], "t string").select(sm.sentence_units(F.col("t")).alias("u"))
    assert "array_append" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.u for r in df.collect()] == [["x" * 70 + ". And short. More.", "y" * 60 + "."], [], []]


def test_long_units_are_quoted(spark, tmp_path):
    """A unit of more than 800 characters can be the best quote, or the only one."""
    from docquery.plans import rankings

    poor, best = "Water and trash and zero and more words that nobody has asked for.", "The thing that rents " * 50 + "."
    texts = [poor + " " + best, best, "w" * 900, poor, best + " " + poor + " " + best, "Short.", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.unit_no, r.long, r.score > 0.99) for r in rankings.best_sentence(spark, str(tmp_path)).collect()}
    assert got == {0: (1, True, True), 1: (0, True, True), 2: (0, True, False), 3: (0, False, False), 4: (0, True, True)}
    units = sm.explode_units(spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id"], "text")
    assert units.columns == ["doc_id", "unit_no", "unit"] and units.count() == 8
