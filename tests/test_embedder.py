"""The fitted embedder against a dense decomposition and the hashed stand-in."""

import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquery.operators import embedder
from docquery.operators import vectors as v

DATA = "/root/testdata/sf0.01"
BUCKETS = 512
TEXTS = [(i, " ".join(f"{'abcdef'[i % 6]}{(i * j) % 11} w{j % 5}" for j in range(1, 30))) for i in range(200)]
TEXTS += [(300, None), (301, ""), (302, "... --- 1"), (303, "Groß ÉCOLE école 東京 " * 20_000), (304, "same"), (304, "same"), (None, "no id")]


def matrix(texts):
    """Rows of length one, as the docstrings say, and the idf."""
    times = np.zeros((len(texts), BUCKETS))
    for i, (_, t) in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            times[i, xxhash.xxh32_intdigest(w.encode()) % BUCKETS] += 1
    idf = np.log((1 + len(texts)) / (1 + (times > 0).sum(axis=0))) + 1
    dense = np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0) * idf
    length = np.linalg.norm(dense, axis=1, keepdims=True)
    return dense / np.where(length == 0, 1, length), idf


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, vector string, at int").repartition(5)


def test_it_finds_the_leading_directions(docs):
    model = embedder.fit(docs, dim=12, buckets=BUCKETS, rounds=4)
    a, idf = matrix(TEXTS)
    assert np.allclose(model.idf, idf)
    exact = np.linalg.svd(a, compute_uv=False)[:12]
    own = np.linalg.norm(a @ model.projection, axis=0)
    assert np.allclose(own, exact, rtol=0.02) and np.allclose(model.projection.T @ model.projection, np.eye(12), atol=1e-4)
    got = {r.doc_id: np.array(r.vector) for r in embedder.embed(docs, model).collect()}
    want = a @ model.projection
    for i, (key, _) in enumerate(TEXTS):
        length = np.linalg.norm(want[i])
        assert np.allclose(got[key], want[i] / length if length > 1e-9 else 0, atol=1e-3)
    assert embedder.embed(docs, model).count() == len(TEXTS)
    again = embedder.fit(docs.repartition(2), dim=12, buckets=BUCKETS, rounds=4)
    assert np.abs(again.projection @ again.projection.T - model.projection @ model.projection.T).max() < 1e-4


def test_models_are_stored_with_their_name(spark, docs, tmp_path):
    model = embedder.fit(docs, dim=8, buckets=BUCKETS)
    embedder.save(spark, model, str(tmp_path / "model"))
    back = embedder.load(spark, str(tmp_path / "model"), model.name)
    assert back.name == model.name and np.array_equal(back.projection, model.projection) and np.array_equal(back.idf, model.idf)
    with pytest.raises(ValueError):
        embedder.load(spark, str(tmp_path / "model"), "another")


def test_empty_table_and_few_directions(spark, docs):
    none = embedder.fit(docs.limit(0), dim=4, buckets=64)
    assert {tuple(r.vector) for r in embedder.embed(docs, none).collect()} == {(0.0,) * 4}
    assert embedder.embed(docs.limit(0), none).collect() == []
    few = embedder.fit(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id int, text string"), dim=5, buckets=64)
    assert (np.linalg.norm(few.projection, axis=0) > 0).sum() == 2


def test_embed_text(spark):
    df = spark.createDataFrame([("about", "text"), (None, "text"), (" ", "text"), ("about", None)], "c string, t string")
    assert [r[0] for r in df.select(embedder.embed_text(F.col("c"), F.col("t"))).collect()] == ["about\n\ntext", "text", "text", "about\n\n"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_neighbours_of_held_out_documents_share_their_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = embedder.fit(docs.where("doc_id % 20 <> 0"))
    rows = docs.select("doc_id", "lang", v.hash_embedding(F.col("text"), 64).alias("hashed")).join(embedder.embed(docs, model), "doc_id").orderBy("doc_id").toPandas()
    held, lang = (rows.doc_id % 20 == 0).to_numpy(), rows.lang.to_numpy()

    def shared(column):
        m = np.array(rows[column].tolist())
        s = m[held] @ m[~held].T
        return (lang[~held][np.argsort(-s, axis=1)[:, :5]] == lang[held][:, None]).mean()

    assert shared("vector") > max(0.98, shared("hashed"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_registered_search_finds_what_a_full_scan_finds(spark):
    from docquery.plans.contract import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = embedder.embed(docs, embedder.fit(docs)).orderBy("doc_id").toPandas()
    m, keys = np.array(rows.vector.tolist(), float), rows.doc_id.to_numpy()
    hits = total = 0
    found = {}
    for r in queries()["semantic_topk"](spark, DATA).collect():
        found.setdefault(r.qid, set()).add(r.doc_id)
    for i in np.flatnonzero(keys % 20 == 0):
        score = m @ m[i]
        least = np.sort(score)[-3] - 1e-5
        hits += sum(score[np.searchsorted(keys, k)] >= least for k in found[keys[i]])
        total += 3
    assert hits >= 0.9 * total
