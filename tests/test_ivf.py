"""The inverted-file index against full scans."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import ivf

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, qid string, list int"


def nearest(rows, asked, k):
    """{query: [(key, rank)]} by a full scan."""
    keys, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q, v in asked:
        score = np.round(m @ np.array(v, np.float32).astype(float), 12)
        out[q] = [int(keys[i]) for i in np.lexsort((keys, -score))[:k]]
    return out


def grouped(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


def clustered(n, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim)) * 3
    return [(i, (centres[i % 20] + r.normal(size=dim) * 0.5).astype(np.float32).tolist()) for i in range(n)]


def test_all_lists_equal_a_full_scan(spark):
    rows = clustered(1500) + [(2000 + i, [1.0] * 16) for i in range(60)] + [(3000 + i, [0.0] * 16) for i in range(5)]
    asked = [(q, rows[q][1]) for q in range(0, 1500, 37)] + [(9000, [1.0] * 16), (9001, [0.0] * 16), (9002, [-1.0] * 16)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows] + [(7777, None, "x", 0)], SCHEMA).repartition(5)
    queries = spark.createDataFrame([*asked, (9003, None)], "qid long, vector array<float>")
    index = ivf.build(df, most_fit=300)
    assert 1 < len(index.centroids) <= 19  # a sixteenth of a sample of about 300
    found = grouped(ivf.search(index, queries, df, 5, n_probe=len(index.centroids)))
    assert found == nearest(rows, asked, 5)
    with pytest.raises(ValueError):
        ivf.search(index, queries, df, 17)


def test_few_lists_suffice_where_rows_cluster(spark):
    rows = clustered(3000)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    index = ivf.build(df)
    assert index.n_probe <= len(index.centroids) // 3
    asked = [r for r in rows if r[0] % 19 == 0]  # of all clusters
    found, want = grouped(ivf.search(index, spark.createDataFrame(asked, "qid long, vector array<float>"), df)), nearest(rows, asked, 5)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_the_scan_is_pruned_and_deterministic(spark):
    rows = clustered(2000)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    index = ivf.build(df)
    again = ivf.build(df.repartition(7))
    assert np.array_equal(index.centroids, again.centroids) and index.n_probe == again.n_probe
    found = ivf.search(index, df.where("vec_id = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), df, n_probe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert found.count() == 5


def test_equal_vectors_and_small_tables(spark):
    rows = [(i, [0.6, 0.8]) for i in range(400)] + [(500, [0.8, 0.6]), (501, [0.8, 0.6])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)
    index = ivf.build(df)
    assert spark.read.parquet(index.path).count() <= 3 * 2 * index.most_k
    queries = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(30)], "qid long, vector array<float>")
    assert set(map(tuple, grouped(ivf.search(index, queries, df, 3, n_probe=9)).values())) == {(0, 1, 2)}
    one = df.where("vec_id = 500")
    assert grouped(ivf.search(ivf.build(one), queries.limit(1), one)) == {0: [500]}
    assert ivf.search(index, queries.limit(0), df).collect() == []
    with pytest.raises(ValueError):
        ivf.build(df.limit(0))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_recall_of_the_registered_query(spark):
    from docquery.plans.contract import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 5)
    found = grouped(queries()["ivf_topk"](spark, DATA))
    assert found.keys() == want.keys()
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
