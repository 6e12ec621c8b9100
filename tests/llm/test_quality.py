import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquery.llm import quality as q
from docquery.llm.queries import op8_quality

DATA = "/root/testdata/sf0.01"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é|\x0b\x1c\xa0"), max_size=60))
def test_base_counts_equal_the_rules(text):
    assert q.statistics(text, {})[0] == brute(text)


def test_windows_of_many_distinct_words(monkeypatch):
    monkeypatch.setattr(q, "_WIDTH", 3)
    text = " ".join(f"w{i % 40}" for i in range(90))
    assert q.statistics(text, {})[0] == brute(text)


def sample(n=800, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(q.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(9 * x[:, 0]) + rng.normal(0, 0.1, n) < 0.6).astype(float)
    return x, y


def test_trees_learn_and_are_monotone():
    x, y = sample()
    trees = q.grow(x, y)
    a, b = sample(seed=2)
    assert ((trees.score(a) > 0) == b).mean() > 0.9
    for j, sign in enumerate(q.FEATURES.values()):
        if sign:
            steps = np.repeat(a[:50], 30, axis=0)
            steps[:, j] = np.tile(np.linspace(-0.2, 1.2, 30), 50)
            along = np.diff(trees.score(steps).reshape(50, 30), axis=1)
            assert (sign * along >= -1e-12).all()
    free = q.grow(x, y, signs=[0] * x.shape[1])
    assert ((free.score(a) > 0) == b).mean() > 0.85


def test_flat_arrays_equal_walking_the_nodes():
    x, y = sample(200)
    t = q.grow(x, y, n_trees=5)

    def walk(row):
        total = t.start
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return total

    assert np.allclose(t.score(x), [walk(r) for r in x])


@pytest.mark.parametrize("n, label", [(0, 0), (5, 1), (5, 0)])
def test_nothing_to_learn(n, label):
    t = q.grow(np.zeros((n, len(q.FEATURES))), np.full(n, float(label)))
    assert (t.score(np.zeros((3, len(q.FEATURES)))) >= 0).all() == (label or n == 0)


def test_held_out_documents_and_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(2000)]
    good = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(60, 200))) + "."
    bad = [lambda: re.sub(" ", "*** ", good()), lambda: good().upper().replace(" ", "!! "), lambda: "\n".join(["same line here now again"] * 40)]
    rows = [(i, good() if i % 3 else rng.choice(bad)(), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 250] + [(None, 1), (3, None)], "doc_id long, quality int")
    trees = q.train(docs, labels)
    got = {r.doc_id: r for r in q.judge_quality(docs, trees).collect()}
    assert sum(got[i].kept == bool(y) for i, _, y in rows if i >= 250) > 0.95 * 150
    for i, t, _ in rows:
        assert [got[i][c] for c in q.BASE] == brute(t)
    odd = [(None, None, ""), (1, "", ""), (1, "", ""), (2, "w " * 60000, ""), (3, good(), "")]
    df = spark.createDataFrame(odd, docs.schema)
    assert sorted(r.n_words for r in q.judge_quality(df, trees).collect())[:3] == [0, 0, 0]
    assert {r.kept for r in q.judge_quality(df, trees).collect() if r.n_words in (0, 60000)} == {False}
    none = q.train(docs, labels.limit(0))
    assert {r.kept for r in q.judge_quality(df, none).collect() if r.doc_id == 3} == {True}
    assert q.judge_quality(df.limit(0), none).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_labels_of_the_tables(spark):
    """Trained on the labels of even ids, judged on those of odd ones that pass
    the base rules."""
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    trees = q.train(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").groupBy("doc_id").min("quality").withColumnRenamed("min(quality)", "y")
    rows = q.judge_quality(docs, trees).where("not base_failed").join(held, "doc_id").select("probability", "kept", "y").collect()
    p, y = np.array([r.probability for r in rows]), np.array([r.y for r in rows])
    above = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert (y == 0).sum() > 10 and above > 0.98
    assert np.mean([not r.kept for r in rows if not r.y]) > 0.9 and np.mean([r.kept for r in rows if r.y]) > 0.98


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_base_columns_of_the_registered_query_in_sql(spark):
    got = op8_quality(spark, DATA).toPandas().sort_values("doc_id")
    want = duckdb.sql(rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM '{DATA}/documents.parquet'),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
        m AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN u USING (doc_id) LEFT JOIN m USING (doc_id) ORDER BY doc_id""").df()
    assert got[["doc_id", *q.BASE]].to_numpy().tolist() == want[["doc_id", *q.BASE]].to_numpy().tolist()
    assert (got.base_failed == ((want.n_words < 50) | (100 * want.n_repeat_words > 50 * want.n_words)).to_numpy()).all() and not (got.kept & got.base_failed).any()
