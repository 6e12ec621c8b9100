import os
import random
import re

import numpy as np
import pytest

from docquery.llm import ngram_join as nj
from docquery.llm.components import components


def brute(rows, n, t):
    """Component ids by comparing all pairs of sets of words."""
    sets = []
    for _, text in rows:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))}, links


def corpus(seed, sizes=(3, 8, 12, 19, 20, 25, 40, 90, 200)):
    """Texts and chains of ever more edited copies, shared passages, tiny texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    texts = ["", None, "one", "One", "one two", "ONE two", "  ", "one two three", "É x y", "é x y", "a\tb\nc", "a b c", "a b c"]
    for _ in range(45):
        base = rng.choices(words, k=rng.choice(sizes))
        if rng.random() < 0.3:
            base = base + passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 60)])):
                at = rng.randrange(len(base))
                base = base[:at] + rng.choices(words, k=rng.choice([0, 1, 1]) if len(base) > 2 else 1) + base[at + 1 :]
            texts.append(" ".join(base).upper() if rng.random() < 0.1 else " ".join(base))
    # many near copies of one text
    base = rng.choices(words, k=100)
    for _ in range(60):
        new = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            new[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(new))
    rng.shuffle(texts)
    ids = rng.sample(range(10000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, n, t", [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 70)])
def test_components_equal_those_of_all_pairs(spark, seed, n, t):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, x, 0, "y") for k, x in rows], "doc_id long, text string, component_id int, owner string").repartition(5)
    want, links = brute(rows, n, t)
    assert links > 100
    got = nj.near_duplicates(df, n_words=n, threshold=t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_nulls_repeats_and_one_of_each(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, "q r s t u v"), (9, "other words in here now"), (7, None), (7, ""), (3, long), (2, long + " end")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id int, text string, text_hash string")
    found = nj.near_duplicates(df)
    got = sorted((repr(r.doc_id), r.component_id) for r in found.collect())
    assert got == sorted([("None", 4), ("None", 4), ("4", 4), ("4", 4), ("9", 9), ("9", 9), ("7", 7), ("7", 7), ("3", 2), ("2", 2)])
    kept = nj.one_of_each(df, found)
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted((repr(i), len(t or "")) for i, t in [rows[2], *rows[4:8], rows[9]])
    empty = nj.near_duplicates(df.limit(0))
    assert empty.collect() == [] and nj.one_of_each(df.limit(0), empty).collect() == []


def test_pairs_at_the_threshold_share_enough_fragments():
    rng = np.random.default_rng(2)
    for t in (90, 80):
        for a in (9, 10, 19, 38, 57, 200, 950):
            for b in range(a, a * 100 // t + 1):
                d = (a + b) * (100 - t) // (100 + t)
                if (d - (b - a)) % 2:
                    d -= 1
                x_only, y_only = (d - (b - a)) // 2, (d + (b - a)) // 2
                if x_only < 0 or d <= 0:
                    continue
                g = np.unique(rng.integers(0, 2**64, a + y_only, dtype=np.uint64))
                rng.shuffle(g)
                x, y = np.sort(g[:a]), np.sort(g[x_only:])
                kx = {r: set(k.tolist()) for r, k in nj.fragment_keys(x, t)}
                ky = {r: set(k.tolist()) for r, k in nj.fragment_keys(y, t)}
                lows, _, spares = nj._size_classes(t)
                spare = spares[np.searchsorted(lows, a, 'right') - 1]
                assert max(len(kx[0] & k) for k in ky.values()) >= 1 + spare >= 3


def test_hot_keys_are_sent_at_most_twice():
    keys = np.repeat(np.array([5, 6], np.uint64), 1000)
    owners = np.r_[np.arange(1000), np.zeros(1000)].astype(np.int64)
    k, o, (common, sent) = nj._shared(keys, owners)
    assert common.sum() == 1000 and sorted(zip(k[sent].tolist(), o[sent].tolist())) == [(5, 0), (5, 999), (6, 0)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(-500, 500), 300)
    links = [(nodes[i], nodes[i + 1]) for i in range(0, 150)] + [(nodes[200], x) for x in nodes[201:260]] + [(1000, 1001), (1001, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    for group in (nodes[:151], nodes[200:260], [1000, 1001]):
        assert {got.get(x, x) for x in group} == {min(group)}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


@pytest.mark.parametrize("seed, n, t, at_once", [(1, 3, 90, 1024), (3, 5, 80, 7)])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, seed, n, t, at_once):
    monkeypatch.setattr(nj, "CLASSES_AT_ONCE", at_once)
    rows = corpus(seed)
    sets = []
    for _, text in rows:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    fits = lambda a, b: bool(a & b) and 100 * len(a & b) >= t * len(a | b)
    want = {k: sum(fits(a, b) for j, b in enumerate(sets) if i != j) for i, ((k, _), a) in enumerate(zip(rows, sets))}
    assert max(want.values()) > 8
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n_words=n, threshold=t).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_what_is_written_can_be_erased(spark):
    from docquery.llm import common

    a, b = common.written(spark.range(5), "a"), common.written(spark.range(3), "b")
    assert a.count() == 5
    common.erase(a)
    assert b.count() == 3
    folder = common._own_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("a-")] and [x for x in os.listdir(folder) if x.startswith("b-")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as S

    from docquery.llm import common

    none = S(conf=S(get=lambda k, d: d), sparkContext=S(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(none)
