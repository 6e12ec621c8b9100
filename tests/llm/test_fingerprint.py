import datetime
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docquery.llm import fingerprint as fp
from docquery.llm.queries import op2_fingerprint


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    left, right = [], []
    for n, d in [(0, 0), (1, 0), (1, 1), (40, 3), (40, 40), (2000, 5), (3000, 900), (0, 70)]:
        both, a, b = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (n, d, d // 2))
        left.append(np.concatenate([both, a])), right.append(np.concatenate([both, b]))
    for a, b, (x, y) in zip(left, right, fp.differences(left, right)):
        assert set(x) == set(a) - set(b) and set(y) == set(b) - set(a)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["One. ", "two, ", "three\n", "é ", "word " * 30]), max_size=12), st.lists(st.sampled_from(["One. ", "four; ", "three\n"]), max_size=12))
def test_likeness_is_that_of_the_digest_sets(a, b):
    x, y = fp.digests("".join(a)), fp.digests("".join(b))
    [(p, q)] = fp.differences([x], [y])
    want = len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) + len(y) else 1.0
    assert fp.likeness(len(x), len(y), len(p) + len(q)) == want
    assert fp.encode([x]) == fp.encode([fp.digests("".join(a))])


def test_stored_fingerprints_compare():
    """From the strings alone: the difference as sets have it, or None; and what
    differences finds for the same pair."""
    rng = np.random.default_rng(4)
    told = 0
    for n, d, e in [(0, 0, 0), (1, 1, 0), (30, 5, 4), (30, 0, 3), (200, 30, 30), (1000, 20, 1), (900, 100, 100), (5, 3000, 0), (0, 40, 40)]:
        both, a, b = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (n, d, e))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        found = fp.compare(*fp.encode([x, y]))
        [(p, q)] = fp.differences([x], [y])
        assert (set(p), set(q)) == (set(a), set(b))
        if found is not None:
            told += 1
            assert (set(found[0]), set(found[1])) == (set(a), set(b))
    assert told >= 6 and fp.compare(*fp.encode([x[:0], np.arange(5, 4000, dtype=np.uint64)])) is None


def test_texts_keep_their_pieces_when_something_is_put_in():  # a third replaced leaves a half at best
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghi", k=rng.randrange(2, 8))) for _ in range(900)]
    long = " ".join(rng.choices(words, k=3000))
    chinese = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    stops = "".join(chr(0x4E00 + rng.randrange(2000)) + ("。" if i % 17 == 0 else "") for i in range(3000))
    for text, other, least in [(long, "new " + long, 0.95), (long, long[:5000] + " x " + long[5000:], 0.95), (chinese, chinese[:2000] + chinese[:1000][::-1], 0.45), (chinese, "新" + chinese, 0.9), (stops, stops[:2000] + stops[:1000], 0.45)]:
        x, y = fp.digests(text), fp.digests(other)
        assert len(x) > 50
        [(p, q)] = fp.differences([x], [y])
        assert fp.likeness(len(x), len(y), len(p) + len(q)) > least


def test_the_registered_query_gives_the_likeness_of_stored_fingerprints(spark, tmp_path):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choices(["alpha", "béta", "gamma", "delta"], k=6)) + f" {rng.random()}.\n"
    rows = [(i, "".join(sentence() for _ in range(rng.randrange(40)))) for i in range(80)]
    rows = [(i, rows[i + 1][1] + "End." if i % 4 == 0 else t) for i, t in rows] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op2_fingerprint(spark, str(tmp_path)).collect(), key=lambda r: -r.doc_id)
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == list(brute(sorted(rows, reverse=True)))
    told = [0, 0]
    for r, following in zip(got, got[1:] + got[:1]):
        for k, (other, near) in enumerate(((r.edited_fingerprint, r.near_edited), (following.fingerprint, r.near_next))):
            found = fp.compare(r.fingerprint, other)
            if found is not None:
                told[k] += 1
                assert near == fp.likeness(fp.decode(r.fingerprint)[0], fp.decode(other)[0], sum(map(len, found)))
    assert told[0] > 40 and told[1] > 15


def brute(rows):
    """rows: (id, text) in the order of the operator."""
    rows = [(i, t or "") for i, t in rows]
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 3
        yield i, len(text), hashlib.sha256((text[: len(text) - n] + other[:n]).encode()).hexdigest()


def test_every_row_meets_the_next(spark):
    rng = random.Random(3)
    words = ["alpha", "béta,", "gamma.", "delta\n", "x"]
    rows = [(i * 3 - 50, " ".join(rng.choices(words, k=rng.randrange(60))), "c", "d") for i in range(300)]
    rows += [(9999, None, "c", "d"), (-9999, "", "c", "d"), (None, "last of all. " * 9, "c", "d"), (5000, "long line " * 30000, "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, id string").repartition(7)
    got = fp.fingerprint_edits(df, rows_at_once=50).collect()
    order = sorted((r[:2] for r in rows if r[0] is not None), reverse=True) + [r[:2] for r in rows if r[0] is None]
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(repr, brute(order)))
    texts = dict(order)
    by_text = {}
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in got) > 1.5 * sum(r.near_next for r in got)


def test_repeated_ids_and_small_tables(spark):
    for rows in ([], [(1, "a b c")], [(None, "a b c d")], [(1, "a b c"), (1, "d e f")], [(2, "same text"), (2, "same text"), (2, "same text")]):
        df = spark.createDataFrame(rows, "doc_id int, text string")
        got = fp.fingerprint_edits(df).collect()
        assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
        if len(rows) == 1:
            assert got[0].near_next == 1.0


def test_changed_paragraphs(spark):
    df = spark.createDataFrame([(1, "A one.\nB two.\nC", "A one.\nB three.\nC"), (2, None, "x"), (3, "a\na\na", "a\na")], "k long, x string, y string")
    got = {r.k: (r.only_left, r.only_right) for r in fp.changed_paragraphs(df, "k", "x", "y").collect()}
    assert got == {1: (["B two."], ["B three."]), 2: ([], ["x"]), 3: (["a"], [])}


def test_ids_of_any_type_and_many_rows_of_one_id(spark):
    rng = random.Random(5)
    texts = [f"row {i}. " * rng.randrange(1, 4) for i in range(200)]
    for kind, ids in (("string", [f"k{rng.randrange(50)}" for _ in texts]), ("long", [None] * 150 + [7] * 50), ("date", [datetime.date(2020, 1, 1 + i % 28) for i in range(200)])):
        got = fp.fingerprint_edits(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string").repartition(6)).collect()
        assert sorted(map(repr, ((r.doc_id, r.n_chars) for r in got))) == sorted(map(repr, ((i, len(t)) for i, t in zip(ids, texts))))
        # The rows form one ring in descending order of ids: each is followed by a row of its own id or of the next one.
        order = sorted({i for i in ids if i is not None}, reverse=True) + [None] * (None in ids)
        after = dict(zip(order, order[1:] + order[:1]))
        known = {}
        for r in got:
            options = {o for i, o in zip(ids, texts) if i in (r.doc_id, after[r.doc_id])}
            known.setdefault(r.doc_id, set()).add(any(hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest() == r.edited_sha256 for t in texts if len(t) == r.n_chars for o in options))
        assert all(v == {True} for v in known.values())
    buckets = fp.with_next(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).where("not copy").select("bucket").distinct().count()
    assert buckets >= 4
