import hashlib
import itertools
import os
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from docquery.llm.pieces import DEFAULT_MODEL, SPACE, Lattice, Vocabulary, lattice, load, normalized
from docquery.llm.queries import op1_token_counts, op3_segmentation
from docquery.llm import segmentation
from docquery.llm.segmentation import Paths, Steps, all_decode, best_path, decode, encode, n_best_choices, n_best_paths, segment, segment_all, survey
from docquery.llm.token_counts import best_count, count_tokens, counts as counts_of

DATA = "/root/testdata/sf0.01"
#: A small vocabulary with many ties: pieces with scores, then the 256 bytes.
SMALL = {"▁": -3, "a": -2, "b": -2, "ab": -4, "ba": -4, "▁a": -5, "aba": -6, "bb": -3, "▁▁": -5, "é": -2}


def small():
    names = list(SMALL) + [f"<0x{b:02X}>" for b in range(256)] + ["<unk>"]
    n = len(SMALL)
    return Vocabulary.of(names, [float(SMALL.get(x, 0)) for x in names], {n + 256}, {b: n + b for b in range(256)}, n + 256)


def every(lat, chunk):
    """All segmentations of a chunk as (score, ids), by trying all cuts."""
    scores = {p: (s, i) for p, i, s in lat.v.pieces}
    for cuts in itertools.product([0, 1], repeat=len(chunk) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(chunk)]
        parts = [chunk[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores or len(p) == 1 for p in parts):
            path = [(0, 1, scores[p][1]) if p in scores else (0, 1, -1) for p in parts]
            ids = [x for p, e in zip(parts, path) for x in lat.ids_of(p, [(0, len(p), e[2])])]
            yield sum(scores.get(p, (lat.v.unknown_score,))[0] for p in parts), ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab▁éz"), min_size=1, max_size=7))
def test_n_best_of_a_chunk_equals_all_segmentations(chunk):
    lat = lattice(small())
    want = sorted(every(lat, chunk), key=lambda x: -x[0])
    got = n_best_paths(lat, chunk, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert len({tuple(i) for _, i in got}) == len(got) and all(x in want for x in got)
    best, loss, ids = best_path(lat, chunk)
    assert (best, np.frombuffer(ids, "<i4").tolist()) == got[0] and loss == (got[0][0] - got[1][0] if len(got) > 1 else None)
    score, count = best_count(lat, chunk)
    assert (score, count) == (got[0][0], len(got[0][1]))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é"), max_size=7))
def test_n_best_of_a_text_equals_all_segmentations(text):
    lat = lattice(small())
    want = sorted((s for s, _ in every(lat, normalized(text))), reverse=True) if text else [0]
    assert [s for s, _ in segment(Paths(lat, 5), text)] == want[:5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=4).map(lambda x: [0, *sorted(x)][: len(x)]), max_size=5), st.integers(1, 9))
def test_choices_are_the_least_sums(losses, n):
    want = sorted(sum(x[p] for x, p in zip(losses, picks)) for picks in itertools.product(*(range(len(x)) for x in losses)))[:n]
    got = n_best_choices(losses, n)
    assert [s for s, _ in got] == want
    assert len({tuple(sorted(c.items())) for _, c in got}) == len(got)


def check_steps(lat, steps, chunks):
    """best_paths, for all that is taken, equals best_path one by one."""
    taken = [c for c in chunks if steps.numbers([c]).all()]
    if taken:
        scores, losses, counts, ids = steps.best_paths(np.array(list(map(len, taken))), steps.numbers(taken))
        ends = np.cumsum(counts)
        assert ends[-1] == len(ids)
        got = [(s, None if x == np.inf else x, ids[e - n : e].astype("<i4").tobytes()) for s, x, n, e in zip(scores, losses, counts, ends)]
        assert got == [best_path(lat, c) for c in taken]
    return taken


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab▁éz"), min_size=1, max_size=9), max_size=30), st.sampled_from([1, 14, 1 << 24]))
def test_paths_of_many_chunks_equal_those_of_each(chunks, cells):
    lat = lattice(small())
    steps = type("Narrow", (Steps,), {"CELLS": cells})(lat)
    taken = check_steps(lat, steps, chunks)
    assert cells < 100 or {c for c in chunks if set(c) <= set("ab▁")} == set(taken)


def test_ordinary_words_are_taken_many_at_once(monkeypatch):
    """Only characters that no piece or no longer piece has are searched one by one."""
    lat = lattice(load())
    rng = random.Random(3)
    chunks = [SPACE + "".join(rng.choices("etaonrishdlufcmgypwbvkéüçñ-", k=rng.randrange(16))) for _ in range(3000)]
    want = {c: best_path(lat, c) for c in chunks}
    assert len(check_steps(lat, Steps(lat), chunks)) > 2000
    alone = []
    monkeypatch.setattr(segmentation, "best_path", lambda _, c: alone.append(c) or best_path(lat, c))
    words = [c for c in want if c[1:].isalpha() and lat.chunks(c) == [c]]
    found = segment_all(Paths(lat, 1), [c[1:] for c in words])
    assert not alone and len(words) > 1000 and [f[0] for f in found] == [(want[c][0], want[c][2]) for c in words]


def test_blocks_and_forgetting_change_nothing():
    """Texts together or one by one, with all or few chunks remembered."""
    lat, some = lattice(load()), [*texts(), None, "x" * 700, "ab " * 500]
    small_memory = type("Forgetful", (Paths,), {"CHARS": 200})(lat, 3)
    whole = segment_all(Paths(lat, 3), some)
    assert whole == [segment(small_memory, t) for t in some] == segment_all(small_memory, some)
    assert all_decode(lat, some, whole) == [True] * len(some)
    assert segment_all(Paths(lat, 3), [None, ""]) == [[(0, b"")]] * 2 and all_decode(lat, [None, ""], [[(0, b"")]] * 2) == [True] * 2
    assert segment_all(Paths(lat, 3), []) == [] == all_decode(lat, [], [])
    swapped = [whole[k] for k in (5, *range(1, 5), 4)]
    assert all_decode(lat, some[:6], swapped) == [False, True, True, True, True, False]
    assert all_decode(lat, ["hello"], [[segment(Paths(lat, 1), "hello")[0], segment(Paths(lat, 1), "hellO")[0]]]) == [False]
    assert all_decode(lat, [""], [segment(Paths(lat, 1), "a")]) == [False]


def test_a_call_that_broke_off_is_forgotten(monkeypatch):
    paths = Paths(lattice(load()), 2)
    want = segment(Paths(lattice(load()), 2), "some words")
    monkeypatch.setattr(Paths, "_learn", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        segment(paths, "some words")
    monkeypatch.undo()
    assert segment(paths, "some words") == want


@pytest.fixture(scope="module")
def library():
    """The same file with the model type changed to unigram and the placeholder
    scores replaced: the tokenizer's own Viterbi and n-best search."""
    m = proto.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    scores = {i: s for _, i, s in load().pieces}
    for i, p in enumerate(m.pieces):
        p.score = scores.get(i, p.score)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts():
    """Texts whose sums of scores stay below 2^24, so that the library's
    single precision is exact."""
    rng = random.Random(5)
    words = ["the", "thernd", "enqueeau", "Éçaian", "token", "=", '"04dbeb"', "über", "日本", "\n", "  ", "https://a.b/c?d", "😀", "x" * 30, "1234", "ñ", "of%%%"]
    return ["", " ", "a", "hello world", *(" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(200))]


def test_counts_and_ids_equal_the_library(library):
    lat = lattice(load())
    counts, paths = counts_of(lat), Paths(lat, 1)
    for t in texts():
        want = library.encode(t)
        assert np.frombuffer(segment(paths, t)[0][1], '<i4').tolist() == want, t
        assert sum(map(counts.__getitem__, lat.chunks(normalized(t)))) == len(want)
        assert lat.decode(want) == t


def test_n_best_scores_equal_the_library(library):
    lat = lattice(load())
    scores = {i: s for _, i, s in load().pieces}
    paths = Paths(lat, 5)
    for t in ["hello world", "the thernd enqueeau of it", "token = abc", "international"]:
        want = library.nbest_encode_as_ids(t, 5)
        got = segment(paths, t)
        assert [s for s, _ in got] == [sum(scores[i] for i in ids) for ids in want]


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "a b", 7), (3, "word " * 50000, 7), (4, "z" * 20000, 7), (5, "日本\n\n語 é", 7), (5, "日本\n\n語 é", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    counts = sorted((repr(r.doc_id), r.n_tokens) for r in count_tokens(df).collect())
    found = encode(df, n_best=2).collect()
    assert counts == sorted((repr(r.doc_id), len(r.segmentations[0].ids)) for r in found)
    best = encode(df).selectExpr("doc_id", "segmentations[0].ids as ids")
    back = sorted((repr(r.doc_id), r.text) for r in decode(best, "doc_id", "ids").collect())
    assert back == sorted((repr(i), t or "") for i, t, _ in rows)
    for r in survey(df, 3).collect():
        assert r.round_trip and list(r.scores) == sorted(r.scores, reverse=True)
    assert count_tokens(df.limit(0)).collect() == [] and encode(df.limit(0)).collect() == []


def as_unigram(path, change=lambda m: None):
    """The public pieces as a unigram model with log probabilities that aren't
    whole numbers (from the ranks), in a file of its own."""
    m = proto.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == p.NORMAL:
            p.score = -2.37 - np.log1p(i) - 0.61 * (len(p.piece) == 1)
    change(m)
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_table_documents_on_a_unigram_file_equal_the_library(spark, tmp_path):
    """Counts, ids and three best scores of all documents, real scores kept."""
    path = as_unigram(str(tmp_path / "unigram.model"))
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 12000").orderBy("doc_id").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows).repartition(4)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs, model=path).collect()}
    found = {r.doc_id: r.segmentations for r in encode(docs, n_best=3, model=path).collect()}
    scores = {i: s for _, i, s in load(path).pieces}
    assert len(rows) > 900
    same = 0
    total = lambda ids: sum(scores.get(i, 0) for i in ids)  # noqa: E731  bytes of unknown characters are the same in both
    for r in rows:
        want, own = library.encode(r.text), found[r.doc_id]
        assert counts[r.doc_id] == len(own[0].ids)
        same += own[0].ids == want
        # The library sums a whole text in single precision: where two choices differ by less than it shows, it may take the worse one.
        assert total(want) <= total(own[0].ids) + 1e-6 and total(own[0].ids) - total(want) <= 1e-6 * abs(total(want)) + 1e-6, r.doc_id
        assert [s.score for s in own] == sorted((s.score for s in own), reverse=True)
    assert same > 0.96 * len(rows)
    short = [r for r in rows if r.text.isascii() and r.text.isprintable() and len(r.text) < 900]
    for r in short:
        want = [total(ids) for ids in library.nbest_encode_as_ids(r.text, 3)]
        assert [s.score for s in found[r.doc_id]] == pytest.approx(want, abs=1e-3)
    assert len(short) > 20


def test_fractions_of_scores_decide():
    names = ["▁", "a", "b", "ab"] + [f"<0x{b:02X}>" for b in range(256)] + ["<unk>"]
    v = Vocabulary.of(names, [-1.0, -1.6, -1.7, -3.1] + [0.0] * 257, {260}, {b: 4 + b for b in range(256)}, 260)
    assert best_count(lattice(v), "ab")[1] == 1


@pytest.mark.parametrize("change", [
    lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
    lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.pieces[500], "type", 4), lambda m: setattr(m.pieces[50], "type", 5),
])
def test_unsupported_files_are_refused(tmp_path, change):
    with pytest.raises(ValueError):
        load(as_unigram(str(tmp_path / f"other-{id(change)}.model"), change))


def test_registered_queries(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lat = lattice(load())
    n = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, str(tmp_path)).collect()}
    best = {r.doc_id: r for r in op3_segmentation(spark, str(tmp_path)).collect()}
    paths = Paths(lat, 3)
    for i, t in rows:
        found = segment(paths, t)
        assert n[i] == len(found[0][1]) // 4 == best[i].n_pieces and best[i].round_trip
        assert best[i].scores == [s for s, _ in found] and best[i].ids_sha256 == [hashlib.sha256(x).hexdigest() for _, x in found]


def test_marks_inside_pieces_are_refused():
    with pytest.raises(ValueError):
        Lattice(small()._replace(pieces=(("a" + SPACE, 0, -1),)))
