import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.llm import language_id as li

DATA = "/root/testdata/sf0.01"
EN = "the of and to in is that was with for this from thing nothing water other house".split()
DE = "der die und das nicht ein ist zu von mit sich auch schön über wasser haus straße".split()
RU = "и в не на что он как это вода дом".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, words = rng.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(3, 60))), lang, "s"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_spans(spark):
    df = frame(spark, corpus()).repartition(5)
    out = li.held_out(df["doc_id"])
    model = li.train(df.where(~out))
    assert model.languages == ("de", "en", "ru")
    found = {r.doc_id: r for r in li.identify(df.where(out), model).collect()}
    lang = {i: x for i, _, x, _ in corpus()}
    assert len(found) > 50 and sum(lang[i] == r.lang_pred for i, r in found.items()) > 0.97 * len(found)
    mixed = " ".join(EN) + ". " + " ".join(DE) + " !!! " + " ".join(RU)
    got = li.identify(frame(spark, [(1, mixed, None, "")]), model).first()
    assert [s.lang for s in got.spans] == ["en", "de", "ru"]
    assert mixed[got.spans[1].start : got.spans[1].end] == " ".join(DE) and got.lang_pred == "de" and 0 < got.score < 1


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    texts = ["ab ba c", "", "abc", "a b c a b", "é ж a"]
    model = li.Model(("x", "y", "z"), rng.normal(-3, 2, (2**li.BITS, 3)).astype(np.float32), rng.random((len(li.NAMES), 3)) < 0.7)
    b = li.block_of(texts)
    got = li.label_words(model, b, 1.5)
    for k in range(len(texts)):
        words = np.flatnonzero(b.word_text == k)
        if not len(words):
            continue
        scores = []
        for w in words:
            own = b.word == w
            ok = model.allowed[b.script[b.word_first[w]]]
            ok = ok if ok.any() else ~ok
            scores.append(np.where(ok, model.log_prob[b.feature[own]].sum(axis=0, dtype=np.float32), -1e3 * own.sum()))
        value = lambda p: sum(s[x] for s, x in zip(scores, p)) - 1.5 * sum(a != z for a, z in zip(p, p[1:]))
        assert abs(value(got[words]) - max(map(value, itertools.product(range(3), repeat=len(words))))) < 1e-4


def test_features_don_t_depend_on_the_block():
    one = [li.block_of([t]) for t in ("Ab c", "x", "éÀ")]
    all_ = li.block_of(["Ab c", "x", "éÀ"])
    assert np.concatenate([b.feature for b in one]).tolist() == all_.feature.tolist()
    assert np.concatenate([b.place for b in one]).tolist() == all_.place.tolist()
    assert li.block_of(["ÀB"]).feature.tolist() == li.block_of(["àb"]).feature.tolist()


def test_odd_rows(spark):
    df = frame(spark, [*corpus(60), (None, "the of and", None, ""), (7, None, "en", ""), (8, "", "de", ""), (9, "123 !!", "de", ""), (9, "123 !!", "de", ""), (10, "water " * 50000, "en", "")])
    model = li.train(df)
    rows = li.identify(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.score == 0) == (r.spans == []) and 0 <= r.score <= 1
    assert sum(r.lang_pred == "und" for r in rows) == 4
    kept = li.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    none = li.train(df.limit(0))
    assert none.languages == () and {r.lang_pred for r in li.identify(df, none).collect()} == {"und"}
    assert li.identify(df.limit(0), model).collect() == [] and li.keep_identified(df, none).collect() == []


def test_long_texts_are_labelled_in_parts_as_a_whole(spark, monkeypatch):
    from docquery.llm import language_id as li

    rng = random.Random(4)
    text = " ".join(" ".join(rng.choices(rng.choice([EN, DE]), k=rng.randrange(1, 15))) + rng.choice([".", "", ", 12 "]) for _ in range(400)) + "x" * 900 + " und " + "日本" * 300
    docs = spark.createDataFrame([(" ".join(EN * 4), "en"), (" ".join(DE * 4), "de")], "text string, lang string")
    model = li.train(docs)
    whole = li.tally(model, [text], 12.0, True)
    for size in (50, 333, 2000):
        monkeypatch.setattr(li, "BLOCK_CHARS", size)
        parts = list(li._parts(text))
        assert "".join(p for _, p in parts) == text and [a for a, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
        letters, runs = li.tally(model, [text], 12.0, True)
        assert (letters == whole[0]).all() and runs == whole[1] and len(runs[0]) > 20
    monkeypatch.setattr(li, "CELLS_AT_ONCE", 40)
    assert (li.tally(model, [text], 12.0, True)[0] == whole[0]).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_registered_query_on_held_out_documents(spark, tmp_path):
    """The wiring: who is held out, that held-out labels don't matter, and the
    accuracy on them."""
    from docquery.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "lang", "text").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    got = {r.doc_id: r for r in op9_language_id(spark, DATA).collect()}
    assert {i: r.held_out for i, r in got.items()} == out
    judged = [r for r in rows if out[r.doc_id] and r.lang and any(c.isalpha() for c in r.text or "")]
    assert len(judged) > 200 and sum(got[r.doc_id].lang_pred == r.lang for r in judged) > 0.98 * len(judged)
    docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r for r in op9_language_id(spark, str(tmp_path)).collect()} == got


def test_marks_belong_to_letters_only(spark):
    model = li.train(spark.createDataFrame([(" ".join(EN), "en"), (" ".join(DE), "de")], "text string, lang string"))
    texts = ["\u0301\u0301", "\u0301 12 \u0302\n\u0301", "the\u0301 and", "\u0301the \u0302and", "the and"]
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "en", "en", "en"] and got[0].score == got[1].score == 0
    assert got[3].score == got[4].score
