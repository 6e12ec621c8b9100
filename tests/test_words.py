"""Word correction."""

import random

from docquery.operators import ocr


def frame(spark, words, name="token"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


DICTIONARY = ["yang", "dimaksud", "cukup", "jelas", "dalam", "hukum", "orang", "malam", "dengan", "dekat"]


def test_candidates(spark):
    d = frame(spark, DICTIONARY, "word")
    got = lambda df: {r.token: r.fix for r in df.collect()}
    assert got(ocr.mirrored(frame(spark, ["gnay", "abc", "mukuh"]), d)) == {"gnay": "yang", "mukuh": "hukum"}
    assert got(ocr.unique_edit_one(frame(spark, ["hukun", "dalam", "xalam", "orangg"]), d)) == {"hukun": "hukum", "orangg": "orang"} | {"dalam": "malam"}
    assert got(ocr.substituted(frame(spark, ["dirnaksud", "clalam"]), d)) == {"dirnaksud": "dimaksud", "clalam": "dalam"}
    assert got(ocr.split_merged(frame(spark, ["cukupjelas", "hukumorang"]), d)) == {"cukupjelas": "cukup jelas", "hukumorang": "hukum orang"}


def test_edit_one_equals_comparing_all(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(150)}
    left, right = sorted(words)[:60], sorted(words)[40:]

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    got = {(r.token, r.suggestion) for r in ocr.edit_one(frame(spark, left), frame(spark, right, "word")).collect()}
    assert got == {(a, b) for a in left for b in right if near(a, b)}


def test_unknown_and_priorities(spark):
    d = frame(spark, DICTIONARY, "word")
    tokens = frame(spark, ["Gnay", "HUKUN", "hukun", "XIV", "cukupjelas", "Dalam", "dirnaksud", "unhrk", "KppS"])
    assert {r.token for r in ocr.unknown_tokens(tokens, d).collect()} == {"Gnay", "HUKUN", "hukun", "cukupjelas", "dirnaksud", "unhrk", "KppS"}
    curated = spark.createDataFrame([("unhrk", "untuk"), ("hukun", "hukuman")], "word string, fix string")
    got = {r.token: r.fix for r in ocr.corrections(tokens, d, curated).collect()}
    assert got == {"Gnay": "Yang", "HUKUN": "HUKUMAN", "hukun": "hukuman", "cukupjelas": "cukup jelas", "dirnaksud": "dimaksud", "unhrk": "untuk"}


def test_glyphs_by_flag(spark):
    d = frame(spark, ["sarana"], "word")
    assert ocr.corrections(frame(spark, ["sar€na"]), d).count() == 0
    assert [r.fix for r in ocr.corrections(frame(spark, ["sar€na"]), d, fix_glyphs=True).collect()] == ["sarana"]


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Gnay d alam hukun, hukun!"), (2, None), (3, "")], "doc_id int, text string")
    fixes = spark.createDataFrame([("Gnay", "Yang"), ("hukun", "hukum")], "token string, fix string")
    got = {r.doc_id: r.text for r in ocr.apply_corrections(docs, fixes).collect()}
    assert got == {1: "Yang d alam hukum, hukum!", 2: None, 3: ""}
    joined = {r.doc_id: r.text for r in ocr.rejoin_letters(docs, frame(spark, DICTIONARY, "word")).collect()}
    assert joined[1] == "Gnay dalam hukun, hukun!" and joined[2] is None


def test_rejoining_goes_on_and_keeps_to_words(spark):
    d = frame(spark, ["satu", "gas", "perkara", "hukum", "pasal"], "word")
    texts = {1: "s atu gas atu x", 2: "p erkar a", 3: "huku m, x pasal", 4: "h ukum h ukum", 5: None, 6: "s-atu s atu-x", 7: "S atu\nhuku m"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r.text for r in ocr.rejoin_letters(docs, d).collect()}
    assert got == {1: "satu gas atu x", 2: "p erkar a", 3: "hukum, x pasal", 4: "hukum hukum", 5: None, 6: "s-atu s atu-x", 7: "Satu\nhukum"}
    more = frame(spark, ["erkara", "perkara"], "word")
    assert [r.text for r in ocr.rejoin_letters(docs.where("doc_id = 2"), more).collect()] == ["p erkara"]
    chain = frame(spark, ["satux", "satuxy"], "word")
    assert [r.text for r in ocr.rejoin_letters(spark.createDataFrame([(1, "s atux"), (2, "s atu x y")], "doc_id int, text string"), chain).orderBy("doc_id").collect()] == ["satux", "s atu x y"]


def test_the_lists_of_statutes(spark):
    fixes = ocr.corrections(frame(spark, ["Unhrk", "DALARN", "tersangka", "hurufa", "abc"]), frame(spark, DICTIONARY, "word"), ocr.curated_words(spark), ocr.special_terms(spark))
    assert {r.token: r.fix for r in fixes.collect()} == {"Unhrk": "Untuk", "DALARN": "DALAM", "hurufa": "huruf a"}
    assert ocr.unknown_tokens(frame(spark, ["Tersangka", "hoc"]), frame(spark, DICTIONARY, "word"), ocr.special_terms(spark)).count() == 0


def test_no_words_pass_through_the_driver(spark):
    """Joins with words broadcast neither side, small as they are here."""
    docs = spark.createDataFrame([(1, "tbe water rents"), (2, "the water")], "doc_id long, text string")
    fixed = ocr.apply_corrections(docs, ocr.corrections(ocr.vocabulary(docs), spark.createDataFrame([("the",), ("water",), ("rents",)], "word string")))
    assert [r.text for r in fixed.orderBy("doc_id").collect()] == ["tbe water rents", "the water"]
    assert "Broadcast" not in fixed._jdf.queryExecution().executedPlan().toString()
