"""Affix rules and weighted suggestions, by hand and against plain Python."""

import random
import re

import pytest

from docquery.operators import affixes as a

STEMS = [("tulis", ["V", "N", "A"]), ("pukul", ["V"]), ("kirim", ["V", "N", "A"]), ("sapu", ["V", "N"]), ("ajar", ["V", "N", "A"]), ("buku", ["A"]), ("kerja", ["V", "N"]), ("baca", None), (None, ["V"])]


@pytest.fixture(scope="module")
def stems(spark):
    return spark.createDataFrame(STEMS, "word string, flags array<string>")


def tokens(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "token string, flags int")


def plain(token, stems, rules):
    """Every way of taking a suffix, then a prefix, off."""
    tried = [(token.lower(), [])]
    for kind in ("suffix", "prefix"):
        for stem, needs in list(tried):
            for r in rules:
                if r.kind != kind or not r.add or len(stem) - len(r.add) < 2:
                    continue
                if kind == "suffix" and stem.endswith(r.add):
                    left = stem[: -len(r.add)] + r.strip
                elif kind == "prefix" and stem.startswith(r.add):
                    left = r.strip + stem[len(r.add) :]
                else:
                    continue
                if re.search(r.condition, left):
                    tried.append((left, [*needs, r.flag]))
    good = [s for s, needs in tried for w, flags in stems if w == s and flags is not None and set(needs) <= set(flags)]
    return min(good, key=lambda s: (-len(s), s), default=None)


def test_inflected_words_lead_to_their_stems(spark, stems):
    words = ["menulis", "Penulisnya", "memukul", "dipukulkan", "mengirimkan", "pengiriman", "menyapu", "belajar", "pelajaran", "bukunya", "membuku", "bekerja", "sebukulah", "tulis", "menulis", None, "xyz", "dibaca", "di", ""]
    got = {r.token: r.stem for r in a.inflected(tokens(spark, *words), stems).collect()}
    assert got == {w: s for w in words if w is not None and (s := plain(w, STEMS, a.INDONESIAN))}
    assert got["menulis"] == got["Penulisnya"] == "tulis" and got["mengirimkan"] == "kirim" and got["menyapu"] == "sapu" and "membuku" not in got
    assert got["bukunya"] == "buku" and "dibaca" not in got


def test_random_words_against_plain_python(spark):
    r = random.Random(5)
    rules = (a.Affix("S", "suffix", "", "ab"), a.Affix("S", "suffix", "b", "a", "b$"), a.Affix("P", "prefix", "", "ba", "^[^b]"), a.Affix("P", "prefix", "a", "bb", "^a"), a.Affix("Q", "prefix", "", "a"))
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    own = [(word(r.randrange(2, 6)), r.sample("SPQ", r.randrange(4))) for _ in range(40)]
    words = sorted({word(r.randrange(1, 9)) for _ in range(300)})
    got = {x.token: x.stem for x in a.inflected(tokens(spark, *words), spark.createDataFrame(own, "word string, flags array<string>"), rules).collect()}
    assert got == {w: s for w in words if (s := plain(w, own, rules))} and len(got) > 50


def test_unknown_tokens_of_a_dictionary_of_stems(spark, stems):
    left = a.unknown_inflected(tokens(spark, "menulis", "Buku", "asing", "xiv", "istilah"), stems, terms=spark.createDataFrame([("istilah",)], "word string"))
    assert [r.token for r in left.collect()] == ["asing"]


def test_suggestions_weigh_slips_of_the_keyboard(spark):
    words = spark.createDataFrame([("tulid",), ("Kerjz",), ("bukuu",), ("ajr",), ("sap",), ("pukvl",), ("zzzz",), ("xatu",)], "token string")
    known = spark.createDataFrame([(w,) for w in ("tulis", "tulip", "kerja", "kerjo", "buku", "ajar", "sapu", "sapi", "pukul", "satu", "batu")], "word string")
    cost = {(r.token, r.suggestion): r.cost for r in a.weighted_edit_one(words, known).collect()}
    assert cost[("tulid", "tulis")] == 0.4 and cost[("tulid", "tulip")] == 1 and cost[("bukuu", "buku")] == cost[("ajr", "ajar")] == 1
    best = {r.token: (r.fix, r.cost) for r in a.likeliest_edit_one(words, known).collect()}
    assert best["tulid"] == ("tulis", 0.4) and best["Kerjz"] == ("kerja", 0.4) and "sap" not in best and "zzzz" not in best
    assert best["xatu"] == ("satu", 0.4) and best["pukvl"] == ("pukul", 1.0)
    own = {r.token: r.fix for r in a.likeliest_edit_one(words, known, [("", "i", 0.1)]).collect()}
    assert own["sap"] == "sapi"


def test_empty_tables(spark, stems):
    none = tokens(spark).limit(0)
    assert a.inflected(none, stems).collect() == [] and a.inflected(tokens(spark, "menulis"), stems.limit(0)).collect() == []
    assert a.inflected(tokens(spark, "tulis", "menulis"), stems, ()).collect()[0].token == "tulis"
    assert a.likeliest_edit_one(none, stems.select("word")).collect() == []
