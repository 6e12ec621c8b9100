"""Tables of questions and the automaton of their terms against plain Python."""

import random

import pytest

from docquery.operators import questions, ranking
from docquery.profile import GENERIC, INDONESIAN_LAW

ASKED = [
    "Apa sanksi Pasal 33A UU No. 31 Tahun 1999 tentang korupsi?", "kuhp lama", "", None, "bersetubuh sesama jenis gay perbuatannya memukul pengiriman",
    "who rents a thing in source zero near water", "a_b c--d, mengirim penulis tulisannya penyuapan; kekerasan seksual anak 12 dihukum penjara!", "  ",
    "Undang-Undang nomor 1 tahun 2023 lesbian lgbt phk tahan bilamana", "é́ ÉCOLE straße 東京 pengajuannya\nmemperkosa\tdiperbolehkan", "kerja " * 3000,
    "menyuap menyuap hukuman hukuman", "uu 5 pasal 7", "waris tanah-tanah pajak_kendaraan wvs 1946",
]


@pytest.mark.parametrize("profile", [INDONESIAN_LAW, GENERIC])
def test_parse_equals_plain_python(spark, profile):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ASKED)], "n int, t string, qid string, words int")
    asked, terms = questions.parse(df, profile, "n", "t")
    found = {}
    for r in terms.collect():
        found.setdefault((r.qid, r.kind), {})[r.place] = (tuple(r.members), r.weight)
    rows = asked.collect()
    assert len(rows) == len(ASKED)
    for r in rows:
        p = questions.parse_question(ASKED[r.qid] or "", profile)
        assert (r.article, r.law, r.year, tuple(r.titles), r.old, tuple(r.words)) == (p.article, p.law, p.year, p.titles, p.old, p.words)
        of = lambda kind: [found.get((r.qid, kind), {})[i] for i in range(len(found.get((r.qid, kind), {})))]  # noqa: E731, B023
        assert [m for m, _ in of("group")] == list(p.groups)
        assert [m for m, _ in of("phrase")] == [(x,) for x in p.phrases]
        assert of("intent") == [(tuple(profile.intents[i][1]), profile.intents[i][2]) for i in p.intents]


def test_parse_of_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "water thing")] * 2, "qid long, text string")
    asked, terms = questions.parse(df, GENERIC)
    assert asked.count() == 2 and terms.where("kind = 'phrase'").count() == 2
    asked, terms = questions.parse(df.limit(0), GENERIC)
    assert asked.collect() == terms.collect() == []


def brute(texts, terms):
    found = [(q, kind, place, key) for key, text in texts for q, kind, place, members, _ in terms if any(m in (text or "").lower() for m in members or ())]
    return sorted(found, key=repr)


TERMS = "qid int, kind string, place int, members array<string>, weight double"


@pytest.mark.parametrize("at_once", [20_000, 3])
def test_matches_equal_plain_python(spark, at_once):
    texts = [(1, "Ab abc é"), (2, None), (3, ""), (4, "xabcx " * 60_000), (None, "bc É"), (1, "Ab abc é")]
    terms = [
        (1, "group", 0, ["abc", "zz"], None), (1, "group", 1, ["b", "abc", "b"], None), (1, "phrase", 0, ["c é"], None), (2, "group", 0, ["é"], None),
        (2, "intent", 0, [""], 0.5), (3, "group", 0, [], None), (3, "group", 1, None, None), (4, "group", 0, ["nowhere"], None),
    ]
    chunks = spark.createDataFrame([(k, t, "c", 1) for k, t in texts], "k int, text string, kind string, term int").repartition(3)
    found = ranking.term_matches(chunks, spark.createDataFrame(terms, TERMS), "k", "text", at_once)
    assert sorted(((r.qid, r.kind, r.place, r.k) for r in found.collect()), key=repr) == brute(texts, terms)


def test_ten_thousand_terms_in_one_pass(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(3, 7)))
    texts = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    terms = [(i // 20, "group", i % 20, [word() for _ in range(2)], None) for i in range(10_000)]
    found = ranking.term_matches(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(terms, TERMS), "k", "text")
    assert sorted(((x.qid, x.kind, x.place, x.k) for x in found.collect()), key=repr) == brute(texts, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan  # written once


def test_no_terms_no_texts(spark):
    chunks = spark.createDataFrame([(1, "text")], "k int, text string")
    none = spark.createDataFrame([], TERMS)
    assert ranking.term_matches(chunks, none, "k", "text").collect() == []
    one = spark.createDataFrame([(1, "group", 0, ["text"], None)], TERMS)
    assert ranking.term_matches(chunks.limit(0), one, "k", "text").collect() == []
    assert [r.df for r in ranking.document_frequencies(ranking.term_matches(chunks.limit(0), one, "k", "text"), one).collect()] == [0]
