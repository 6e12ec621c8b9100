import random
import re
from collections import Counter

import duckdb
import pytest

from docquery.llm.collocations import collocations, first_of_each, phrase_counts

CUT, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")
SCHEMA = "lang string, text string, phrase string, n string, bucket string"


def counted(rows, longest):
    found, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in CUT.split(lower):
            words = WORD.findall(piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    found[key] = found.get(key, 0) + 1
    return found, totals


def expected(rows, longest=3, least=10, most=2000):
    f, totals = counted(rows, longest)
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in many.items():
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if any(len(w) > len(words) and g == lang and 100 * b >= 50 * a and inside(w) for (g, w), b in many.items()):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((score, a, " ".join(words), l, r))
    rows = []
    for lang, own in out.items():
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i + 1, p, a, l, r, totals[lang], s) for i, (s, a, p, l, r) in enumerate(own[:most])]
    return sorted(rows)


def texts(seed, n=150):
    r = random.Random(seed)
    words = ["a", "B", "b", "the", "New", "York", "city", "é", "\U0001f600", "x y", "it's", "of", "-", "Ärger"]
    join = lambda: r.choice([" "] * 12 + [", ", "\n", "\t", "  ", ".", "! ", "\x0b"])
    rows = [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + join() for _ in range(r.randrange(40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, "New York city " * 12), ("de", "  ,;\n "), ("fr", "one"), ("en", "New York, New\nYork " * 15)] + [("en", "exact copy of a line")] * 30


def found(spark, rows, **given):
    df = spark.createDataFrame([(*r, "p", "n", "b") for r in rows], SCHEMA).repartition(3)
    got = first_of_each(collocations(df, **given), most=given.get("most", 2000)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_python(spark, seed):
    rows = texts(seed)
    want = expected(rows, least=4)
    assert len(want) > 50 and found(spark, rows, least=4) == want
    if seed:  # few buckets prune less, never wrongly
        assert found(spark, rows, least=4, buckets=1 << 15) == want


def test_longer_phrases_and_long_texts(spark):
    rows = texts(5, 60) + [("long", "many words in one text again " * 20_000)]
    assert found(spark, rows, longest=4, least=5) == expected(rows, 4, 5)


def test_counts_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([("en", "a b", 3_000_000_000, 4_000_000_000, 2_900_000_000)], "lang string, phrase string, l long, r long, a long")
    exact = df.selectExpr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as s")
    assert exact.collect()[0].s == 1_000_000 * 2_900_000_000**2 // (3_000_000_000 * 4_000_000_000)


def test_first_of_each_breaks_ties_by_bytes(spark):
    rows = [("en", p, 1, 5) for p in ("z", "é", "a", "\U0001f600", "￮")] + [("en", "low", 9, 4)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = first_of_each(df, most=5).orderBy("rank").collect()
    assert [r.phrase for r in got] == ["a", "z", "é", "￮", "\U0001f600"] and [r.rank for r in got] == [1, 2, 3, 4, 5]


def test_empty_table_and_wrong_settings(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert first_of_each(collocations(df)).collect() == []
    counts, totals = phrase_counts(df)
    assert counts.collect() == [] and totals.collect() == []
    with pytest.raises(ValueError):
        phrase_counts(df, buckets=1000)


def test_query_equals_its_sql(spark, tmp_path):
    from docquery.llm.oracles import COLLOCATIONS
    from docquery.llm.queries import op12_collocations

    rows = texts(9)
    spark.createDataFrame(rows, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, op12_collocations(spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(COLLOCATIONS).fetchall()) == expected(rows)
