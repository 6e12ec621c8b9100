"""Cleaning of page-marked texts: heads and feet that repeat over pages,
sentences broken by pages, page numbers, watermarks, misread numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import delete_all, mask_line, named, replace_matches, roman_value, strip
from docquery.profile import INDONESIAN_LAW, Profile

ZONE_LINES = 3


def split_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text", profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, page, text), page from 1. A text without marks is one page; what
    lies before the first mark is left out."""
    parts = F.split(F.coalesce(text, F.lit("")), profile.page_mark)
    pages = named(parts, lambda x: F.when(F.size(x) > 1, F.slice(x, F.lit(2), F.size(x))).otherwise(x))
    return docs.select(doc, F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def _lines(pages: DataFrame, text: str) -> DataFrame:
    """pages with lines_, the (place, mask) of those that aren't blank (at_),
    and the places at which the zone of the first and last three ends (zone_).
    Each is used more than once further on, so it is computed once per page."""
    pages = pages.withColumn("lines_", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    masked = F.transform("lines_", lambda x, i: F.struct(i.alias("i"), mask_line(x).alias("mask")))
    pages = pages.withColumn("at_", F.filter(masked, lambda x: x["mask"] != ""))
    k = F.least(F.lit(ZONE_LINES), F.size("at_"))
    ends = F.struct(F.element_at("at_", k)["i"].alias("top"), F.element_at("at_", -k)["i"].alias("bottom"))
    return pages.withColumn("zone_", F.when(k > 0, ends))


def line_frequencies(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mask, zone_pages, all_pages): on how many pages of a document a
    masked line stands in the zone, and anywhere. A page counts a mask once."""
    rows = _lines(pages, text).select(doc, "at_")
    masks = lambda c: F.array_distinct(F.transform(c, lambda x: x["mask"]))
    zone = masks(F.concat(F.slice("at_", 1, ZONE_LINES), F.slice(F.reverse("at_"), 1, ZONE_LINES)))
    once = rows.select(doc, zone.alias("zone"), F.explode(masks(F.col("at_"))).alias("mask"))
    return once.groupBy(doc, "mask").agg(F.sum(F.array_contains("zone", F.col("mask")).cast("long")).alias("zone_pages"), F.count("*").alias("all_pages"))


def repeating_masks(
    pages: DataFrame, doc: str = "doc_id", text: str = "text", zone_share: float = 0.25, zone_least: int = 4, all_share: float = 0.40, all_least: int = 6
) -> DataFrame:
    """(doc, mask) of the lines that repeat: on zone_share of the pages in the
    zone, or on all_share of the pages anywhere; at least so many pages."""
    sizes = pages.groupBy(doc).agg(F.count("*").alias("n"))
    least = lambda share, floor: F.greatest(F.lit(floor), F.floor(F.col("n") * share))
    return (
        line_frequencies(pages, doc, text).join(sizes, doc)
        .where((F.col("zone_pages") >= least(zone_share, zone_least)) | (F.col("all_pages") >= least(all_share, all_least)))
        .select(doc, "mask")
    )


def strip_repeating_lines(pages: DataFrame, masks: DataFrame, doc: str = "doc_id", text: str = "text", profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """Pages without the lines of their zone whose mask repeats. Guarded and
    blank lines stay. The masks of a document are few by their thresholds, so
    they travel as one array."""
    own = masks.groupBy(doc).agg(F.collect_set("mask").alias("masks_"))
    rows = _lines(pages, text).join(own, doc, "left")
    inside = lambda i: (i <= F.col("zone_.top")) | (i >= F.col("zone_.bottom"))
    gone = lambda x, i: inside(i) & F.array_contains("masks_", mask_line(x)) & ~x.rlike(profile.guard)
    kept = F.filter("lines_", lambda x, i: (strip(x) == "") | ~F.coalesce(gone(x, i), F.lit(False)))
    text_ = F.when(F.col("masks_").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn(text, text_).drop("masks_", "lines_", "at_", "zone_")


def merge_continuations(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, text): pages joined in order, by a space where a sentence goes on
    and by a line break elsewhere. Blank pages are passed over."""
    order = Window.partitionBy(doc).orderBy(page)
    body = pages.select(doc, page, strip(F.col(text)).alias("body")).where("body <> ''")
    first, last = strip(F.substring_index("body", "\n", 1)), strip(F.substring_index("body", "\n", -1))
    hangs = ~last.rlike(profile.sentence_end) & ~last.rlike(profile.bare_mark)
    goes_on = F.coalesce(F.lag(hangs).over(order), F.lit(False)) & first.rlike(profile.continued) & ~first.rlike(profile.mark_line)
    gap = F.when(F.row_number().over(order) == 1, "").when(goes_on, " ").otherwise("\n")
    joined = body.withColumn("part", F.concat(gap, "body")).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "part"))).alias("parts"))
    return joined.select(doc, F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def rejoin_marks(c: Column) -> Column:
    """Marks and their numbers that a page break has put on two lines."""
    c = F.regexp_replace(c, r"(?m)^\s*Pasal\s*\n\s*(\d+[A-Za-z]?)\s*\n", "Pasal $1\n")
    c = F.regexp_replace(c, r"(?m)^\s*Ayat\s*\n\s*\((\d+[a-z]?)\)", "Ayat ($1)")
    return F.regexp_replace(c, r"(?m)^\s*(BAB|Bagian|Paragraf)\s*\n\s*([IVXLC0-9]+)\s*\n", "$1 $2\n")


def strip_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s*-?\s*\d+\s*-?\s*$", "")


def _any(patterns: tuple[str, ...]) -> str:
    """Matches where one of the patterns does: a text is walked once to see
    whether it has any of them. What they share, the start of a line, is looked
    for once."""
    lead = re.compile(r"\(\?m(s?)\)\^")
    if all(lead.match(p) for p in patterns):
        return "(?m)^(?:" + "|".join(f"(?{m[1]}:{p[m.end():]})" for p in patterns if (m := lead.match(p))) + ")"
    return "|".join(f"(?:{p})" for p in patterns)


def strip_headers(c: Column, profile: Profile = INDONESIAN_LAW) -> Column:
    return named(c, lambda x: F.when(x.rlike(_any(profile.headers)), delete_all(x, profile.headers)).otherwise(x)) if profile.headers else c


def strip_watermarks(c: Column, profile: Profile = INDONESIAN_LAW) -> Column:
    return delete_all(c, profile.watermarks)


def fix_marks(c: Column) -> Column:
    """Misread mark words, and the space that misses after one."""
    c = F.regexp_replace(c, r"\bPasa[1l]\b|\bPasaI\b", "Pasal")
    c = F.regexp_replace(c, r"\bAya[7t]\b", "Ayat")
    c = F.regexp_replace(c, r"dan/atau{2,}", "dan/atau")
    return F.regexp_replace(c, r"\bPasal(?=\d)", "Pasal ")


_NUMBER = r"\bPasal\s+[0-9OolLISB|]+(?:\s+[0-9OolLISB|]+)?[A-Za-z]?(?=\s|$)"


def fix_numbers(c: Column, intended: bool = True) -> Column:
    """Article numbers with letters for digits (`22O`), or in two pieces. With
    intended, a Roman numeral stays one; without, its I and L become digits."""

    def fixed(match: Column) -> Column:
        token = F.regexp_replace(F.regexp_replace(match, r"^Pasal\s+", ""), r"\s+", "")
        digits = F.translate(token, "OolLISB|", "00111581")
        good = digits.rlike(r"^\d+[A-Za-z]?$")
        if intended:
            good = good & ~token.rlike(r"^[IVXLCDM]{2,7}$")
        return F.when(good, F.concat(F.lit("Pasal "), digits)).otherwise(match)

    return replace_matches(c, _NUMBER, fixed)


def fix_romans(c: Column) -> Column:
    """Article numbers in Roman numerals become Arabic."""

    def fixed(match: Column) -> Column:
        value = roman_value(F.regexp_extract(match, r"([IVXLCDM]+)$", 1))
        return F.when(value.isNull(), match).otherwise(F.concat(F.regexp_extract(match, r"^(Pasal\s+)", 1), value.cast("string")))

    return replace_matches(c, r"\bPasal\s+[IVXLCDM]{1,7}\b", fixed)


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_text(c: Column, profile: Profile = INDONESIAN_LAW, intended: bool = True) -> Column:
    """All steps on one text, in their order."""
    c = strip_watermarks(strip_headers(strip_page_numbers(rejoin_marks(c)), profile), profile)
    return normalize_whitespace(fix_romans(fix_numbers(fix_marks(c), intended)))


def clean_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", profile: Profile = INDONESIAN_LAW, intended: bool = True) -> DataFrame:
    """(doc, text) of page-marked documents. From four pages on, repeating
    lines go and continuations are joined; below, the marks are just deleted."""
    marks = F.size(F.split(F.coalesce(text, F.lit("")), profile.page_mark)) - 1
    many = docs.where(marks >= 4)
    pages = split_pages(many, doc, text, profile)
    merged = merge_continuations(strip_repeating_lines(pages, repeating_masks(pages, doc), doc, "text", profile), doc, "page", "text", profile)
    few = docs.where(F.coalesce(marks < 4, F.lit(True))).select(doc, F.regexp_replace(F.coalesce(text, F.lit("")), profile.page_mark, "").alias("text"))
    whole = many.select(doc).join(merged, doc, "left").select(doc, F.coalesce("text", F.lit("")).alias("text"))
    return whole.unionByName(few).withColumn("text", clean_text(F.col("text"), profile, intended))
