"""Sentences, quotes and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import flatten_space, named, strip
from docquery.profile import INDONESIAN_LAW, Profile

LEAST_UNIT = 60


def sentence_units(text: Column, least: int = LEAST_UNIT) -> Column:
    """Split before numbered paragraphs, before lettered items after a stop, and
    after sentence ends; a piece shorter than least joins the unit before it,
    or goes if there is none."""
    flat = flatten_space(F.coalesce(text, F.lit("")))
    parts = F.flatten(F.transform(F.split(flat, r"(?=\(\d+\)\s)"), lambda p: F.split(p, r"(?<=[;.:?!])\s+(?=[a-z]\.\s)")))
    parts = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=[.!?])\s+(?=[\"'(\da-zA-ZÀ-Þ])")))
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")

    def joined(parts: Column) -> Column:
        starts = F.filter(F.transform(parts, lambda p, i: F.when(F.length(p) >= least, i + 1)), lambda i: i.isNotNull())
        end = lambda at, k: F.coalesce(F.try_element_at(at, k + 2), F.size(parts) + 1)
        return named(starts, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(parts, i, end(at, k) - i), " ")))

    return named(parts, joined)


def explode_units(rows: DataFrame, keys: list[str], text: str, most: int | None = None) -> DataFrame:
    """(keys, unit_no, unit): a row for every unit, however long. With most also
    long, whether the unit has more characters than that."""
    units = sentence_units(F.col(text))
    out = rows.select(*keys, F.posexplode(units).alias("unit_no", "unit"))
    return out.withColumn("long", F.length("unit") > most) if most else out


def best_units(scored: DataFrame, keys: list[str], score: str, n: int = 2) -> DataFrame:
    """The n best units of each source; of equal ones the earlier."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "unit_no"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def normative_score(unit: Column, position: Column, profile: Profile = INDONESIAN_LAW) -> Column:
    """Weights of the markers that a sentence has, less a tenth per position."""
    low = F.lower(unit)
    total = F.lit(0.0)
    for marker, weight in profile.markers:
        total = total + F.when(low.rlike(rf"\b{marker}\b"), float(weight)).otherwise(0.0)
    return total - 0.1 * position


def snippet(text: Column, most: int = 280) -> Column:
    """One line of at most most characters, cut at a word."""
    flat = flatten_space(text)
    cut = F.regexp_replace(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""), r"[,;:(\s]+$", "")
    return F.when(F.length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)


def extractive_summary(rows: DataFrame, key: str, text: str, profile: Profile = INDONESIAN_LAW, split: str = r"(?<=[.;])\s+") -> DataFrame:
    """(key, summary): the snippet of the sentence with the best normative
    score; of equal ones the first."""
    parts = rows.select(key, F.posexplode(F.split(flatten_space(F.coalesce(text, F.lit(""))), split)).alias("place", "unit"))
    scored = parts.withColumn("score", normative_score(F.col("unit"), F.col("place"), profile))
    best = scored.groupBy(key).agg(F.min_by("unit", F.struct(-F.col("score"), F.col("place"))).alias("unit"))
    return best.select(key, snippet(F.col("unit")).alias("summary"))


def fill_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing, and from new what it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def tidy_model_summary(answer: Column, least: int = 15, most: int = 600) -> Column:
    """A model's summary without its label; null if too short."""
    plain = strip(F.regexp_replace(strip(answer), r"(?i)^penjelasan\s*:\s*", ""))
    return F.when(F.length(plain) >= least, F.substring(plain, 1, most))
