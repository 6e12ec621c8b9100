"""A dictionary of stems that knows inflected words by affix rules.

A rule says what an affix adds, what the stem loses for it and how the stem must
look. Words aren't made from stems, which has no end; affixes are taken off the
tokens, by joins on the letters that rules add, and what is left is looked up.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators.ocr import beside, edit_one, unknown_tokens
from docquery.profile import GLYPHS


class Affix(NamedTuple):
    flag: str  # stems say which flags they take
    kind: str  # prefix or suffix
    strip: str  # letters the stem loses
    add: str  # letters that come instead
    condition: str = ""  # pattern of the stem


def _nasal(flag: str, stem: str) -> tuple[Affix, ...]:
    """A prefix whose nasal follows the first letter, or takes its place."""
    plain = (("", "[lmnrwy]"), ("m", "[bfv]"), ("n", "[cdjz]"), ("ng", "[aeioughq]"))
    lost = (("m", "p"), ("n", "t"), ("ng", "k"), ("ny", "s"))
    return (*(Affix(flag, "prefix", "", stem + n, f"^{c}") for n, c in plain), *(Affix(flag, "prefix", c, stem + n, f"^{c}[aeiou]") for n, c in lost))


#: Affixes of Indonesian: verbs (V), nouns (N), what any word takes (A).
INDONESIAN = (
    *_nasal("V", "me"), *_nasal("N", "pe"), Affix("V", "prefix", "", "ber", "^[^r]"), Affix("V", "prefix", "", "be", "^r"), Affix("V", "prefix", "", "di"),
    Affix("V", "prefix", "", "ter", "^[^r]"), Affix("V", "prefix", "", "te", "^r"), Affix("V", "prefix", "", "per", "^[^r]"), Affix("N", "prefix", "", "ke"), Affix("A", "prefix", "", "se"),
    Affix("V", "suffix", "", "kan"), Affix("V", "suffix", "", "i", "[^i]$"), Affix("N", "suffix", "", "an"), *(Affix("A", "suffix", "", x) for x in ("nya", "lah", "kah", "pun", "ku", "mu")),
)

_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def rules_frame(spark: SparkSession, rules: tuple[Affix, ...]) -> DataFrame:
    return spark.createDataFrame(list(rules), "flag string, kind string, strip string, `add` string, condition string")


def _taken_off(words: DataFrame, rules: tuple[Affix, ...], kind: str) -> DataFrame:
    """(token, stem, needs) of words (token, stem, needs) without one affix, of
    which two letters or more stay besides what the affix took the place of."""
    own = [r for r in rules if r.kind == kind and r.add]
    if not own:
        return words.limit(0)
    sizes = F.array(*map(F.lit, sorted({len(r.add) for r in own})))
    long = F.length("stem")
    cut = words.withColumn("size", F.explode(F.filter(sizes, lambda n: long - n >= 2)))
    left, right = F.substring("stem", F.lit(1), F.col("size")), F.substring("stem", long - F.col("size") + 1, F.col("size"))
    rest = F.substring("stem", F.col("size") + 1, long) if kind == "prefix" else F.substring("stem", F.lit(1), long - F.col("size"))
    cut = cut.select("token", "needs", (left if kind == "prefix" else right).alias("add"), rest.alias("rest"))
    found = cut.join(rules_frame(words.sparkSession, tuple(own)), "add")
    stem = F.concat("strip", "rest") if kind == "prefix" else F.concat("rest", "strip")
    found = found.select("token", stem.alias("stem"), F.array_append("needs", F.col("flag")).alias("needs"), "condition")
    return found.where(F.rlike("stem", F.col("condition"))).drop("condition")


def stripped(tokens: DataFrame, rules: tuple[Affix, ...]) -> DataFrame:
    """(token, stem, needs): the lower-cased token, and it without a suffix,
    without a prefix, without both; needs lists the flags a stem must take."""
    whole = tokens.select("token", F.lower("token").alias("stem"), F.expr("cast(array() as array<string>)").alias("needs"))
    shorter = whole.unionByName(_taken_off(whole, rules, "suffix"))
    return shorter.unionByName(_taken_off(shorter, rules, "prefix"))


def inflected(tokens: DataFrame, stems: DataFrame, rules: tuple[Affix, ...] = INDONESIAN) -> DataFrame:
    """(token, stem): the stem from which rules make the token, with the flags
    they need; of several the longest, then the first in order.

    tokens: (token), distinct ones are looked up once. stems: (word, flags) in
    lower case; repeated words pool nothing, each is tried. Null tokens, words
    and flags match nothing; empty tables give an empty result.
    """
    tried = stripped(tokens.where("token IS NOT NULL").select("token").distinct(), rules)
    known = tried.join(beside(stems.select(F.col("word").alias("stem"), "flags")), "stem").where(F.size(F.array_except("needs", "flags")) == 0)
    return known.groupBy("token").agg(F.min(F.struct((-F.length("stem")).alias("size"), "stem")).alias("best")).select("token", "best.stem")


def unknown_inflected(tokens: DataFrame, stems: DataFrame, rules: tuple[Affix, ...] = INDONESIAN, terms: DataFrame | None = None) -> DataFrame:
    """unknown_tokens for a dictionary of stems: tokens that are neither known as
    they are nor made from a stem."""
    plain = unknown_tokens(tokens, stems.select("word"), terms)
    return plain.join(beside(inflected(plain, stems, rules).select("token")), "token", "left_anti")


def typing_costs(near: float = 0.4, alike: float = 0.3) -> list[tuple[str, str, float]]:
    """(written, meant, cost): letters beside each other on a keyboard, and
    glyphs of the profile's table that are read for another. All other changes
    cost 1."""
    place = {c: (x + y / 2, y) for y, row in enumerate(_KEYS) for x, c in enumerate(row)}
    costs = {(a, b): near for a, (x, y) in place.items() for b, (u, w) in place.items() if a != b and abs(x - u) <= 1 and abs(y - w) <= 1}
    costs |= {(a, b): alike for a, meant in GLYPHS.items() for b in meant}
    return [(a, b, c) for (a, b), c in sorted(costs.items())]


def weighted_edit_one(words: DataFrame, dictionary: DataFrame, costs: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(token, suggestion, cost) of all dictionary words at edit distance one:
    what the change costs that makes the token the word. A letter left out or
    put in has an empty counterpart in the table of costs."""
    table = words.sparkSession.createDataFrame(typing_costs() if costs is None else costs, "written string, meant string, cost double")
    low = F.lower("token")
    pairs = edit_one(words, dictionary).withColumn("low", low)
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("low"), F.length("suggestion"))), lambda k: F.substring("low", F.lit(1), k) == F.substring("suggestion", F.lit(1), k)))
    pairs = pairs.withColumn("same", same).withColumn("longer", F.length("low") - F.length("suggestion"))
    at = lambda c: F.substring(c, F.col("same") + 1, F.lit(1))
    pairs = pairs.withColumn("written", F.when(F.col("longer") >= 0, at("low")).otherwise("")).withColumn("meant", F.when(F.col("longer") <= 0, at("suggestion")).otherwise(""))
    return pairs.join(F.broadcast(table), ["written", "meant"], "left").select("token", "suggestion", F.coalesce("cost", F.lit(1.0)).alias("cost"))


def likeliest_edit_one(words: DataFrame, dictionary: DataFrame, costs: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(token, fix, cost) where one word costs less than all others at edit
    distance one."""
    tried = weighted_edit_one(words, dictionary, costs).groupBy("token").agg(F.min("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("cost", "suggestion"))).alias("all"))
    return tried.where((F.size("all") == 1) | (F.col("all")[1]["cost"] > F.col("cost"))).select("token", F.col("all")[0]["suggestion"].alias("fix"), "cost")
