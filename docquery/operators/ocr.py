"""Correction of misread words against a dictionary.

Words are corrected once each, not once per place: the distinct unknown tokens
get candidates by joins with the dictionary (word), and the few corrections go
back to the documents.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.text import replace_matches
from docquery.profile import CAPITAL, GLYPHS, PAIRS, PLAIN, ROMAN, SPLIT_HEAD, SPLIT_TAIL, TOKEN
from docquery.storage import stored
from docquery.words import CURATED, TERMS


def tokens_of(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, times): distinct tokens as written."""
    return docs.select(F.explode(tokens_of(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))


def beside(rows: DataFrame) -> DataFrame:
    """One side of a join that grows with the vocabulary: both are sorted by
    their words, and none is sent whole through the driver, however small its
    files look. Several such joins run at once."""
    return rows.hint("merge")


def unknown_tokens(tokens: DataFrame, dictionary: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """tokens that no form (lower case, as written, capitalised) nor a special
    term knows and that aren't Roman numerals."""
    known = dictionary.select(F.col("word").alias("form"))
    if terms is not None:
        known = known.unionByName(terms.select(F.col("word").alias("form")))
    known = known.distinct()
    forms = F.array_distinct(F.array(F.lower("token"), F.col("token"), F.initcap("token")))
    recognised = tokens.select("token", F.explode(forms).alias("form")).join(beside(known), "form", "left_semi").select("token").distinct()
    return tokens.where(~F.lower("token").rlike(ROMAN)).join(beside(recognised), "token", "left_anti")


def correctable(tokens: DataFrame) -> DataFrame:
    """Of three letters or more, not all capitals, plain or capitalised."""
    return tokens.where((F.length("token") >= 3) & (F.upper("token") != F.col("token")) & (F.col("token").rlike(PLAIN) | F.col("token").rlike(CAPITAL)))


def _deletions(c: Column) -> Column:
    """The word itself and it without each one of its letters: words at edit
    distance one share at least one of these."""
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))), c))


def edit_one(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, suggestion): all dictionary words at edit distance one from the
    lower-cased token. Joined on deletion forms, so that neither side is
    compared with all of the other."""
    left = words.where(F.length("token") > 0).select("token", F.explode(_deletions(F.lower("token"))).alias("form"))
    right = dictionary.where(F.length("word") > 0).select(F.col("word").alias("suggestion"), F.explode(_deletions(F.col("word"))).alias("form"))
    return left.join(beside(right), "form").where(F.levenshtein(F.lower("token"), F.col("suggestion")) == 1).select("token", "suggestion").distinct()


def unique_edit_one(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, fix) where exactly one word is at distance one."""
    return edit_one(words, dictionary).groupBy("token").agg(F.count("*").alias("n"), F.min("suggestion").alias("fix")).where("n = 1").select("token", "fix")


def mirrored(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, fix) where a token of four letters or more is a word backwards."""
    back = words.where(F.length("token") >= 4).select("token", F.reverse(F.lower("token")).alias("word"))
    return back.join(beside(dictionary.select("word").distinct()), "word", "left_semi").select("token", F.col("word").alias("fix"))


def substituted(words: DataFrame, dictionary: DataFrame, pairs: dict[str, list[str]] = PAIRS) -> DataFrame:
    """(token, fix): the first known word that replacing one misread pair gives,
    by place, then by the order of pairs."""
    low = F.lower("token")
    flat = [(a, b) for a, bs in pairs.items() for b in bs]
    tries = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(flat)))).alias("p")
    rows = words.where((F.length("token") >= 5) & low.rlike("|".join(re.escape(a) for a in pairs))).select("token", tries).select("token", "p.*")
    rows = rows.where(F.contains(low, F.col("a")))
    rows = rows.withColumn("place", F.explode(F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, F.length("a")) == F.col("a"))))
    made = F.concat(F.substring(low, F.lit(1), F.col("place") - 1), F.col("b"), F.substring(low, F.col("place") + F.length("a"), F.length(low)))
    known = rows.withColumn("word", made).join(beside(dictionary.select("word").distinct()), "word", "left_semi")
    return known.groupBy("token").agg(F.min_by("word", F.struct("place", "pair")).alias("fix"))


def split_merged(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, fix): a token of nine letters or more as two known words of four
    letters or more; the first such place."""
    low, known = F.lower("token"), dictionary.select("word").distinct()
    cuts = words.where(F.length("token") >= 9).select("token", F.explode(F.sequence(F.lit(4), F.length("token") - 4)).alias("cut"))
    cuts = cuts.withColumn("left", F.substring(low, F.lit(1), F.col("cut"))).withColumn("right", F.substring(low, F.col("cut") + 1, F.length(low)))
    both = cuts.join(beside(known.withColumnRenamed("word", "left")), "left", "left_semi").join(beside(known.withColumnRenamed("word", "right")), "right", "left_semi")
    return both.groupBy("token").agg(F.min_by(F.concat_ws(" ", "left", "right"), "cut").alias("fix"))


def match_case(token: Column, fix: Column) -> Column:
    first = F.concat(F.upper(F.substring(fix, 1, 1)), F.lower(F.substring(fix, F.lit(2), F.length(fix))))
    start = F.substring(token, 1, 1)
    return F.when((F.upper(token) == token) & (F.lower(token) != token), F.upper(fix)).when((F.upper(start) == start) & (F.lower(start) != start), first).otherwise(fix)


def curated_words(spark: SparkSession) -> DataFrame:
    """(word, fix) of the profile's list of misread words."""
    return spark.createDataFrame(list(CURATED.items()), "word string, fix string")


def special_terms(spark: SparkSession) -> DataFrame:
    """(word) of sound words that a general dictionary lacks."""
    return spark.createDataFrame([(w,) for w in TERMS], "word string")


def corrections(tokens: DataFrame, dictionary: DataFrame, curated: DataFrame | None = None, terms: DataFrame | None = None, fix_glyphs: bool = False) -> DataFrame:
    """(token, fix) of unknown tokens by priority: curated (word, fix), for any
    form of three letters or more; mirrored; the only word at edit distance one;
    misread pairs; merged words. Tokens under five letters stop after mirrored.
    fix_glyphs adds single glyphs before the pairs. What each step starts from
    is written once."""
    dictionary = stored(dictionary.select("word").distinct())
    unknown = stored(unknown_tokens(tokens.select("token").distinct(), dictionary, terms))
    words = correctable(unknown)
    long = words.where(F.length("token") >= 5)
    known = dictionary if terms is None else dictionary.unionByName(terms.select("word"))
    steps = [mirrored(words, known), unique_edit_one(long, dictionary), substituted(long, known), split_merged(long, known)]
    if fix_glyphs:
        steps.insert(2, substituted(unknown, known, GLYPHS))
    if curated is not None:
        low = unknown.where(F.length("token") >= 3).select("token", F.lower("token").alias("low"))
        steps.insert(0, low.join(curated.select(F.col("word").alias("low"), "fix"), "low").select("token", "fix"))
    ranked = reduce(DataFrame.unionByName, (s.withColumn("rank", F.lit(k)) for k, s in enumerate(steps)))
    best = ranked.groupBy("token").agg(F.min_by("fix", "rank").alias("fix"))
    return best.withColumn("fix", match_case(F.col("token"), F.col("fix"))).where("fix <> token")


def apply_corrections(docs: DataFrame, fixes: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the tokens of text replaced. A document's own corrections
    travel to it as one map, bounded by its distinct tokens."""
    own = docs.select(doc, F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token")).join(beside(fixes), "token")
    maps = own.groupBy(doc).agg(F.map_from_entries(F.collect_set(F.struct("token", "fix"))).alias("fixes_"))
    marked = F.split(F.regexp_replace(F.translate(text, "\u0001", ""), f"({TOKEN})", "\u0001$1\u0001"), "\u0001")
    put = F.array_join(F.transform(marked, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at("fixes_", p), p)).otherwise(p)), "")
    return docs.join(beside(maps), doc, "left").withColumn(text, F.when(F.col("fixes_").isNotNull(), put).otherwise(F.col(text))).drop("fixes_")


def _rejoined(docs: DataFrame, known: DataFrame, doc: str, text: str, pattern: str, piece: int) -> DataFrame:
    """docs with the matches of one pattern joined where that makes a known word
    of an unknown piece (the group so numbered)."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))
    own = docs.select(doc, F.explode(found).alias("pair"))
    own = own.withColumn("word", F.lower(F.regexp_replace("pair", r"(?U)\s+", "")))
    parts = F.split("pair", r"(?U)\s+")
    own = own.withColumn("piece", F.lower(F.element_at(parts, 2 if piece == 2 else 1)))
    good = own.join(beside(known), "word", "left_semi").join(beside(known.withColumnRenamed("word", "piece")), "piece", "left_anti")
    lists = good.groupBy(doc).agg(F.collect_set("pair").alias("pairs_"))
    joined = replace_matches(F.col(text), pattern, lambda m: F.when(F.array_contains("pairs_", m), F.regexp_replace(m, r"(?U)\s+", "")).otherwise(m))
    return docs.join(beside(lists), doc, "left").withColumn(text, F.when(F.col("pairs_").isNotNull(), joined).otherwise(F.col(text))).drop("pairs_")


def rejoin_letters(docs: DataFrame, dictionary: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Joins a single letter with the unknown word beside it where the two make
    a known word: letters before words, then behind them, and again until no
    text changes. Only texts that changed go on to the next round; a round joins
    one letter of a text at least, so there is an end."""
    known = stored(dictionary.select("word").distinct())
    open_ = docs
    done: list[DataFrame] = []
    while True:
        new = _rejoined(_rejoined(open_.withColumn("before_", F.col(text)), known, doc, text, SPLIT_HEAD, 2), known, doc, text, SPLIT_TAIL, 1)
        new = stored(new)
        changed = ~F.col("before_").eqNullSafe(F.col(text))
        done.append(new.where(~changed).drop("before_"))
        open_ = new.where(changed).drop("before_")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
