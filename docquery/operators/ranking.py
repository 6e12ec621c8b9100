"""Hybrid ranking: dense score, what the question names, what the text says."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.profile import INDONESIAN_LAW, Profile
from docquery.storage import stored

RARE_SHARE = 0.05


@lru_cache(4)
def _automaton(patterns: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    """Finds all patterns in one walk over a text; a worker process keeps it."""
    built = ahocorasick.Automaton()
    for pattern, terms in patterns:
        built.add_word(pattern, terms)
    built.make_automaton()
    return built


def _one_pass(chunks: DataFrame, stated: list, key: str, text: str) -> DataFrame:
    """Matches of stated terms (qid, kind, place, weight, members)."""
    spark = chunks.sparkSession
    members: dict[str, list[int]] = {}
    for i, term in enumerate(stated):
        for m in set(term.members or ()):
            members.setdefault(m, []).append(i)
    always = frozenset(members.pop("", ()))
    sent = spark.sparkContext.broadcast(tuple((m, tuple(at)) for m, at in sorted(members.items())))
    kind = dict(chunks.dtypes)[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _automaton(sent.value).iter if sent.value else lambda _: ()
        for batch in batches:
            row, found = [], []
            for i, low in enumerate(batch.column(1)):
                terms = always.union(*{at for _, at in walk(low.as_py())})
                row += [i] * len(terms)
                found += terms
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(found, pa.int32())], [key, "term"])

    low = chunks.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("low_"))
    found = low.mapInArrow(find, f"`{key}` {kind}, term int")
    terms = [(i, t.qid, t.kind, t.place, t.weight) for i, t in enumerate(stated)]
    known = spark.createDataFrame(terms, f"term int, qid {stated[0].qkind}, kind string, place int, weight double")
    return found.join(F.broadcast(known), "term").select("qid", "kind", "place", "weight", key)


def term_matches(chunks: DataFrame, terms: DataFrame, key: str, text: str, at_once: int = 20_000) -> DataFrame:
    """(qid, kind, place, weight, key) of the chunks whose lower-case text
    contains a member of the term, written once: what is computed from them
    doesn't read the texts again.

    One automaton holds the members of all terms of all questions, so a text is
    walked once, however many there are. Of more than at_once terms the rest
    follow in further passes, each with that many, by the hash of the terms; no
    more are on the driver at once. A null text is an empty one; the empty
    member is in every text; a term without members, or an empty table, matches
    nothing; repeated rows match each.
    """
    kinds = dict(terms.dtypes)
    stated = terms.select("qid", "kind", F.col("place").cast("int").alias("place"), F.col("weight").cast("double").alias("weight"), "members", F.lit(kinds["qid"]).alias("qkind"))
    parts = max(1, -(-terms.count() // at_once)) if terms.limit(at_once + 1).count() > at_once else 1
    part = F.pmod(F.xxhash64("qid", "kind", "place"), F.lit(parts))
    passes = [_one_pass(chunks, rows, key, text) for i in range(parts) if (rows := (stated.where(part == i) if parts > 1 else stated).collect())]
    none = terms.sparkSession.createDataFrame([], f"qid {kinds['qid']}, kind string, place int, weight double, `{key}` {dict(chunks.dtypes)[key]}")
    return stored(reduce(DataFrame.unionByName, passes, none) if len(passes) != 1 else passes[0])


def document_frequencies(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, kind, place, df) of every term, 0 where nothing matches."""
    counts = matches.groupBy("qid", "kind", "place").agg(F.count("*").alias("df"))
    return terms.select("qid", "kind", "place").join(counts, ["qid", "kind", "place"], "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("long"))


def idf(df: Column, n: Column) -> Column:
    """0 if nothing or more than a twentieth matches; else half the square of
    ln(n / df) / ln n."""
    x = F.ln(n / df) / F.ln(n)
    return F.when((df == 0) | (df > RARE_SHARE * n) | (n <= 1), 0.0).otherwise(0.5 * x * x)


def phrase_weight(df: Column, n: Column) -> Column:
    return F.least(F.lit(0.7), 1.4 * idf(df, n))


def term_weights(matches: DataFrame, terms: DataFrame, n: int | Column) -> DataFrame:
    """(qid, kind, place, df, weight) where n chunks were searched. All intents
    of a question weigh as its first."""
    rows = document_frequencies(matches, terms).join(terms.select("qid", "kind", "place", F.col("weight").alias("given")), ["qid", "kind", "place"])
    first = F.first("given").over(Window.partitionBy("qid", "kind").orderBy("place"))
    size = F.lit(n).cast("double")
    weight = F.when(F.col("kind") == "group", idf(F.col("df"), size)).when(F.col("kind") == "phrase", phrase_weight(F.col("df"), size)).otherwise(first)
    return rows.select("qid", "kind", "place", "df", weight.alias("weight"))


def lexical_scores(matches: DataFrame, weights: DataFrame, key: str, compat: str = "intended") -> DataFrame:
    """(qid, key, lexical): the sum of the weights of what matches, an intent
    counted once. With compat='reference', groups and phrases count as often as
    any match, each time with the weight of the last one."""
    rows = matches.select("qid", "kind", "place", key).join(F.broadcast(weights), ["qid", "kind", "place"])
    per = rows.groupBy("qid", key, "kind").agg(F.sum("weight").alias("total"), F.count("*").alias("n"), F.max_by("weight", "place").alias("last"))
    own = F.when(F.col("kind") == "intent", F.col("last")).otherwise(F.col("total") if compat == "intended" else F.col("n") * F.col("last"))
    return per.groupBy("qid", key).agg(F.sum(own).alias("lexical"))


def metadata_boost(law: Column, year: Column, article: Column, titles: Column, old: Column, words: Column, c_law: Column, c_year: Column, c_article: Column, c_title: Column, section: Column, superseded: Column, profile: Profile = INDONESIAN_LAW) -> Column:
    """What a question names against what a chunk is (c_...): the document +0.20
    by number or +0.15 by alias; the article +0.35 in it, +0.05 in another where
    one is named, +0.30 where none is; a superseded document -0.30 unless named
    as such; the explanation -0.15 where an article is named; a word of the
    question in the title +0.08."""
    no = lambda c: F.coalesce(c, F.lit(False))
    title = F.lower(F.coalesce(c_title, F.lit("")))
    by_number = no((law == c_law) & (year.isNull() | (year == c_year)))
    by_alias = no(F.exists(titles, lambda t: F.rlike(title, t)))
    named = by_number | by_alias
    any_doc = law.isNotNull() | (F.size(titles) > 0)
    in_document = F.when(law.isNotNull() & by_number, 0.20).when(by_alias, 0.15).otherwise(0.0)
    in_article = F.when(no(article == c_article), F.when(named, 0.35).when(any_doc, 0.05).otherwise(0.30)).otherwise(0.0)
    excused = no((law == c_law) & (year == c_year)) | (no(old) & title.rlike("lama|wetboek"))
    outdated = F.when(superseded.isNotNull() & ~excused, -0.30).otherwise(0.0)
    explained = F.when(article.isNotNull() & no(F.upper(section).contains(profile.explanation)), -0.15).otherwise(0.0)
    topic = F.when(no(F.exists(words, lambda w: F.contains(title, w))), 0.08).otherwise(0.0)
    return in_document + in_article + outdated + explained + topic


def total_score(dense: Column, boost: Column, lexical: Column, explanation: Column | None = None) -> Column:
    """In single precision, as it is compared; the lexical part is halved in
    explanations, and 0 where nothing matched."""
    lexical = F.coalesce(lexical, F.lit(0.0))
    if explanation is not None:
        lexical = F.when(F.coalesce(explanation, F.lit(False)), lexical * 0.5).otherwise(lexical)
    return (dense + F.coalesce(boost, F.lit(0.0)) + lexical).cast("float")


def top_k(scored: DataFrame, k: int, score: str, *ties: str, by: str | None = "qid") -> DataFrame:
    """The k best rows (per query, unless by is None), with rank from 1."""
    if by is None:
        best = scored.orderBy(F.col(score).desc(), *ties).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), *ties)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), *ties))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
