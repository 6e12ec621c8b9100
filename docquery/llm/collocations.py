"""Phrases whose words keep company, mined with hashed buckets.

Pass k over the texts counts phrases of k words exactly and, in the same pass,
phrases of k + 1 words in hashed buckets. A phrase is counted only if all its
shorter parts may be frequent (Apriori) and its bucket is (PCY; DHP, as phrases
with a rare part don't enter the buckets either). Both tests are bitmaps of a
fixed size, which tell too much apart never too little; the exact counts decide.
Tasks turn words into numbers and count within blocks; Spark sums the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import fresh, text_blocks, written

#: Bytes of text of which the phrases are counted together in a task.
SLICE = 2_000_000
#: Words that a task knows by number before it forgets them all.
KNOWN = 300_000
#: Buckets; a bitmap has an eighth as many bytes. More buckets prune better
#: where there are more phrases (2 ** 30, 128 MB a bitmap, for tens of TB).
BUCKETS = 1 << 24

_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SCHEMA = "lang string, phrase string, bucket bigint, n bigint"
_SALTS = 64


class Words(dict):
    """Word to number, for one language; number 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__()
        self.prefix, self.words, self.hashes = lang.encode() + b"\0", [], np.zeros(0, np.uint64)
        self[_END]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append(word)
        return k

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all pieces as numbers, each piece ended, and their hashes."""
        split = _END.join(texts).translate(_TABLE).replace(_END, b" \xff ").split()
        ids = np.fromiter(map(self.__getitem__, split), np.int64, len(split))
        new = [xxhash.xxh64_intdigest(self.prefix + w) for w in self.words[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return ids, self.hashes[ids]


def _longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last."""
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + last


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _marked(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _count(words: Words, texts: list[bytes], k: int, longest: int, buckets: int, bits: dict) -> Iterator[tuple]:
    """(phrases or None, buckets, counts): phrases of k words, then the buckets
    of phrases of k + 1. bits: by length, the bitmaps that a phrase must pass."""
    ids, hashes = words.numbers(texts)
    good, grams = ids > 0, hashes
    for j in range(1, k + 1):
        if j > 1:
            good, grams = good[:-1] & good[1:], _longer(grams[:-1], hashes[j - 1 :])
        for b in bits.get(j, ()):
            at = np.flatnonzero(good)
            good[at] = _marked(b, _bucket(grams[at], buckets))
    at = np.flatnonzero(good)
    code = ids[at]
    for j in range(1, k):
        code = np.unique(code << 32 | ids[at + j], return_inverse=True)[1].astype(np.int64)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    first = at[first]
    own = [words.words[i] for i in ids[first]] if k == 1 else [b" ".join([words.words[i] for i in row]) for row in np.stack([ids[first + j] for j in range(k)], 1).tolist()]
    yield own, _bucket(grams[first], buckets), n
    if k < longest:
        at = np.flatnonzero(good[:-1] & good[1:])
        found, n = np.unique(_bucket(_longer(grams[at], hashes[at + k]), buckets), return_counts=True)
        yield None, found, n


def _pass(texts: DataFrame, k: int, longest: int, buckets: int, bits: dict, least: int) -> DataFrame:
    """(lang, phrase, bucket, n): phrases of k words found `least` times or more;
    buckets of phrases of k + 1 words as full as that, without lang and phrase;
    in the first pass the number of words of each language, without the two."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        for block in text_blocks(batches, 1, SLICE):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(block.column(0).to_pylist(), block.column(1).cast(pa.binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                words = known.setdefault(lang, Words(lang))
                for phrases, found, n in _count(words, own, k, longest, buckets, sent.value):
                    rows = len(found)
                    langs = pa.nulls(rows, pa.string()) if phrases is None else pa.array([lang] * rows, pa.string())
                    names = pa.nulls(rows, pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs, names, pa.array(found), pa.array(n, pa.int64())], ["lang", "phrase", "bucket", "n"])
                    if phrases is not None and k == 1:
                        yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": [None], "bucket": [None], "n": [int(n.sum())]}, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))
                if len(words) > KNOWN:
                    del known[lang]

    counted = texts.mapInArrow(run, _SCHEMA).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
    return written(counted.where((F.col("n") >= least) | F.col("bucket").isNull()), f"phrases-{k}")


def _bitmap(rows: DataFrame, buckets: int) -> np.ndarray:
    """The buckets of rows as bits: at most buckets / 32,768 rows of 4,096 bytes
    come to the driver, whatever the input."""
    parts = rows.groupBy(F.expr("bucket div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(bucket % 32768)").alias("bits"))
    bits = np.zeros(max(1, buckets // 32768) * 4096, np.uint8)
    for part, own in parts.collect():
        bits[part * 4096 : part * 4096 + len(own)] = np.frombuffer(own, np.uint8)
    return bits


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n), (lang, n)): every phrase of 1 to `longest`
    words that occurs `least` times or more in its language, and the number of
    words of each language.

    Texts are lower-cased in A-Z and cut at `.,;:!?` and line breaks; words lie
    between spaces and tabs; no phrase crosses a cut. A null text has no words, a
    null language is `und`. Only the two columns are read. Repeated rows count
    each; an empty table gives empty results. `buckets` is a power of two; it
    changes what is counted in vain, never a count.
    """
    if buckets & (buckets - 1) or not 1 << 15 <= buckets <= 1 << 30:
        raise ValueError("buckets must be a power of two from 2 ** 15 to 2 ** 30")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits: dict[int, list[np.ndarray]] = {}
    passes = []
    for k in range(1, longest + 1):
        found = _pass(texts, k, longest, buckets, bits, least)
        passes.append(found.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(k).alias("words"), "n"))
        if k == 1:
            totals = found.where("bucket IS NULL").select("lang", "n")
        if k < longest:
            bits = bits | {k: [_bitmap(found.where("phrase IS NOT NULL"), buckets)], k + 1: [_bitmap(found.where("phrase IS NULL AND bucket IS NOT NULL"), buckets)]}
    return reduce(DataFrame.unionByName, passes), totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, absorbed: int = 50, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to `longest` words
    found `least` times or more that aren't part of a longer such phrase with
    `absorbed` hundredths of their occurrences.

    a, l, r count the phrase, its first part and the rest at the cut with the
    lowest score, floor(1,000,000 a a / (l r)); of equal ones the cut after the
    fewest words. n counts the words of the language. The arithmetic is decimal
    and exact up to counts of 10 ** 15. For odd rows see phrase_counts.
    """
    counts, totals = phrase_counts(docs, longest, least, buckets, lang_col, text_col)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = (
        phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    )
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = (
        cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .withColumn("above", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"))
        .withColumn("below", exact("l") * exact("r"))
        .withColumn("score", F.expr("above div below"))
    )
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (
        phrases.where("words > 2")
        .withColumn("split", F.split("phrase", " "))
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
        .select("lang", F.expr("array_join(slice(split, at, size), ' ')").alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed))
    return kept.join(totals, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def first_of_each(found: DataFrame, most: int = 2000) -> DataFrame:
    """Adds rank, the place of a phrase in its language by score and a, both
    descending, and phrase in byte order, and keeps the first `most`. Phrases of
    a language are first ranked in 64 parts, so that none of the tasks gets more
    of them than 64 * `most`. An empty table stays empty."""
    part, rank = fresh(found, "part"), fresh(found, "rank")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = found.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    near = parts.withColumn(rank, F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col(rank) <= most)
    ranked = near.drop(part).withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= most)
