"""Mixing sources to target weights by capped water-filling.

Only DataFrame operations. Sizes are summed per source and hash bucket; the
water level comes from window sums over one row per source; the documents are
then read once more and decided row by row. Only the one bucket per source in
which the fractional repetition ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import WORD_PATTERN, fresh, written

#: Hexadecimal digits of a document's seeded digest that name its bucket: 4,096
#: buckets a source, so that the part to be ordered is small in a hot source too.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sizes: (source, bucket, size), at most 4,096 rows a source. Returns one
    row per source: (source, source_size, target, whole, full_to, cut, before):
    each document is taken `whole` times, once more in the buckets up to
    full_to, and once more in bucket cut as far as the rest of the target goes,
    of which `before` words lie in earlier buckets.

    A source of size s and weight w saturates at max_epochs * s. In the order of
    max_epochs * s / w, the level that remains after saturating all earlier
    sources is compared with each source's own; the first that stays above it
    ends the reshare. One row per source is brought together for that.
    """
    everything = Window.partitionBy(F.lit(0))
    by_source = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    levels = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_source) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("spent")).cast("double") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
        .select("source", "source_size", "target", "whole", "rest")
    )
    buckets = Window.partitionBy("s.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (
        sizes.alias("s").join(levels.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")))
        .withColumn("before", F.coalesce(F.sum("size").over(buckets), F.lit(0)))
        .select("l.*", "bucket", "before", (F.col("before") + F.col("size")).alias("after"))
    )
    ends = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("after"))
    return per_bucket.groupBy("source").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")),
        F.max(F.when(F.col("after") <= F.col("rest"), F.col("bucket"))).alias("full_to"),
        F.max(F.when(ends, F.col("bucket"))).alias("cut"),
        F.max(F.when(ends, F.col("before"))).alias("before"),
    )


def mix_sources(
    docs: DataFrame,
    into: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix-1",
    size_col: str | None = None,
) -> DataFrame:
    """Adds to every row of docs a struct `into`: size (words of the text),
    source_size, target (words that the source should give), copies (how often
    the mix takes the row) and taken (copies * size).

    Sources in code point order weigh `weights`, repeating; they share the sum
    of all sizes, no source above max_epochs times its size. The whole
    repetitions are the same for all rows of a source. The fractional one takes
    rows in a seeded order (md5 of seed and id, then id, then size) while the
    middle of the row lies within what the target leaves, so a source misses its
    target by half a document at most, and reruns agree. With size_col, sizes
    are taken from there (null: 0), and texts aren't read.

    Nulls: a null text has size 0; null sources are one source, ordered last; a
    null id is hashed like an empty one. Repeated rows count each. A source
    without words has target 0. An empty table gives an empty result. A column
    of docs named like `into` is replaced; other names don't matter.
    """
    at = fresh(docs, "mixing")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else n_words(F.col(text_col))
    own = F.struct(size.alias("size"), key.alias("key"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    rows = docs.withColumn(at, own).withColumn(at, F.col(at).withField("bucket", F.substring(f"{at}.key", 1, BUCKET_DIGITS)))
    sizes = rows.groupBy(f"{at}.source", f"{at}.bucket").agg(F.sum(f"{at}.size").alias("size"))
    plan = written(water_fill(written(sizes, "mix-sizes"), weights, max_epochs), "mix-plan")
    p = fresh(rows, "plan")
    planned = rows.join(plan.select(F.struct("*").alias(p)), F.col(f"{at}.source").eqNullSafe(F.col(f"{p}.source")))
    ends_here = F.coalesce(F.col(f"{at}.bucket") == F.col(f"{p}.cut"), F.lit(False))
    before = F.col(f"{p}.before") + F.coalesce(
        F.sum(f"{at}.size").over(
            Window.partitionBy(f"{at}.source").orderBy(f"{at}.key", f"{at}.id", f"{at}.size").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    fits = before + F.col(f"{at}.size") / 2 <= F.col(f"{p}.rest")
    in_full = F.coalesce(F.col(f"{at}.bucket") <= F.col(f"{p}.full_to"), F.lit(False))
    more = fresh(planned, "more")
    decided = planned.where(~ends_here).withColumn(more, in_full.cast("long")).unionByName(
        planned.where(ends_here).withColumn(more, fits.cast("long"))
    )
    copies = F.col(f"{p}.whole") + F.col(more)
    result = F.struct(
        F.col(f"{at}.size").alias("size"), F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"),
        copies.alias("copies"), (copies * F.col(f"{at}.size")).alias("taken"),
    )
    return decided.withColumn(into, result).select(*(c for c in docs.columns if c != into), into)


def repeated(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it (rows that it
    doesn't take go), without the struct. Null ids and texts, repeated rows and
    columns of any name are kept as they are; an empty table stays empty."""
    return mixed.withColumn(into, F.explode(F.array_repeat(F.lit(0), F.col(into)["copies"].cast("int")))).drop(into)
