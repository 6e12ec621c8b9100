"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import erase, written


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Links every neighbour to the least node around: the large star uses all
    neighbours and keeps links to greater ones, the small star uses the lesser
    ones. The least node is aggregated before the join, so no neighbourhood is
    brought together."""
    both = links if small else links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
    out = both.join(least, "x")
    if small:
        moved = out.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
    else:
        moved = out.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.where("x <> y").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links: (x, y) with x <> y, in any direction and repeated. Returns (node,
    root), root being the least node of its component. Each round is written to
    the shared folder; rounds grow with the logarithm of the number of nodes."""
    now = written(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        last, now = now, written(_stars(_stars(now, small=False), small=True), "links")
        erase(last)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = mark
    raise RuntimeError("components didn't settle")
