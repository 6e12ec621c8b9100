"""A corpus pipeline of five stages, each of one operator.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of documents. Null and repeated
rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import table, written
from docquery.llm.language_id import keep_identified, train
from docquery.llm.mixing import mix_sources, repeated
from docquery.llm.ngram_join import near_duplicates, one_of_each
from docquery.llm.private_data import redact_private
from docquery.llm.segmentation import encode
from docquery.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language with half of
    them. The model learns from all documents that name their language."""
    ship(spark)
    return keep_identified(docs, train(docs), least=0.5)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or
    more) the document with the smallest id stays."""
    ship(spark)
    return one_of_each(docs, near_duplicates(docs, n_words=5, threshold=80, links=False))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to their kind; n_chars is counted anew."""
    ship(spark)
    return redact_private(docs, length_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix of sources takes it."""
    return repeated(mix_sources(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The three best segmentations of every text, each with its score, and the
    piece ids of the best one."""
    ship(spark)
    best = F.col("segmentations")[0]["ids"]
    return encode(docs, n_best=3).select("doc_id", F.size(best).cast("long").alias("n_pieces"), "segmentations", best.alias("ids"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicate_groups),
    ("PII", private_data),
    ("mixing sources", source_mix),
    ("SentencePiece", pieces),
]

#: SQL expresses neither the language model nor the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written to
    the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
