"""Registered queries of the ten operators and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import oracles, quality
from docquery.llm.common import table, written
from docquery.llm.collocations import collocations, first_of_each
from docquery.llm.fingerprint import fingerprint_edits
from docquery.llm.infilling import fill_in_middle, restored
from docquery.llm.language_id import held_out, identify, train
from docquery.llm.license_scan import scan_licenses
from docquery.llm.mixing import mix_sources, n_words
from docquery.llm.ngram_join import near_duplicates
from docquery.llm.private_data import BASE, KINDS, find_private
from docquery.llm.segmentation import survey
from docquery.llm.token_counts import count_tokens
from docquery.llm.token_files import read_tokens, write_tokens
from docquery.llm.url_filter import filter_urls

#: The rules of the contract and the block list of the method.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
URL_LISTED = (
    "ads-track.example.com",
    "free-bets.example.net",
    "cheap-pills.example.net",
    "spam-farm.example.org",
    "casino-win.example.net",
    "adult-x.example.com",
)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every text."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited version."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every text, and the way back."""
    return survey(table(spark, sf_dir, "documents"), n_best=3)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License paragraphs of every text."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        (F.size("licenses") + F.size("passages")).cast("long").alias("n_licenses"),
        F.array_sort(F.array_distinct(F.transform(F.filter(F.concat("licenses", "passages"), lambda x: x["confirmed"]), lambda x: x["family"]))).alias("families"),
        F.col("licenses"),
        F.col("passages"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and number of links of every text, on three-word
    shingles at 0.9."""
    found = near_duplicates(table(spark, sf_dir, "documents"), n_words=3, threshold=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    found = filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_LISTED)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every text."""
    found = find_private(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    base = [k for k in KINDS if k in BASE]
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_spans(of(*base)), 256).alias("base_sha256"),
        _spans(F.col("found")).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every text."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; a quarter of the documents is held out
    of training."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    found = identify(docs, train(docs.where(~out)), spans=False)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")  # texts are read once
    mixed = mix_sources(sized, size_col="size")
    return mixed.select("doc_id", *(f"mix.{c}" for c in ("size", "source_size", "target", "taken")))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text cut and reordered for infilling, and of the text
    rebuilt from that."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    found = first_of_each(collocations(table(spark, sf_dir, "documents")), most=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every text, from the files."""
    found = read_tokens(write_tokens(table(spark, sf_dir, "documents")), packed=True)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_fingerprint": op2_fingerprint,
        "op3_segmentation": op3_segmentation,
        "op4_license_scan": op4_license_scan,
        "op5_ngram_join": op5_ngram_join,
        "op6_url_filter": op6_url_filter,
        "op7_private_data": op7_private_data,
        "op8_quality": op8_quality,
        "op9_language_id": op9_language_id,
        "op10_source_mix": op10_source_mix,
        "op11_infilling": op11_infilling,
        "op12_collocations": op12_collocations,
        "op13_token_files": op13_token_files,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
        "op6_url_filter": oracles.url_filter(URL_RULES, URL_LISTED),
        "op10_source_mix": oracles.SOURCE_MIX,
        "op11_infilling": oracles.INFILLING,
        "op12_collocations": oracles.COLLOCATIONS,
    }
