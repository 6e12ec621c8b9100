"""Citation graph: edges from texts, adjacency, expansion of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import pieces_at
from docquery.profile import INDONESIAN_LAW, Profile


def doc_key(number: Column, year: Column) -> Column:
    return F.concat_ws("-", F.lit("uu"), number, year)


def node_key(doc: Column, label: Column) -> Column:
    return F.concat_ws("#", doc, label)


def article_texts(chunks: DataFrame, doc: str = "doc", label: str = "label", order: str = "position", body: str = "body") -> DataFrame:
    """(doc, label, text): the chunks of an article in order, by line breaks."""
    parts = chunks.groupBy(doc, label).agg(F.sort_array(F.collect_list(F.struct(order, body))).alias("parts"))
    return parts.select(doc, label, F.array_join(F.transform("parts", lambda p: p[body]), "\n").alias("text")).where("text <> ''")


def summary_texts(chunks: DataFrame, doc: str = "doc", label: str = "label", order: str = "position", body: str = "body", paragraph: str = "paragraph", section: str = "section", most: int | None = None, profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, label, text): what a summary of an article is made from: its chunks
    in order, each after its paragraph's number in brackets if it has one, by
    spaces; without chunks of the explanation; its first most characters."""
    own = chunks.where(~F.contains(F.upper(F.coalesce(section, F.lit(""))), F.lit(profile.explanation)))
    part = F.concat(F.when(F.coalesce(paragraph, F.lit(0)) != 0, F.concat(F.lit("("), F.col(paragraph).cast("string"), F.lit(") "))).otherwise(""), F.coalesce(body, F.lit("")))
    parts = own.groupBy(doc, label).agg(F.sort_array(F.collect_list(F.struct(F.col(order), part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), " ")
    return parts.select(doc, label, (F.substring(text, 1, most) if most else text).alias("text"))


def citation_edges(articles: DataFrame, docs: DataFrame, doc: str = "doc", label: str = "label", text: str = "text", nearest: bool = True, profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(src, dst, kind) of article texts. A citation of another document of docs
    (doc) points to the article named within the window around it (the nearest
    one, or without nearest the first one), or to the document. A citation of an
    article points within the own document, unless a document is cited in the
    window before it."""
    w = profile.citation_window
    laws = pieces_at(F.col(text), profile.law_citation, 0)
    own = node_key(F.col(doc), F.col(label))
    law = articles.select(doc, label, text, F.explode(laws).alias("p")).select(
        doc, own.alias("src"), doc_key(F.regexp_extract("p.key", profile.law_citation, 1), F.regexp_extract("p.key", profile.law_citation, 2)).alias("cited"),
        F.substring(F.col(text), F.greatest(F.lit(1), F.col("p.start") + 1 - w), F.least(F.col("p.start"), F.lit(w))).alias("before"),
        F.substring(F.col(text), F.col("p.start") + 1 + F.length("p.key"), F.lit(w)).alias("after"),
    )
    named = lambda c: F.regexp_extract_all(c, F.lit(profile.article_citation), F.lit(1))
    gap_after = F.length(F.regexp_extract("after", rf"(?s)^(.*?){profile.article_citation}", 1))
    gap_before = F.length(F.regexp_extract("before", rf"(?s)^.*{profile.article_citation}(.*)$", 2))
    last, first = F.element_at(named(F.col("before")), -1), F.element_at(named(F.col("after")), 1)
    has_b, has_a = F.size(named(F.col("before"))) > 0, F.size(named(F.col("after"))) > 0
    if nearest:
        target = F.when(has_b & (~has_a | (gap_before <= gap_after)), last).when(has_a, first)
    else:
        target = F.when(has_b, F.element_at(named(F.col("before")), 1)).when(has_a, first)
    across = law.join(docs.select(F.col(doc).alias("cited")).distinct(), "cited", "left_semi").where(F.col("cited") != F.col(doc))
    across = across.select("src", node_key(F.col("cited"), target).alias("dst"), F.lit("lintas").alias("kind"))
    inside = articles.select(doc, label, text, F.explode(pieces_at(F.col(text), profile.article_citation, 1)).alias("p")).withColumn(
        "before", F.substring(F.col(text), F.greatest(F.lit(1), F.col("p.start") + 1 - w), F.least(F.col("p.start"), F.lit(w)))
    )
    inside = inside.where((F.col("p.key") != F.col(label)) & ~F.col("before").rlike(profile.law_citation)).select(
        own.alias("src"), node_key(F.col(doc), F.col("p.key")).alias("dst"), F.lit("internal").alias("kind")
    )
    return across.unionByName(inside).distinct()


def contained(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc, item): whose text contains the item's. Three words of an item that
    have others on both sides stand whole in any text that contains it, so items
    are joined on them and confirmed; only items of fewer than five words meet
    every text. Items that are null or empty are contained in nothing."""
    words = F.split(F.col("text_"), r"\s+")
    triples = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.xxhash64(t[i - 1], t[i], t[i + 1]))
    # The words are named once, so that a text is cut once.
    keys = F.transform(F.array(words), lambda t: F.when(F.size(t) >= 3, F.array_distinct(triples(t))))[0]
    texts = docs.select(F.col(doc).alias("doc_"), F.col(text).alias("text_"))
    named = items.select(F.col(item).alias("item_"), F.col(item_text).alias("text_")).where("text_ <> ''").withColumn("words_", words)
    own = named.where(F.size("words_") >= 5).select("item_", F.col("text_").alias("wanted_"), F.xxhash64(*(F.col("words_")[i] for i in (1, 2, 3))).alias("key_"))
    hits = texts.select("doc_", "text_", F.explode(keys).alias("key_")).join(own, "key_").where(F.contains("text_", "wanted_")).select("doc_", "item_")
    short = named.where(F.size("words_") < 5).select("item_", F.col("text_").alias("wanted_"))
    if not short.isEmpty():
        hits = hits.unionByName(texts.join(short, F.contains("text_", "wanted_")).select("doc_", "item_"))
    return hits.select(F.col("doc_").alias(doc), F.col("item_").alias(item)).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


def adjacency(edges: DataFrame, position: str) -> DataFrame:
    """(node, neighbour, position, way): both ways of every edge, in the order
    of the edges."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), position, F.lit(0).alias("way"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), position, F.lit(1).alias("way")))


def expand_hits(hits: DataFrame, adjacent: DataFrame, limit: int = 3, factor: float = 0.85, position: str = "position") -> DataFrame:
    """hits: (qid, node, rank, score). Returns hits and up to limit neighbours
    per query in all: in the order of the hits and of their edges, each once,
    none that is a hit; with factor of the score of the hit that led there."""
    led = hits.join(adjacent, "node").select("qid", F.col("neighbour").alias("node"), (F.col("score") * factor).alias("score"), "rank", position, "way")
    new = led.join(hits.select("qid", "node"), ["qid", "node"], "left_anti")
    first = new.withColumn("turn", F.row_number().over(Window.partitionBy("qid", "node").orderBy("rank", position, "way"))).where("turn = 1")
    added = first.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy("rank", position, "way"))).where(F.col("turn") <= limit)
    last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    added = added.join(last, "qid").select("qid", "node", (F.col("last") + F.col("turn")).alias("rank"), "score", F.lit(True).alias("expanded"))
    return hits.select("qid", "node", "rank", "score", F.lit(False).alias("expanded")).unionByName(added)
