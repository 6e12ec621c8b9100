"""Queries on graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquery.operators import graph, store
from docquery.plans.registry import query, table
from docquery.sources import files
from docquery.sources.optional import side_input
from docquery.storage import shared_dir, stored

#: A document cites a benchmark item when it contains its text.
_EDGES = """
WITH e AS (SELECT DISTINCT 'doc-' || doc_id AS src, 'item-' || item_id AS dst, CASE WHEN item_id % 2 = 0 THEN 'internal' ELSE 'lintas' END AS kind
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""


def _edges(spark, sf_dir):
    hits = graph.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return hits.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("dst"),
        F.when(F.col("item_id") % 2 == 0, "internal").otherwise("lintas").alias("kind"),
    ).distinct()


@query(_EDGES + " SELECT src, dst, kind FROM e")
def reference_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(_EDGES + " SELECT kind, count(*) AS n_edges FROM e GROUP BY kind")
def edge_stats(spark, sf_dir):
    return graph.edge_counts(_edges(spark, sf_dir))


@query(_EDGES + " SELECT src AS node FROM e UNION SELECT dst FROM e")
def graph_nodes(spark, sf_dir):
    return graph.nodes(stored(_edges(spark, sf_dir)))


_HITS = _EDGES + """
, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS position FROM e),
a AS (SELECT src AS node, dst AS neighbour, src || ' ' || dst AS position, 0 AS way FROM e UNION ALL SELECT dst, src, src || ' ' || dst, 1 FROM e),
d AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
h AS (SELECT 1 AS qid, dst AS node, CAST(row_number() OVER (ORDER BY n DESC, dst) AS INTEGER) AS rank FROM d QUALIFY rank <= 3),
s AS (SELECT *, 1.0::DOUBLE / rank AS score FROM h),
l AS (SELECT s.qid, neighbour AS node, 0.85::DOUBLE * score AS score, rank, position, way FROM s JOIN a ON s.node = a.node WHERE neighbour NOT IN (SELECT node FROM h)),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY node ORDER BY rank, position, way) = 1),
t AS (SELECT *, row_number() OVER (ORDER BY rank, position, way) AS turn FROM f QUALIFY turn <= 3)"""


@query(_HITS + """
SELECT qid, node, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, false AS expanded FROM s
UNION ALL SELECT qid, node, CAST((SELECT max(rank) FROM s) + turn AS INTEGER), round(score, 6), true FROM t""")
def graph_expand(spark, sf_dir):
    """The three items that most documents cite, and up to three documents that
    cite them."""
    edges = stored(_edges(spark, sf_dir)).withColumn("position", F.concat_ws(" ", "src", "dst"))
    cited = edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dst").limit(3)
    ranked = cited.agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "dst"))).alias("top")).select(F.posexplode("top").alias("k", "x"))
    hits = ranked.select(F.lit(1).alias("qid"), F.col("x.dst").alias("node"), (F.col("k") + 1).alias("rank"), (1.0 / (F.col("k") + 1)).alias("score"))
    out = graph.expand_hits(hits, graph.adjacency(edges, "position"))
    return out.select("qid", "node", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"), "expanded")


@query(r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS link FROM pages)
SELECT link, count(*) AS pages, count(DISTINCT host) AS hosts, min(page_id) AS first_page FROM l GROUP BY link""")
def link_targets(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"), F.min("page_id").alias("first_page"))


@query("SELECT conv_id || '#' || role AS node, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def node_first_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("node", graph.node_key(F.col("conv_id").cast("string"), F.col("role")))
    return store.first_per(c, "node", "turn").select("node", "turn")


@query(r"SELECT conv_id, role, string_agg(text, E'\n' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id, role")
def article_texts(spark, sf_dir):
    return graph.article_texts(table(spark, sf_dir, "conversations").where("text <> ''"), "conv_id", "role", "turn", "text")


#: Articles made of the tables: a law per source, an article per document, whose text cites what its number says.
_ARTICLES = """
WITH a AS (SELECT 'uu-' || CAST(replace(source, 'src', '') AS INTEGER) || '-2001' AS doc, CAST(doc_id AS VARCHAR) AS label, doc_id, text FROM documents),
t AS (SELECT doc, label, doc_id, 'Pasal ' || (doc_id + 1) || ' UU Nomor ' || (doc_id % 23) || ' Tahun 2001. ' || substr(text, 1, 200) || repeat(' x', 70) || ' lihat Pasal ' || (doc_id % 7) || '. ' AS text FROM a),
d AS (SELECT DISTINCT doc FROM a),
e AS (
  SELECT doc || '#' || label AS src, 'uu-' || (doc_id % 23) || '-2001#' || (doc_id + 1) AS dst, 'lintas' AS kind FROM t
  WHERE 'uu-' || (doc_id % 23) || '-2001' <> doc AND 'uu-' || (doc_id % 23) || '-2001' IN (SELECT doc FROM d)
  UNION SELECT doc || '#' || label, doc || '#' || (doc_id + 1), 'internal' FROM t
  UNION SELECT doc || '#' || label, doc || '#' || (doc_id % 7), 'internal' FROM t WHERE doc_id % 7 <> doc_id)"""


@query(_ARTICLES + " SELECT src, dst, kind FROM e")
def citation_edges(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    doc = F.concat(F.lit("uu-"), F.replace("source", F.lit("src"), F.lit("")).cast("int").cast("string"), F.lit("-2001"))
    text = F.concat(
        F.lit("Pasal "), (i + 1).cast("string"), F.lit(" UU Nomor "), (i % 23).cast("string"), F.lit(" Tahun 2001. "), F.substring("text", 1, 200),
        F.lit(" x" * 70 + " lihat Pasal "), (i % 7).cast("string"), F.lit(". "),
    )
    articles = d.select(doc.alias("doc"), i.cast("string").alias("label"), text.alias("text"))
    return graph.citation_edges(articles, articles.select("doc").distinct())


@query(r"""
SELECT conv_id, role, substr(string_agg(CASE WHEN turn % 3 > 0 THEN '(' || (turn % 3) || ') ' ELSE '' END || coalesce(text, ''), ' ' ORDER BY turn), 1, 1500) AS text
FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id, role""")
def summary_sources(spark, sf_dir):
    """Texts that summaries are made from; every fifth turn is an explanation."""
    c = table(spark, sf_dir, "conversations").withColumn("paragraph", (F.col("turn") % 3).cast("int")).withColumn("section", F.when(F.col("turn") % 5 == 4, "Penjelasan"))
    return graph.summary_texts(c, "conv_id", "role", "turn", "text", most=1500)


@query(_EDGES + """
SELECT src, dst, kind, 'fresh' AS state FROM e UNION ALL SELECT src, dst, kind, 'kept' FROM e""")
def optional_graph(spark, sf_dir):
    """The edges as a side input: written as a graph and read, then read once
    more when what lies there is no graph."""
    path = f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    edges = stored(_edges(spark, sf_dir))
    files.write_graph(edges, graph.nodes(edges), f"{path}/good")
    for part in ("nodes", "edges"):
        edges.select(F.concat(F.lit("{broken "), "src").alias("value")).write.text(f"{path}/bad/{part}")
    read = lambda which: side_input(spark, lambda: files.read_graph(spark, f"{path}/{which}")[0], f"{path}/kept")
    got = [read("good"), read("bad")]
    return got[0].rows.withColumn("state", F.lit(got[0].state)).unionByName(got[1].rows.withColumn("state", F.lit(got[1].state)))
