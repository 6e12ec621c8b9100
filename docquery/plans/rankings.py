"""Queries on ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquery.operators import answers, questions, ranking
from docquery.operators import summaries as sm
from docquery.operators import vectors as v
from docquery.plans.registry import query, table
from docquery.profile import GENERIC

#: Two stated questions and what they consist of; the same in SQL.
QUESTIONS = {1: "who rents a thing in source zero near water", 2: "stupid trash of the rent"}
_TERMS = """
WITH terms(qid, kind, place, members) AS (VALUES {values}),
m AS (SELECT DISTINCT qid, kind, place, doc_id FROM (SELECT qid, kind, place, unnest(members) AS member FROM terms), documents WHERE contains(lower(text), member)),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
f AS (SELECT t.qid, t.kind, t.place, count(m.doc_id) AS df FROM terms t LEFT JOIN m ON t.qid = m.qid AND t.kind = m.kind AND t.place = m.place GROUP BY ALL),
i AS (SELECT f.*, CASE WHEN df = 0 OR df > 0.05 * n THEN 0.0::DOUBLE ELSE 0.5 * (ln(n / df) / ln(n)) * (ln(n / df) / ln(n)) END AS idf FROM f, n),
w AS (SELECT qid, kind, place, df, CASE kind WHEN 'group' THEN idf WHEN 'phrase' THEN least(0.7::DOUBLE, 1.4 * idf) ELSE {intent} END AS weight FROM i),
p AS (SELECT m.qid, m.doc_id, m.kind, sum(weight) AS total, count(*) AS n, arg_max(weight, m.place) AS last FROM m JOIN w ON m.qid = w.qid AND m.kind = w.kind AND m.place = w.place GROUP BY ALL),
s AS (SELECT qid, doc_id, sum(CASE kind WHEN 'intent' THEN last ELSE total END) AS lexical FROM p GROUP BY ALL),
s0 AS (SELECT qid, doc_id, sum(CASE kind WHEN 'intent' THEN last ELSE n * last END) AS lexical FROM p GROUP BY ALL)"""


def _term_rows():
    """The terms of the stated questions, as SQL values, and the weight of
    intents per question."""
    rows, weights = [], []
    quote = lambda x: "'" + x + "'"
    for q, text in QUESTIONS.items():
        parsed = questions.parse_question(text, GENERIC)
        rows += [(q, "group", i, g) for i, g in enumerate(parsed.groups)]
        rows += [(q, "phrase", i, (x,)) for i, x in enumerate(parsed.phrases)]
        rows += [(q, "intent", i, GENERIC.intents[k][1]) for i, k in enumerate(parsed.intents)]
        weights += [f"WHEN {q} THEN {GENERIC.intents[parsed.intents[0]][2]}::DOUBLE"] if parsed.intents else []
    values = ", ".join(f"({q}, '{kind}', {i}, [{', '.join(map(quote, m))}])" for q, kind, i, m in rows)
    return values, f"CASE qid {' '.join(weights)} END"


_VALUES, _INTENT = _term_rows()
_SQL = _TERMS.format(values=_VALUES, intent=_INTENT)


def _matched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked, terms = questions.frames(spark, QUESTIONS, GENERIC)
    return docs, asked, terms, ranking.term_matches(docs, terms, "doc_id", "text")


def _weights(docs, terms, matches):
    return ranking.term_weights(matches, terms, docs.agg(F.count(F.lit(1))).scalar())


@query(_SQL + " SELECT qid, kind, place, df FROM f")
def term_document_frequency(spark, sf_dir):
    _, _, terms, matches = _matched(spark, sf_dir)
    return ranking.document_frequencies(matches, terms)


@query(_SQL + " SELECT qid, place, df, round(weight, 6) AS weight FROM w WHERE kind = 'group'")
def idf_weights(spark, sf_dir):
    docs, _, terms, matches = _matched(spark, sf_dir)
    return _weights(docs, terms, matches).where("kind = 'group'").select("qid", "place", "df", F.round("weight", 6).alias("weight"))


@query(_SQL + " SELECT qid, place, df, round(weight, 6) AS weight FROM w WHERE kind = 'phrase'")
def phrase_weights(spark, sf_dir):
    docs, _, terms, matches = _matched(spark, sf_dir)
    return _weights(docs, terms, matches).where("kind = 'phrase'").select("qid", "place", "df", F.round("weight", 6).alias("weight"))


@query(_SQL + " SELECT qid, doc_id, round(lexical, 6) AS lexical FROM s")
def lexical_score_sum(spark, sf_dir):
    docs, _, terms, matches = _matched(spark, sf_dir)
    return ranking.lexical_scores(matches, _weights(docs, terms, matches), "doc_id").select("qid", "doc_id", F.round("lexical", 6).alias("lexical"))


@query(_SQL + " SELECT qid, doc_id, round(lexical, 6) AS lexical FROM s0")
def lexical_score_reference(spark, sf_dir):
    docs, _, terms, matches = _matched(spark, sf_dir)
    return ranking.lexical_scores(matches, _weights(docs, terms, matches), "doc_id", "reference").select("qid", "doc_id", F.round("lexical", 6).alias("lexical"))


@query(_SQL + " SELECT qid, doc_id, count(*) AS intents FROM m WHERE kind = 'intent' GROUP BY qid, doc_id")
def intent_hits(spark, sf_dir):
    matches = _matched(spark, sf_dir)[3]
    return matches.where("kind = 'intent'").groupBy("qid", "doc_id").agg(F.count("*").alias("intents"))


#: A chunk of these tables: its law is its source's number, its year its label's
#: quality, its article its id modulo 40, its title its source.
_CHUNKS = """
c AS (SELECT d.doc_id, replace(source, 'src', '') AS law, CAST(l.quality AS VARCHAR) AS year, CAST(d.doc_id % 40 AS VARCHAR) AS article, source AS title,
  CASE WHEN d.doc_id % 11 = 0 THEN 'PENJELASAN' END AS section, CASE source WHEN 'src3' THEN 'src4' WHEN 'src7' THEN 'src8' END AS superseded
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""


def _chunks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    replaced = F.create_map(*(F.lit(x) for p in GENERIC.superseded.items() for x in p))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.replace("source", F.lit("src"), F.lit("")).alias("c_law"), F.col("quality").cast("string").alias("c_year"), (F.col("doc_id") % 40).cast("string").alias("c_article"),
        F.col("source").alias("c_title"), F.when(F.col("doc_id") % 11 == 0, "PENJELASAN").alias("section"), F.element_at(replaced, F.col("source")).alias("superseded"),
    )


def _boost():
    return ranking.metadata_boost(*(F.col(c) for c in ("law", "year", "article", "titles", "old", "words", "c_law", "c_year", "c_article", "c_title", "section", "superseded")))


@query("WITH" + _CHUNKS + r"""
, q(law, year, article) AS (VALUES ('3', '1', '5'))
SELECT doc_id, round((CASE WHEN c.law = q.law AND c.year = q.year THEN 0.20 ELSE 0.0 END
  + CASE WHEN c.article = q.article THEN CASE WHEN c.law = q.law AND c.year = q.year THEN 0.35 ELSE 0.05 END ELSE 0.0 END
  + CASE WHEN superseded IS NOT NULL AND NOT coalesce(c.law = q.law AND c.year = q.year, false) THEN -0.30 ELSE 0.0 END
  + CASE WHEN section IS NOT NULL THEN -0.15 ELSE 0.0 END + CASE WHEN contains(title, 'src1') THEN 0.08 ELSE 0.0 END)::DOUBLE, 6) AS boost FROM c, q""")
def metadata_boost(spark, sf_dir):
    asked = spark.createDataFrame([("3", "1", "5", [], False, ["src1"])], "law string, year string, article string, titles array<string>, old boolean, words array<string>")
    return _chunks(spark, sf_dir).join(F.broadcast(asked)).select("doc_id", F.round(_boost(), 6).alias("boost"))


_HYBRID = _SQL + "," + _CHUNKS + """
, q AS (SELECT 1 AS qid, embedding FROM embeddings WHERE vec_id = 0),
h AS (SELECT c.doc_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense,
  CASE WHEN regexp_matches(title, 'src0\\b') THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN superseded IS NOT NULL THEN -0.30::DOUBLE ELSE 0.0 END
  + CASE WHEN section IS NOT NULL THEN 0.0::DOUBLE ELSE 0.0 END AS boost,
  CASE WHEN section IS NOT NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * coalesce(s.lexical, 0) AS lexical
  FROM c JOIN embeddings e ON c.doc_id = e.vec_id CROSS JOIN q LEFT JOIN s ON s.qid = 1 AND s.doc_id = c.doc_id),
k AS (SELECT doc_id, dense, lexical, CAST(dense + boost + lexical AS FLOAT) AS score FROM h)"""


def _hybrid(spark, sf_dir):
    docs, asked, terms, matches = _matched(spark, sf_dir)
    lexical = ranking.lexical_scores(matches, _weights(docs, terms, matches), "doc_id").where("qid = 1").select("doc_id", "lexical")
    e = table(spark, sf_dir, "embeddings")
    vector = e.where("vec_id = 0").select("embedding").scalar()
    named = asked.where("qid = 1").select(F.struct("*")).scalar()
    rows = _chunks(spark, sf_dir).join(e, F.col("doc_id") == F.col("vec_id")).join(lexical, "doc_id", "left")
    rows = rows.withColumns({"vector": vector, "asked": named}).select("*", "asked.*")
    scored = rows.withColumn("dense", v.dot(F.col("embedding"), F.col("vector")))
    return scored.withColumn("score", ranking.total_score(F.col("dense"), _boost(), F.col("lexical"), F.col("section").isNotNull()))


@query(_HYBRID + " SELECT doc_id, round(score::DOUBLE, 5) AS score FROM k ORDER BY k.score DESC, doc_id LIMIT 5")
def hybrid_topk(spark, sf_dir):
    best = ranking.top_k(_hybrid(spark, sf_dir), 5, "score", "doc_id", by=None)
    return best.select("doc_id", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(_HYBRID + " SELECT doc_id, (lexical = 0 AND score < 0.62) AS uncertain FROM k")
def uncertain_answer(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("doc_id", answers.uncertain(F.col("score"), F.col("lexical")).alias("uncertain"))


#: The parse of every user's turn as rows: the rules of GENERIC in SQL.
_ASKED = """
WITH t AS (SELECT conv_id, turn, ' ' || lower(coalesce(text, '')) || ' ' AS low FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, low, list_filter(regexp_split_to_array(regexp_replace(low, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS tokens FROM t),
w AS (SELECT conv_id, turn, low, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS i FROM k),
g AS (SELECT *, length(word) > 3 AND word NOT IN ({stop}) AS good FROM w)"""
_STEMS = """,
d AS (SELECT DISTINCT word FROM g WHERE good),
b AS (SELECT word, regexp_replace(word, '(nya|lah|kah|pun)$', '') AS base FROM d),
f AS (SELECT word, word AS form FROM d UNION SELECT word, base FROM b
  UNION SELECT word, regexp_replace(base, '(kan|an|i)$', '') FROM b WHERE length(regexp_replace(base, '(kan|an|i)$', '')) >= 4),
p(family, o, prefix) AS (VALUES (1,1,'meng'),(1,2,'meny'),(1,3,'men'),(1,4,'mem'),(1,5,'me'),(2,1,'peng'),(2,2,'peny'),(2,3,'pen'),(2,4,'pem'),(2,5,'pe'),
  (3,1,'ber'),(3,2,'be'),(3,3,'bel'),(4,1,'ter'),(4,2,'te'),(4,3,'tel'),(5,1,'di'),(5,2,'ke'),(5,3,'per'),(5,4,'pel')),
l(prefix, letter) AS (VALUES ('meny','s'),('mem','p'),('pem','p'),('meng','k'),('peng','k'),('men','t'),('pen','t')),
c AS (SELECT word, form, family, arg_min(prefix, o) AS prefix FROM f JOIN p ON starts_with(form, prefix) GROUP BY ALL),
r AS (SELECT word, form, substr(form, length(prefix) + 1) AS root FROM c WHERE length(form) - length(prefix) >= 4),
rb AS (SELECT word, regexp_replace(root, '(nya|lah|kah|pun)$', '') AS base FROM r),
v AS (SELECT word, word AS member FROM d UNION SELECT word, root FROM r UNION SELECT word, letter || root FROM r JOIN l ON starts_with(form, prefix)
  UNION SELECT word, base FROM rb UNION SELECT word, regexp_replace(base, '(kan|an|i)$', '') FROM rb),
s(word, member) AS (VALUES {synonyms}),
m AS (SELECT word, list_sort(list(DISTINCT member)) AS members FROM (SELECT * FROM v WHERE length(member) >= 4 UNION SELECT s.word, s.member FROM s JOIN d USING (word)) GROUP BY word)"""
_ASKED = _ASKED.format(stop=", ".join(f"'{w}'" for w in GENERIC.stopwords))
_STEMS = _STEMS.format(synonyms=", ".join(f"('{w}', '{o}')" for w, others in GENERIC.synonyms.items() for o in others))


def _user_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.struct("conv_id", "turn").alias("qid"), "text")


@query(_ASKED + r"""
SELECT t.conv_id, t.turn, nullif(regexp_extract(t.low, '\bpasal\s+(\d+[a-z]?)\b', 1), '') AS article,
  nullif(regexp_extract(t.low, '\b(?:uu|undang[\s-]?undang)\s*(?:no\.?\s*|nomor\s*)?(\d+)\s*(?:tahun\s*(\d{4}))?', 1), '') AS law,
  (CASE WHEN contains(t.low, 'source zero') THEN ['src0\b'] ELSE [] END) || (CASE WHEN contains(t.low, 'source one') THEN ['src1\b'] ELSE [] END) AS titles,
  coalesce((SELECT list(g.word ORDER BY g.i) FROM g WHERE g.conv_id = t.conv_id AND g.turn = t.turn AND good), []) AS words
FROM t""")
def question_references(spark, sf_dir):
    """What every user's turn names."""
    asked, _ = questions.parse(_user_turns(spark, sf_dir), GENERIC)
    return asked.select("qid.conv_id", "qid.turn", "article", "law", "titles", "words")


@query(_ASKED + _STEMS + """,
a AS (SELECT conv_id, turn, i, word, good, lead(word) OVER o AS next, lead(good) OVER o AS next_good FROM g WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
e AS (
  SELECT conv_id, turn, 'group' AS kind, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS place, members FROM g JOIN m USING (word) WHERE good
  UNION ALL SELECT conv_id, turn, 'phrase', CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER), [word || ' ' || next] FROM a WHERE good AND next_good
  UNION ALL SELECT conv_id, turn, 'intent', 0, ['people', 'person'] FROM t WHERE regexp_matches(low, 'who|person')
  UNION ALL SELECT conv_id, turn, 'intent', CASE WHEN regexp_matches(low, 'who|person') THEN 1 ELSE 0 END, ['rent', 'thing'] FROM t WHERE regexp_matches(low, 'rent|thing'))
SELECT * FROM e""")
def question_terms(spark, sf_dir):
    """Groups of alternatives, phrases and intents of every user's turn."""
    _, terms = questions.parse(_user_turns(spark, sf_dir), GENERIC)
    return terms.select("qid.conv_id", "qid.turn", "kind", "place", F.array_sort("members").alias("members"))


@query()
def best_sentence(spark, sf_dir):
    """The best quote of each document for a stated question, by hashed words,
    among all of its units; long says that it has more than 800 characters."""
    units = sm.explode_units(table(spark, sf_dir, "documents"), ["doc_id"], "text", 800)
    asked = F.array(*map(F.lit, spark.range(1).select(v.hash_embedding(F.lit("the thing that rents"), 32)).first()[0]))
    scored = units.withColumn("score", v.dot(v.hash_embedding(F.col("unit"), 32), asked))
    return sm.best_units(scored, ["doc_id"], "score", 1).select("doc_id", "unit_no", F.round("score", 6).alias("score"), "long")


@query("SELECT qid, valid FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS t(qid, valid)")
def request_validation(spark, sf_dir):
    rows = spark.createDataFrame([(1, "what is it", 5), (2, "no", 5), (3, "what is it", 21), (4, None, 5)], "qid int, question string, top_k int")
    return rows.select("qid", questions.valid_question(F.col("question"), F.col("top_k")).alias("valid"))
