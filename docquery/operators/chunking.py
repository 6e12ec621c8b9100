"""Chunks along a document's own headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import delete_all, named, pieces_at, strip
from docquery.profile import INDONESIAN_LAW, Profile

BOUNDARY = "===CHUNK_BOUNDARY==="


def _by_line(pattern: str) -> str:
    """The pattern with lines that end at line feeds only, as in Python; Java
    also ends them at U+0085, U+2028 and U+2029."""
    return f"(?d){pattern}"


def split_by_heading(docs: DataFrame, doc: str = "doc_id", text: str = "text", heading: str | None = None, profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, position, label, start, body): a stretch per heading, with it; the
    label is the heading's first group. What lies before the first is left out."""
    found = pieces_at(F.coalesce(text, F.lit("")), _by_line(heading or profile.heading), 1)
    return docs.select(doc, F.posexplode(found).alias("position", "p")).select(doc, "position", F.col("p.key").alias("label"), F.col("p.start").alias("start"), F.col("p.body").alias("body"))


def _kept_marks(text: str, profile: Profile) -> Column:
    """See structure_marks."""
    structure = _by_line(profile.structure)
    found = pieces_at(F.coalesce(text, F.lit("")), structure, 0)
    part = lambda x, g: strip(F.regexp_extract(x, structure, g))
    titled = lambda t: (t != "") & (t == F.upper(t)) & (F.length(t) <= 80) & (F.lower(t) != t)

    def label(key: Column) -> Column:
        head = F.when(part(key, 5) != "", part(key, 5)).otherwise(F.concat_ws(" ", part(key, 1), part(key, 2)))
        inline, below = part(key, 3), part(key, 4)
        return F.when(titled(inline), F.concat_ws(" ", head, inline)).when((inline == "") & titled(below), F.concat_ws(" ", head, below)).otherwise(head)

    labelled = F.transform(found, lambda p: F.struct(p["start"].alias("start"), label(p["key"]).alias("label")))
    return F.aggregate(
        labelled,
        F.array().cast("array<struct<start:int,label:string>>"),
        lambda a, m: F.when((F.size(a) == 0) | (m["start"] - F.element_at(a, -1)["start"] >= 200), F.array_append(a, m))
        .when(F.length(m["label"]) > F.length(F.element_at(a, -1)["label"]), F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), m))
        .otherwise(a),
    )


def structure_marks(docs: DataFrame, doc: str = "doc_id", text: str = "text", profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, start, label) of the marks above articles. A title counts if it is
    in capitals and has 80 characters at most; a mark that follows a kept one
    within 200 characters replaces it if its label is longer, else it goes."""
    return docs.select(doc, F.explode(_kept_marks(text, profile)).alias("m")).select(doc, "m.start", "m.label")


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """rows with the value of the last mark strictly before each: rows and marks
    of a key are put in one order, marks after rows of the same place."""
    both = rows.withColumn("mark_", F.lit(0)).unionByName(marks.withColumn("mark_", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "mark_").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(before)).where("mark_ = 0").drop("mark_")


def split_long(chunks: DataFrame, body: str = "body", profile: Profile = INDONESIAN_LAW, part: str | None = None) -> DataFrame:
    """Chunks of more than max_words words that have numbered paragraphs become
    one chunk per paragraph, each after the text before the first; paragraph is
    its number in order. Other chunks stay, without one."""
    words = F.size(F.split(strip(F.col(body)), r"(?U)\s+"))
    pieces = pieces_at(F.col(body), _by_line(part or profile.paragraph), 0)
    chunks = chunks.withColumn("pieces_", F.when(words > profile.max_words, pieces))
    head = strip(F.substring(F.col(body), F.lit(1), F.element_at("pieces_", 1)["start"]))
    parts = F.transform("pieces_", lambda p, i: F.struct((i + 1).alias("paragraph"), F.concat_ws("\n", F.when(head != "", head), strip(p["body"])).alias("body")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("paragraph"), F.col(body).alias("body")))
    out = chunks.withColumn("part_", F.explode(F.when(F.size("pieces_") > 0, parts).otherwise(whole)))
    return out.withColumn(body, F.col("part_.body")).withColumn("paragraph", F.col("part_.paragraph")).drop("part_", "pieces_")


def chunk_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", profile: Profile = INDONESIAN_LAW) -> DataFrame:
    """(doc, position, label, section, paragraph, body): all of the above, then
    the lines of structure taken out of the bodies; empty chunks go."""
    # Marks are 200 characters apart, so a row finds its own among the few of its document.
    last = lambda marks, p: F.try_element_at(F.filter(marks, lambda m: m["start"] < p["start"]), F.lit(-1))["label"]
    own = lambda body: strip(delete_all(body, [_by_line(p) for p in profile.structure_lines]))
    found = pieces_at(F.coalesce(text, F.lit("")), _by_line(profile.heading), 1)
    placed = named(_kept_marks(text, profile), lambda marks: F.transform(found, lambda p, i: F.struct(i.alias("position"), p["key"].alias("label"), last(marks, p).alias("section"), own(p["body"]).alias("body"))))
    rows = docs.select(doc, F.explode(F.filter(placed, lambda p: p["body"] != "")).alias("p")).select(doc, "p.*")
    return split_long(rows, "body", profile).select(doc, "position", "label", "section", "paragraph", "body")


def parse_model_chunks(answers: DataFrame, doc: str, answer: str, metadata: Column | None = None) -> DataFrame:
    """(doc, position, source, structure, label, body) of a model's answer that
    has blocks between boundaries, each with an optional head between dashes.
    With metadata (a map of the document's own fields) also a column metadata:
    these fields, over which the head's `sumber`, `struktur` and `pasal` go
    where it names them; it can change no other."""
    blocks = F.filter(F.transform(F.split(answer, BOUNDARY), strip), lambda b: b != "")
    head = r"(?s)^-{3,}\s*\n(.*?)\n-{3,}\s*(?:\n(.*)|)$"
    field = lambda name: strip(F.regexp_extract("head", rf"(?m)^{name}:[ \t]*(.*)$", 1))
    own = [metadata.alias("own_")] if metadata is not None else []
    rows = answers.select(doc, *own, F.posexplode(blocks).alias("position", "block"))
    rows = rows.withColumn("head", F.regexp_extract("block", head, 1)).withColumn("body", F.when(F.col("block").rlike(head), strip(F.regexp_extract("block", head, 2))).otherwise(F.col("block")))
    rows = rows.withColumns({"source": field("Sumber"), "structure": field("Struktur"), "label": F.regexp_extract("head", r"Struktur:.*?Pasal\s+(\S+)", 1)})
    if metadata is not None:
        said = {"sumber": F.col("head").rlike(r"(?m)^Sumber:"), "struktur": F.col("head").rlike(r"(?m)^Struktur:"), "pasal": F.col("label") != ""}
        values = {"sumber": "source", "struktur": "structure", "pasal": "label"}
        pairs = F.filter(F.array(*(F.when(is_said, F.struct(F.lit(k).alias("k"), F.col(values[k]).alias("v"))) for k, is_said in said.items())), lambda p: p.isNotNull())
        from_head = F.map_from_entries(pairs)
        kept = F.map_filter(F.coalesce("own_", F.map_from_entries(F.filter(pairs, lambda p: F.lit(False)))), lambda k, v: ~F.map_contains_key(from_head, k))
        rows = rows.withColumn("metadata", F.map_concat(kept, from_head))
    return rows.select(doc, "position", "source", "structure", "label", "body", *(["metadata"] if metadata is not None else []))
