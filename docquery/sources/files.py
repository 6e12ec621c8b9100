"""Files in and out: documents, exports, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.operators.vectors import signed_bytes
from docquery.profile import INDONESIAN_LAW, Profile

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("pasal", T.StringType()), T.StructField("ayat", T.IntegerType()),
    T.StructField("bab", T.StringType()), T.StructField("text", T.StringType()),
])
EXPORT = T.StructType([
    T.StructField("nomor_uu", T.StringType()), T.StructField("tahun_uu", T.StringType()), T.StructField("tentang", T.StringType()),
    T.StructField("vec_scale", T.DoubleType()), T.StructField("vec_b64", T.StringType()), T.StructField("chunks", T.ArrayType(CHUNK)),
    T.StructField("start", T.LongType()),
])
MANIFEST = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("model", T.StringType()),
    T.StructField("docs", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("chunks", T.IntegerType()),
        T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()),
    ]))),
])

GRAPH = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("nodes", T.ArrayType(T.StringType())),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("kind", T.StringType())]))),
])


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def page_texts(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, error): pages of each file after their marks. pages_of is
    the parser; a file that it can't read gets its message in error, and the
    others go on."""

    def read(batches):
        for part in batches:
            rows = []
            for content in part["content"]:
                try:
                    rows.append(("\n".join(f"<<<PAGE {i}>>>\n{p or ''}" for i, p in enumerate(pages_of(content), 1)), None))
                except Exception as e:  # noqa: BLE001  a parser may raise anything
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield part[["path"]].assign(text=[r[0] for r in rows], error=[r[1] for r in rows])

    return files.mapInPandas(read, "path string, text string, error string")


def file_metadata(path: Column, profile: Profile = INDONESIAN_LAW) -> list[Column]:
    """number, year and title from a file name; a name of another form is the
    title, with empty number and year."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    part = lambda g: F.regexp_extract(stem, profile.file_name, g)
    fits = stem.rlike(profile.file_name)
    return [part(1).alias("number"), part(2).alias("year"), F.when(fits, F.trim(F.translate(part(3), "-_", "  "))).otherwise(stem).alias("title")]


def read_exports(spark: SparkSession, path: str, lines: bool = False, dim: int | None = None) -> DataFrame:
    """One row per chunk of the exported files, with the document's fields: a
    file per document, or with lines a line per part of one (see write_exports).
    vec_b64 is of all chunks of the file or line; with dim, codes takes its
    place: the dim 8-bit components of the chunk itself."""
    reader = spark.read.schema(EXPORT)
    docs = reader.json(path) if lines else reader.option("multiLine", True).option("pathGlobFilter", "uu-*.json").json(path)
    fields = ["nomor_uu", "tahun_uu", "tentang", "vec_scale", *([] if dim else ["vec_b64"])]
    position = (F.coalesce("start", F.lit(0)) + F.col("i")).cast("int").alias("position")
    if dim is None:
        return docs.select(*fields, "start", F.posexplode("chunks").alias("i", "c")).select(*fields, position, "c.*")
    own = lambda raw: F.transform("chunks", lambda c, i: F.struct(c.alias("c"), F.substring(raw, i * dim + 1, F.lit(dim)).alias("raw")))
    rows = docs.select(*fields, "start", F.posexplode(F.transform(F.array(F.unbase64("vec_b64")), own)[0]).alias("i", "e"))
    return rows.select(*fields, position, "e.c.*", signed_bytes(F.col("e.raw")).alias("codes"))


def write_exports(documents: DataFrame, path: str) -> None:
    """One JSON line per part of a document, by year, number and start; what was
    there before goes. documents: payloads (see store.export_payloads), or any rows."""
    if "payload" in documents.columns:
        order = [c for c in ("tahun_uu", "nomor_uu", "start") if c in documents.columns]
        documents.orderBy(*order).select("payload").write.mode("overwrite").text(path)
    else:
        documents.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per document of a manifest: one object with a list, or with lines
    an object per document (see write_manifest)."""
    fields = T.StructType([*MANIFEST.fields[:3], *MANIFEST["docs"].dataType.elementType.fields])
    if lines:
        return spark.read.schema(fields).json(path)
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return m.select("version", "dim", "model", F.explode("docs").alias("d")).select("version", "dim", "model", "d.*")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A line per document (see store.export_manifest)."""
    manifest.write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Folders nodes and edges of JSON lines; what was there before goes."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of write_graph. A malformed line stops the job."""
    reader = spark.read.option("mode", "FAILFAST")
    return reader.schema("src string, dst string, kind string").json(f"{path}/edges"), reader.schema("node string").json(f"{path}/nodes")


def read_graph_object(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a file that is one object with a list of nodes and a
    list of edges from one to another. A malformed file stops the job."""
    both = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    edge = F.explode("edges").alias("e")
    return both.select(edge).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind"), both.select(F.explode("nodes").alias("node"))


def add_summaries(planned: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], key: str = "node") -> None:
    """Appends to the table at path what make gives for the rows of planned
    whose key isn't there yet; a job that stopped goes on where it was. Each
    call adds one batch, whole or not at all."""
    done = planned.sparkSession.createDataFrame([], planned.select(key).schema)
    try:
        done = planned.sparkSession.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    make(planned.join(done, key, "left_anti")).write.mode("append").parquet(path)
