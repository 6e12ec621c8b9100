"""Exports in files of their own: one JSON object per document, one manifest.

A data source in Python: tasks write the files of their documents piece by piece
into a folder of their own, and the commit puts them in place. What a task that
stopped had written is never seen."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docquery.operators.vectors import quantize

FORMAT = "docquery_exports"
#: The rows of a document: first its vectors, then its chunks.
ROWS = "nomor_uu string, tahun_uu string, tentang string, vec_scale double, kind int, position long, codes array<tinyint>, id string, pasal string, ayat int, bab string, text string"
FIELDS = ("id", "pasal", "ayat", "bab", "text")


def write_export_files(chunks: DataFrame, path: str, version: str, dim: int, model: str, vector: str = "embedding") -> None:
    """Writes `uu-<number>-<year>.json` for every document and, last,
    manifest.json with the number of chunks, bytes and SHA-256 of each file, by
    year and number. Files of that form that were there before are replaced or
    go. chunks: nomor_uu, tahun_uu, tentang, position, id, pasal, ayat, bab,
    text and the vector (see store.checked_export).

    A document's scale is its largest absolute component / 127 (1 where that is
    0). No row holds a whole document: its chunks pass through the task that
    writes its file one after the other, in the order of position (of equal
    ones, of id). A null number or year is an empty text. An empty table
    writes a manifest without documents. The commit reads the lists of the
    tasks line by line and holds nothing but the names of the files. Where it is stopped
    midway, files don't fit the digests of the manifest that is still there
    (see store.verified), until the export is run again."""
    spark = chunks.sparkSession
    rows = chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in ("nomor_uu", "tahun_uu")})
    keys = ["nomor_uu", "tahun_uu"]
    top = F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))
    heads = rows.groupBy(*keys).agg(F.min_by("tentang", F.struct("position", "id")).alias("title_"), top.alias("top_"))
    scale = F.when(F.col("top_") > 0, F.col("top_") / 127).otherwise(1.0)
    rows = rows.join(heads, keys).withColumn("vec_scale", scale)
    own = lambda kind, codes, of: F.struct(F.lit(kind).alias("kind"), codes.alias("codes"), *(of(c).alias(c) for c in FIELDS))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    pieces = F.array(own(0, quantize(F.col(vector), F.col("vec_scale")), none), own(1, F.lit(None).cast("array<tinyint>"), F.col))
    out = rows.select(*keys, F.col("title_").alias("tentang"), "vec_scale", F.col("position").cast("long").alias("position"), F.col("id").alias("id_"), F.explode(pieces).alias("p"))
    # A document is within one partition, and partitions follow each other in the order of the manifest.
    out = out.repartitionByRange("tahun_uu", "nomor_uu").sortWithinPartitions("tahun_uu", "nomor_uu", "p.kind", "position", "id_")
    out = out.select(*keys, "tentang", "vec_scale", F.col("p.kind").alias("kind"), "position", "p.codes", "p.id", "p.pasal", F.col("p.ayat").cast("int").alias("ayat"), "p.bab", "p.text")
    spark.dataSource.register(ExportFiles)
    out.write.format(FORMAT).mode("append").options(version=version, dim=str(dim), model=model, job=uuid.uuid4().hex).save(path)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put_in_place(fs: pafs.FileSystem, new: str, path: str) -> None:
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # not every file system replaces what is there
        fs.delete_file(path)
    fs.move(new, path)


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


class ExportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ExportWriter(dict(self.options))


@dataclass
class Listed(WriterCommitMessage):
    """Where a task's files and their list are."""

    partition: int
    folder: str


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.job = options["path"], options["job"]
        self.head = {"version": options["version"], "dim": int(options["dim"]), "model": options["model"]}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        fs, base = _opened(self.path)
        task = TaskContext.get()
        folder = f"_temporary-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        with fs.open_output_stream(f"{base}/{folder}/list") as listed:
            for entry in _files(fs, f"{base}/{folder}", (row for batch in iterator for row in batch.to_pylist())):
                listed.write((_json(entry) + "\n").encode())
        return Listed(task.partitionId(), folder)

    def commit(self, messages: list[Listed | None]) -> None:
        fs, base = _opened(self.path)
        temporary = f"{base}/_temporary-{self.job}"
        fs.create_dir(temporary, recursive=True)
        names, lead = set(), ""
        with fs.open_output_stream(f"{temporary}/manifest.json") as out:
            out.write((_json(self.head)[:-1] + ', "docs": [').encode())
            for m in sorted((m for m in messages if m), key=lambda m: m.partition):
                with io.BufferedReader(fs.open_input_file(f"{base}/{m.folder}/list")) as listed:
                    for line in listed:
                        name = json.loads(line)["file"]
                        _put_in_place(fs, f"{base}/{m.folder}/{name}", f"{base}/{name}")
                        names.add(name)
                        out.write((lead + line.decode().rstrip("\n")).encode())
                        lead = ", "
            out.write(b"]}")
        _put_in_place(fs, f"{temporary}/manifest.json", f"{base}/manifest.json")
        for old in fs.get_file_info(pafs.FileSelector(base)):
            if old.base_name.startswith("uu-") and old.base_name.endswith(".json") and old.base_name not in names:
                fs.delete_file(old.path)
        fs.delete_dir(temporary)

    def abort(self, messages: list[Listed | None]) -> None:
        fs, base = _opened(self.path)
        if fs.get_file_info(f"{base}/_temporary-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_temporary-{self.job}")


def _files(fs: pafs.FileSystem, folder: str, rows: Iterator[dict]) -> Iterator[dict]:
    """Writes the files of sorted rows; an entry of the manifest for each."""
    row = next(rows, None)
    while row is not None:
        number, year = key = row["nomor_uu"], row["tahun_uu"]
        name = f"uu-{number}-{year}"
        digest, size, chunks = hashlib.sha256(), 0, 0
        with fs.open_output_stream(f"{folder}/{name}.json") as out:

            def put(text: str) -> None:
                nonlocal size
                raw = text.encode()
                out.write(raw)  # noqa: B023
                digest.update(raw)  # noqa: B023
                size += len(raw)

            head = {"nomor_uu": number, "tahun_uu": year, "tentang": row["tentang"] or "", "vec_scale": row["vec_scale"]}
            put(_json(head)[:-1] + ', "vec_b64": "')
            left = b""
            while row is not None and (row["nomor_uu"], row["tahun_uu"]) == key and row["kind"] == 0:
                left += bytes(x & 255 for x in row["codes"])
                whole = len(left) - len(left) % 3
                put(base64.b64encode(left[:whole]).decode())
                left = left[whole:]
                row = next(rows, None)
            put(base64.b64encode(left).decode() + '", "chunks": [')
            while row is not None and (row["nomor_uu"], row["tahun_uu"]) == key:
                put((", " if chunks else "") + _json({f: row[f] for f in FIELDS}))
                chunks += 1
                row = next(rows, None)
            put("]}")
        yield {"key": name, "file": f"{name}.json", "chunks": chunks, "bytes": size, "sha256": digest.hexdigest()}
