"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of the documents of one range of document ids, in blocks of
1,024. A block subtracts its minimum and packs the differences with the width
that a percentile of them needs; those that need more are exceptions, stored
whole in a list after the packed bits. An index gives the start of every block,
so any document is read by seeking to its first block.

    magic, blocks, document ids (int64), validity (uint8), tokens per document (int64),
    starts of blocks (int64), footer: documents, ids, start of the document list (int64), magic

    block: minimum (uint32), width (uint8), exceptions (uint16), 32 * width words
    (uint32), places of the exceptions (uint16), their differences (uint32)

All numbers are little-endian. Tasks write files of their own under names that
no other attempt uses; only files whose row reached the manifest are ever read.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import shared_dir, text_blocks, written

try:
    from public_tokenizers import path as _path

    DEFAULT_TOKENIZER = _path("word_bpe_49k.json")
except ImportError:
    DEFAULT_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"

MAGIC = b"PFORIDS1"
BLOCK = 1024
_LANES = 32
_HEAD = struct.Struct("<IBH")
_FOOT = struct.Struct("<qqq8s")
#: Bytes of text encoded together, and blocks packed together.
SLICE = 4_000_000
GROUP = 256
#: Bytes of words (and as many words / 16) that an encoder knows before it forgets them.
KNOWN = 16_000_000


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1,024 numbers below 2 ** width as rows of 32 * width words: lane
    by lane, number j of every 32 begins at bit j * width."""
    lanes = np.ascontiguousarray(values.astype(np.uint32).reshape(-1, _LANES).T)
    out = np.zeros((width, lanes.shape[1]), np.uint32)
    for j in range(_LANES if width else 0):
        word, shift = divmod(j * width, 32)
        out[word] |= lanes[j] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= lanes[j] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """What pack was given."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint32)
    packed = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((_LANES, packed.shape[1]), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(_LANES):
        word, shift = divmod(j * width, 32)
        out[j] = packed[word] >> np.uint32(shift)
        if shift + width > 32:
            out[j] |= packed[word + 1] << np.uint32(32 - shift)
    return (np.ascontiguousarray(out.T) & mask).reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: int = 90) -> list[bytes]:
    """Blocks of ids, whose number must be a multiple of 1,024."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    over = rows - least[:, None]
    nth = min(BLOCK - 1, max(0, BLOCK * percentile // 100 - 1))
    widths = np.frexp(np.partition(over, nth, axis=1)[:, nth].astype(np.float64))[1]
    out: list = [None] * len(rows)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        cut = over[own]
        far = (cut >> np.uint32(width)) > 0 if width < 32 else np.zeros(cut.shape, bool)
        packed = pack(cut & np.uint32((1 << width) - 1), width)
        for k, i in enumerate(own.tolist()):
            at = np.flatnonzero(far[k])
            out[i] = b"".join((_HEAD.pack(int(least[i]), width, len(at)), packed[k].tobytes(), at.astype("<u2").tobytes(), cut[k, at].astype("<u4").tobytes()))
    return out


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """The ids of blocks, 1,024 each."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    out = np.empty((len(blocks), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = 128 * width
        out[own] = unpack(np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + size] for i in own), "<u4").reshape(len(own), -1), width)
    for i, (least, width, n) in enumerate(heads):
        if n:
            at = _HEAD.size + 128 * width
            out[i, np.frombuffer(blocks[i], "<u2", n, at)] = np.frombuffer(blocks[i], "<u4", n, at + 2 * n)
        out[i] += np.uint32(least)
    return out.reshape(-1)


#: Marks after a letter of ASCII or Latin-1 and before white space: the tokenizer
#: separates them from the word, so both are encoded once and not in every pair.
_MARKS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?&$*%]+[ \n])"


class Encoder:
    """Texts to ids by the tokenizers library, each distinct word once.

    Holds for tokenizers that split at white space and between letters and marks
    before their merges and drop white space. Texts are cut at ASCII white space
    only; what else is white space for the library stays in a word.
    """

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_str(tokenizer), [end_id]
        self.forget()

    def forget(self) -> None:
        """Starts anew; word 0 is the end of a text."""
        self.words, self.bytes = {}, 0
        self.starts, self.sizes, self.flat = np.array([0]), np.array([1]), np.array(self.end, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        ids = [x.ids for x in self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.words.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.bytes += sum(map(len, new))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each text has)."""
        if self.bytes > KNOWN or len(self.words) > KNOWN // 16:
            self.forget()
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _MARKS, r"\1 \2"))
        found = split.flatten().dictionary_encode()
        distinct = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in distinct if w not in self.words]:
            self._learn(new)
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        at = np.insert(number[found.indices.to_numpy(zero_copy_only=False)], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)), 0)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]
        return ids, np.diff(ends[at == 0], prepend=0)


@lru_cache(2)
def encoder(tokenizer: str, end_id: int) -> Encoder:
    """A worker process keeps it for its next tasks."""
    return Encoder(tokenizer, end_id)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_file(path: str, parts: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], percentile: int) -> tuple[int, int, int]:
    """Writes (document ids, ids of all of them, how many each has); returns
    documents, ids and bytes. Holds a group of blocks and the lists of documents
    and of starts."""
    fs, name = _opened(path)
    docs, valid, sizes, starts, rest, n, at = [], [], [], [], np.zeros(0, np.uint32), 0, len(MAGIC)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(MAGIC)

        def put(ids: np.ndarray) -> None:
            nonlocal at
            for block in encode_blocks(ids, percentile):
                starts.append(at)
                at += len(block)
                out.write(block)

        for doc_ids, ids, own in parts:
            docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            valid.append(doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            sizes.append(own.astype("<i8"))
            n += len(ids)
            rest = np.concatenate([rest, ids])
            while len(rest) >= BLOCK:
                take = min(len(rest) // BLOCK, GROUP) * BLOCK
                put(rest[:take])
                rest = rest[take:]
        if len(rest):
            put(np.concatenate([rest, np.full(BLOCK - len(rest), rest.min(), np.uint32)]))
        tail = b"".join(x.tobytes() for x in (*docs, *valid, *sizes, np.array(starts, "<i8")))
        n_docs = sum(map(len, docs))
        out.write(tail + _FOOT.pack(n_docs, n, at, MAGIC))
    return n_docs, n, at + len(tail) + _FOOT.size


class TokenFile:
    """One file, opened; documents are read by their place in it."""

    def __init__(self, path: str):
        fs, name = _opened(path)
        self.source = fs.open_input_file(name)
        total = self.source.size()
        self.n_docs, self.n_ids, at, magic = _FOOT.unpack(self.source.read_at(_FOOT.size, total - _FOOT.size))
        if magic != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no file of token blocks")
        blocks = -(-self.n_ids // BLOCK)
        tail = self.source.read_at(total - _FOOT.size - at, at)
        ids = np.frombuffer(tail, "<i8", self.n_docs)
        valid = np.frombuffer(tail, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = pa.array(ids, mask=valid == 0)
        self.sizes = np.frombuffer(tail, "<i8", self.n_docs, 9 * self.n_docs)
        self.ends = np.cumsum(self.sizes)
        self.starts = np.append(np.frombuffer(tail, "<i8", blocks, 17 * self.n_docs), at)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first to last (exclusive) of the file."""
        a, b = first // BLOCK, -(-last // BLOCK)
        if a == b:
            return np.zeros(0, np.uint32)
        begin = int(self.starts[a])
        data = memoryview(self.source.read_at(int(self.starts[b]) - begin, begin))
        cuts = (self.starts[a : b + 1] - begin).tolist()
        return decode_blocks([data[x:y] for x, y in zip(cuts, cuts[1:])])[first - a * BLOCK : last - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k] - self.sizes[k]), int(self.ends[k]))

    def parts(self, most: int = GROUP * BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, document after the last, their ids), about `most` ids at once."""
        part = (self.ends - self.sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), self.n_docs]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield a, b, self.ids(int(self.ends[a] - self.sizes[a]), int(self.ends[b - 1]))


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_files: int | None = None,
    percentile: int = 90,
) -> DataFrame:
    """Encodes every whole text, appends end_id, writes the ids in ascending
    order of id and returns the manifest: (file, start, n_docs, n_ids, n_bytes),
    one row per file, start being the ids of all files before it.

    Texts are divided by ranges of id; the sizes of the parts decide the number
    of files unless n_files is given. folder: a URI that all executors reach (by
    default one within the shared folder). A lost task writes its file anew.

    Nulls: a null text is an empty one (end id only); null ids come first. Rows
    of one id stand in the order of their texts' hashes and texts; equal rows are
    interchangeable, each is written. The id column must be of an integer type.
    An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be an integer column")
    folder = folder or f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(sent.value, end_id)

        def parts():
            for block in text_blocks(batches, 1, SLICE):
                yield (block.column(0), *tokens.encode(block.column(1)))

        segment = TaskContext.get().partitionId()
        path = f"{folder}/part-{segment:06d}-{uuid.uuid4().hex}.ids"
        found = _write_file(path, parts(), percentile)
        yield pa.RecordBatch.from_pydict({"segment": [segment], "file": [path], **{k: [v] for k, v in zip(("n_docs", "n_ids", "n_bytes"), found)}})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    parted = texts.repartitionByRange(n_files, *order[:2]) if n_files else texts.repartitionByRange(*order[:2])
    files = parted.sortWithinPartitions(*order).mapInArrow(run, "segment bigint, file string, n_docs bigint, n_ids bigint, n_bytes bigint")
    done = written(files.where("n_docs > 0"), "token-files")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    return written(done.select("file", before.alias("start"), "n_docs", "n_ids", "n_bytes"), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", packed: bool = False) -> DataFrame:
    """(id, start, ids) of every document of the files of a manifest: start
    counts the ids of all documents before it. ids is an array of integers, or
    with `packed` their bytes as little-endian unsigned 32-bit integers. A file
    is one task; the parts of it that are in memory are bounded but for a single
    document. A manifest without rows gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(path)
                for a, b, ids in file.parts():
                    offsets = np.concatenate([[0], np.cumsum(file.sizes[a:b])])
                    if packed:
                        data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    else:
                        data = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                    begins = start + file.ends[a:b] - file.sizes[a:b]
                    yield pa.RecordBatch.from_arrays([file.doc_ids.slice(a, b - a), pa.array(begins, pa.int64()), data], [id_col, "start", "ids"])

    files = manifest.select("file", "start")
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(run, f"`{id_col}` bigint, start bigint, ids {'binary' if packed else 'array<int>'}")

