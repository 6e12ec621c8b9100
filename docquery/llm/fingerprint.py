"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraph pieces; each piece (with its number among equal
pieces) has a 64-bit digest. A sketch has three rows of r cells of (count, xor of
digests, xor of check sums), r a power of two; a digest goes to one cell of each
row. The cells of two versions subtract; peeling the cells that hold a single
digest recovers the digests in which the versions differ. A sketch folds to half
its cells, so that fingerprints of different sizes can be compared as stored
(see compare). Where peeling gets stuck, the pair is tried again with larger
sketches of its texts, hashed anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a row of the smallest sketch; a fingerprint has a third of a cell of a row per digest at least.
LEAST_ROW, PER_CELL = 8, 3
#: Cells that are subtracted and peeled at once, about.
CELLS_AT_ONCE = 2_000_000
_BREAK = re.compile(r"\n+|(?<=[.,;:!?|])[ \t]+|(?<=[。．，、；：！？])\s*")
_LONG = 240
_RUN = re.compile(r"\S+\s*")
#: One in so many words, or characters of a run without spaces, ends a piece of a long line.
_WORDS, _CHARS = 12, 24
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CELL = np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")])


def _cut(line: str) -> Iterator[str]:
    """A long line, cut after words that end a piece by their own hash; a run of
    more than 240 characters, after characters that do so by theirs and the one
    before. What is put in before a place doesn't move the cuts after it."""
    start = 0
    for m in _RUN.finditer(line):
        if m.end() - m.start() > _LONG:
            codes = np.frombuffer(m[0].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            ends = np.flatnonzero(_mix(codes[1:] + (codes[:-1] << np.uint64(32)), 1) % np.uint64(_CHARS) == 0) + 2 + m.start()
            for e in ends.tolist():
                yield line[start:e]
                start = e
        elif zlib.crc32(m[0].strip().encode("utf-8", "surrogatepass")) % _WORDS == 0:
            yield line[start : m.end()]
            start = m.end()
    yield line[start:]


def paragraphs(text: str) -> list[str]:
    """Lines, cut further after punctuation; what is still longer than 240
    characters is cut by its content."""
    out = []
    for p in _BREAK.split(text):
        out += (x.strip() for x in _cut(p)) if len(p) > _LONG else [p.strip()]
    return [p for p in out if p]


def _digest(piece: str, nth: int) -> int:
    raw = piece.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(raw if not nth else raw + b"\n%d" % nth)  # pieces have no line breaks


def digests(text: str) -> np.ndarray:
    """One digest per piece; the n-th of equal pieces differs from the others,
    so that they are a set."""
    counts = Counter(paragraphs(text))
    found = [_digest(p, i) for p, n in counts.items() for i in range(n)]
    return np.unique(np.array(found, np.uint64))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Sketches(NamedTuple):
    """n sketches of three rows of r cells each, one after the other."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray
    r: int


def _cells(keys: np.ndarray, r: int, seed: int) -> list[np.ndarray]:
    """The cell of each digest in each row; half of r gives half the number, so
    that the two halves of a row add up to the row of the smaller sketch."""
    return [(_mix(keys, 3 * seed + k + 1) & np.uint64(r - 1)).astype(np.int64) + r * k for k in range(3)]


def sketches(sets: Sequence[np.ndarray], r: int, seed: int = 0) -> Sketches:
    n, m = len(sets), 3 * r
    keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    count, key, check = np.zeros(n * m, np.int32), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)
    sums = _mix(keys, 0) >> np.uint64(32)
    for cell in _cells(keys, r, seed):
        at = owner * m + cell
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, sums)
    return Sketches(count, key, check, r)


def _subtract(a: Sketches, b: Sketches) -> Sketches:
    return Sketches(a.count - b.count, a.key ^ b.key, a.check ^ b.check, a.r)


def _fold(s: Sketches, r: int) -> Sketches:
    """The same sketches with r cells a row."""
    while s.r > r:
        halves = [x.reshape(-1, 2, s.r // 2) for x in s[:3]]
        s = Sketches(halves[0].sum(axis=1, dtype=np.int32).ravel(), *(np.bitwise_xor.reduce(x, axis=1).ravel() for x in halves[1:]), s.r // 2)
    return s


def row_of(n_digests: int) -> int:
    """Cells of a row of the fingerprint of so many digests."""
    return max(LEAST_ROW, 1 << max(0, (n_digests // PER_CELL) - 1).bit_length())


def encode(sets: Sequence[np.ndarray]) -> list[str]:
    """The fingerprints: number of digests, cells of a row, the cells in base64."""
    out: list = [""] * len(sets)
    for r, places in _grouped(np.array([row_of(len(s)) for s in sets], np.int64)):
        s = sketches([sets[i] for i in places], r)
        rows = np.empty(len(places) * 3 * r, _CELL)
        rows["n"], rows["k"], rows["c"] = s.count, s.key, s.check
        for i, raw in zip(places, rows.reshape(len(places), 3 * r)):
            out[i] = f"{len(sets[i])}:{r}:{base64.b64encode(raw.tobytes()).decode()}"
    return out


def decode(fingerprint: str) -> tuple[int, Sketches]:
    """Number of digests and sketch of a fingerprint."""
    n, r, cells = fingerprint.split(":")
    raw = np.frombuffer(base64.b64decode(cells), _CELL)
    return int(n), Sketches(raw["n"].astype(np.int32), raw["k"].astype(np.uint64), raw["c"].astype(np.uint64), int(r))


def compare(one: str, two: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in one and only in two, from two stored fingerprints
    alone; None where they differ in more than their cells can tell, so that
    larger sketches of the texts are needed."""
    (_, a), (_, b) = decode(one), decode(two)
    r = min(a.r, b.r)
    [found], _ = _peeled(_subtract(_fold(a, r), _fold(b, r)), 1, 0)
    return found


def _grouped(rows: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(r, places) of the sketches with r cells a row, so many at once as their
    cells allow."""
    for r in np.unique(rows).tolist():
        places = np.flatnonzero(rows == r).tolist()
        step = max(1, CELLS_AT_ONCE // (3 * r))
        for k in range(0, len(places), step):
            yield r, places[k : k + step]


def _peeled(s: Sketches, n: int, seed: int) -> tuple[list, np.ndarray]:
    """Peels n subtracted sketches: for each the digests of either side, or None
    where it got stuck; and the cells of a row that its difference needs, about."""
    count, key, check, m = s.count.copy(), s.key.copy(), s.check.copy(), 3 * s.r
    free = ((count == 0) & (key == 0)).reshape(n, m).mean(axis=1)
    needed = np.where(free > 0, -np.log(np.maximum(free, 1e-9)) * s.r / 2, 4.0 * s.r)
    owners, keys, signs = [], [], []
    todo = np.flatnonzero(np.abs(count) == 1)
    while len(todo):
        todo = np.unique(todo)
        pure = todo[(np.abs(count[todo]) == 1) & (check[todo] == _mix(key[todo], 0) >> np.uint64(32))]
        order = np.lexsort((key[pure], pure // m))
        pure = pure[order]
        new = np.r_[True, (np.diff(pure // m) != 0) | (np.diff(key[pure]) != 0)][: len(pure)]
        pure = pure[new]
        if not len(pure):
            break
        k, sign, o = key[pure], count[pure], pure // m
        owners.append(o), keys.append(k), signs.append(sign)
        sums, touched = _mix(k, 0) >> np.uint64(32), []
        for cell in _cells(k, s.r, seed):
            at = o * m + cell
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key, at, k)
            np.bitwise_xor.at(check, at, sums)
            touched.append(at)
        todo = np.concatenate(touched)
    empty = ~((count != 0) | (key != 0) | (check != 0)).reshape(n, m).any(axis=1)
    join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])
    o, k, sign = join(owners, np.int64), join(keys, np.uint64), join(signs, np.int64)
    order = np.argsort(o, kind="stable")
    k, sign, ends = k[order], sign[order], np.searchsorted(o[order], np.arange(n + 1))
    out: list = [None] * n
    for j in np.flatnonzero(empty):
        kk, ss = k[ends[j] : ends[j + 1]], sign[ends[j] : ends[j + 1]]
        out[j] = kk[ss > 0], kk[ss < 0]
    return out, needed


def differences(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every pair the digests only in left and only in right. The first try
    subtracts the sketches that the fingerprints hold, folded to the smaller of
    the two. Where it gets stuck, new sketches are as large as the share of
    cells that stayed free says, twice as large at least, and hashed anew, until
    all digests come out; sketches that the difference in size alone would fill
    aren't tried."""
    out: list = [None] * len(left)
    apart = np.array([abs(len(a) - len(b)) for a, b in zip(left, right)], np.int64)
    row = np.array([min(row_of(len(a)), row_of(len(b))) for a, b in zip(left, right)], np.int64)
    open_, seed = np.arange(len(left)), 0
    while len(open_):
        if not seed:
            tried = open_[apart[open_] <= 3 * row[open_]]
        else:
            row[open_] = np.maximum(row[open_], apart[open_] // 2 + 1)
            row[open_] = 1 << np.ceil(np.log2(row[open_])).astype(np.int64)
            tried = open_
        for r, places in _grouped(row[tried]):
            pairs = tried[places]
            sides = [sketches([side[i] for i in pairs], r, seed) for side in (left, right)]
            found, needed = _peeled(_subtract(*sides), len(pairs), seed)
            for i, f, x in zip(pairs, found, needed):
                out[i] = f
                row[i] = max(2 * r, int(0.6 * x)) if f is None else r
        open_ = np.array([i for i in open_ if out[i] is None], np.int64)
        seed += 1
    return out


def likeness(n_left: int, n_right: int, n_different: int) -> float:
    """Shared digests over all digests of the pair; 1 if both have none."""
    return (n_left + n_right - n_different) / (n_left + n_right + n_different) if n_left + n_right else 1.0


def edited(text: str, other: str) -> str:
    """The last third of text, in code points, replaced by the first as many
    of other."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _least(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, text): at is what the rows are ordered by, downwards: the id, then
    a hash of the text."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("at"), text.alias("text"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 10) -> DataFrame:
    """(bucket, copy, at, text) ranges of rows in descending order of id, in each
    of which the last row (copy true) repeats the first of the next range.

    The first rows of the ranges are taken from a sample of the ids, about
    per_range of them for each range (what comes to the driver grows with the
    number of tasks only), so they are known beforehand and go to two ranges
    while the rows are dealt out: whole texts are shuffled once. The sample says
    where the ranges begin, nothing else. Null ids come last; after the last
    range comes the first again. Rows of one id are ordered by a hash of their
    text, so that ranges divide them too; ids may be of any type with an order.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = _least(docs, id_col, text_col)
    share = per_range * n / max(1, docs.count())
    drawn = slim.select("at", F.rand(7).alias("draw")).agg(F.max("at").alias("top"), F.collect_set(F.when(F.col("draw") < share, F.col("at"))).alias("some"))
    row = drawn.select("top", F.sort_array("some", asc=False).alias("some")).first()
    # Descending heads of the ranges; range i holds heads[i] >= at > heads[i + 1].
    heads = list(dict.fromkeys(map(tuple, [row.top, *row.some[::per_range]]))) if row.top is not None else []
    kind = slim.schema["at"].dataType
    step = max(1, round(len(heads) ** 0.5))  # found in two steps: among every step-th head, then between two of these
    groups = [heads[i : i + step] for i in range(0, len(heads), step)]
    firsts = F.array(*(F.struct(F.lit(g[0][0]).cast(kind["id"].dataType).alias("id"), F.lit(g[0][1]).cast("long").alias("hash")) for g in groups)).cast(T.ArrayType(kind))
    within = spark.createDataFrame(list(enumerate(groups, 1)), T.StructType([T.StructField("group", T.IntegerType()), T.StructField("heads", T.ArrayType(kind))]))
    below = lambda c: F.size(F.filter(c, lambda h: h >= F.col("at"))).cast("int")
    dealt = slim.withColumn("group", below(firsts)).join(F.broadcast(within), "group").withColumn("inner", below("heads"))  # as large as the heads
    dealt = dealt.withColumn("bucket", (F.col("group") - 1) * step + F.col("inner") - 1)
    is_head = F.element_at("heads", F.col("inner")).eqNullSafe(F.col("at"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, len(heads)))).alias("bucket"), F.lit(True).alias("copy"))
    here = F.struct("bucket", F.lit(False).alias("copy"))
    dealt = dealt.withColumn("to", F.explode(F.when(is_head, F.array(here, before)).otherwise(F.array(here))))
    return dealt.select("to.bucket", "to.copy", "at", "text")


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_recovered bigint"
_OUT = pa.schema(
    [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_recovered", pa.int64())]
)


def _compare(ids: list, texts: list[str], following: list[str], kind: pa.DataType) -> pa.RecordBatch:
    changed = [edited(t, o) for t, o in zip(texts, following)]
    own, new, nxt = ([digests(t) for t in x] for x in (texts, changed, following))
    near, lost = [], []
    for other in (new, nxt):
        found = differences(own, other)
        near.append([likeness(len(a), len(b), len(x) + len(y)) for a, b, (x, y) in zip(own, other, found)])
        lost.append([len(x) + len(y) for x, y in found])
    columns = [
        [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        encode(own), encode(new), *near, lost[0],
    ]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, f.type) for c, f in zip(columns, _OUT))], ["id", *_OUT.names])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 512, chars_at_once: int = 4_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited version (see edited; the
    other text is the next document's, by descending id), and how like they are.

    near_edited and near_next are the likeness of the fingerprints: what compare
    finds from the stored ones, or, where their cells don't suffice, what larger
    sketches of the two texts give. n_recovered counts the digests that peeling
    recovered between the two versions. Equal texts have equal fingerprints.
    Only the two columns are read, so others may have any name. A null text is
    empty; null ids come last in the order; repeated rows follow each other (row
    by row in one task, if they repeat both id and text); an empty table gives
    an empty result. Work in a task is cut into blocks of rows_at_once rows or
    chars_at_once characters, so it holds these and one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = with_next(docs, id_col, text_col)
    sorted_ = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", "copy", F.col("at").desc(), "text").select("bucket", "copy", "at.id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, texts, following, size = None, [], [], [], 0
        for batch in batches:
            for bucket, copy, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == bucket and not held[1]:
                    ids.append(held[2]), texts.append(held[3]), following.append(text)
                    size += len(text) + len(held[3])
                    if len(ids) >= rows_at_once or size >= chars_at_once:
                        yield _compare(ids, texts, following, batch.schema.field("id").type)
                        ids, texts, following, size = [], [], [], 0
                held = bucket, copy, i, text
        if ids:
            yield _compare(ids, texts, following, batch.schema.field("id").type)

    return sorted_.mapInArrow(run, f"id {kind}, {RESULT}").select(F.col("id").alias(id_col), *_OUT.names)


def changed_paragraphs(pairs: DataFrame, id_col: str, left_col: str, right_col: str) -> DataFrame:
    """For pairs of versions: (id, only_left, only_right, likeness), the
    paragraph pieces recovered by their digests, in the order of the text. Null
    versions are empty; a null id stays null; repeated rows are compared one by
    one; an empty table gives an empty result; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
            da, db = [digests(t) for t in a], [digests(t) for t in b]
            rows = []
            for t, o, x, y, (only_a, only_b) in zip(a, b, da, db, differences(da, db)):
                rows.append((_named(t, only_a), _named(o, only_b), likeness(len(x), len(y), len(only_a) + len(only_b))))
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, "only_left", "only_right", "likeness"]
            )

    kind = pairs.schema[id_col].dataType.simpleString()
    return pairs.select(id_col, left_col, right_col).mapInArrow(run, f"`{id_col}` {kind}, only_left array<string>, only_right array<string>, likeness double")


def _named(text: str, wanted: np.ndarray) -> list[str]:
    left, seen, out = set(wanted.tolist()), Counter(), []
    for p in paragraphs(text):
        if _digest(p, seen[p]) in left:
            out.append(p)
        seen[p] += 1
    return out
