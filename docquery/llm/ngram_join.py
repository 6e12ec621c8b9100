"""Similarity join of documents on sets of word n-grams, vertically partitioned.

The n-grams have a global order; it is cut into fragments, and fragments are
joined instead of documents.

1. Sets that are equal form one class (equal texts cost nothing after that).
2. First order: the hash. Two sets of sizes a and b that reach the threshold
   differ in at most D = (a + b)(100 - t) / (100 + t) n-grams. Cut into
   F = D + 1 + spare fragments of the order, they have at least 1 + spare equal
   fragments. A class in which fewer fragments occur in any other class has no
   partner. spare grows with D, so that fragments which are equal because they
   are empty or have one frequent n-gram don't suffice. F depends on a size
   class; a set plays two roles, in its own size class and as the larger set in
   the one below.
3. Second order, for the classes that remain: by number of sets that have the
   n-gram. A pair shares an n-gram in the first few of both (prefix filter) at
   places that leave enough behind (positional filter).
4. Overlaps are exact: the first order is cut into fragments, the partial
   overlaps of both sets are counted in each, and summed per pair.
5. Components don't need every pair. In the first round each prefix n-gram
   compares its sets with one leader. In the second, all pairs whose sets are
   then still in different components are compared.
6. Links lie within components, so they are counted there: a component is cut
   into blocks of classes, every two blocks meet once, and only the counts of
   their classes leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import slices, written
from docquery.llm.components import components

#: Equal fragments required of a pair, less one: so many, and one more for so
#: many differences.
SPARE, SPARE_PER = 2, 8
#: Fragments of the first order in which partial overlaps are counted: a power of two of its leading bits.
PART_BITS = 2
#: Keys that a task holds before it sends them, and that come together to be compared, about.
KEYS_AT_ONCE, KEYS_TO_COMPARE = 500_000, 1_000_000
#: N-grams and classes of a block in which links are counted, about.
GRAMS_AT_ONCE, CLASSES_AT_ONCE = 1_000_000, 512
#: Word hashes that a task remembers.
MEMORY = 100_000
#: Ids that are broadcast at most (24 bytes each); above, they are joined by shuffling.
BROADCAST_IDS = 1_000_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes | None, n: int, memory: Words) -> np.ndarray:
    """The sorted hashes of the distinct n-grams of lower-cased words; with
    fewer words the whole sequence is one; without words there are none. Bytes
    split at the white space of the contract and lower-case A-Z only."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(_C) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(total))


def set_digest(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


@lru_cache(4)
def _size_classes(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, number of fragments and spare of every size class. A set of one
    class and a larger similar one lie in the same class or the next. Without
    room for a difference there are no fragments: equal sets are found already."""
    lows, pieces, spares = [1], [], []
    while lows[-1] < 2**40:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * 100 // t + 1))
        a = lows[-1] - 1
        d = (a + a * 100 // t) * (100 - t) // (100 + t)
        spares.append(SPARE + d // SPARE_PER)
        pieces.append(d + 1 + spares[-1] if d else 0)
    return np.array(lows), np.array(pieces), np.array(spares)


def fragment_keys(grams: np.ndarray, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """(role, keys of the fragments) for both roles of a set."""
    lows, pieces, _ = _size_classes(t)
    own = int(np.searchsorted(lows, len(grams), "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams + np.uint64(1)))])
    for role, c in enumerate((own, own - 1)):
        if c >= 0 and (f := int(pieces[c])):
            at = ((grams >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
            ends = np.searchsorted(at, np.arange(f + 1, dtype=np.uint64))
            names = np.arange(f, dtype=np.uint64) * np.uint64(_C) + np.uint64(c)
            yield role, _mix(_mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64)) ^ _mix(names))


def _shared(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts (key, owner) without repeats; which of them share their key, and
    which to send on: of each key the first and last owner, enough for others
    to see that they are not alone."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])] if len(keys) else np.zeros(0, bool)
    keys, owners = keys[new], owners[new]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(keys) else first
    return keys, owners, np.stack([~(first & last), first | last]) if len(keys) else np.zeros((2, 0), bool)


def _documents(docs: DataFrame, n_words: int) -> DataFrame:
    """(id, text_hash, n, owner): size and digest of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in slices(batches):
            found = []
            for text in batch.column(2).to_pylist():
                grams = shingles(text, n_words, memory)
                found.append((len(grams), set_digest(grams)))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_hash", "n", "owner"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text_hash bigint, n bigint, owner bigint")


def _pack(keys: np.ndarray, owners: np.ndarray) -> bytes:
    """Pairs in the order of their owners: number of owners, the owners, how
    many keys each has, the low halves of the keys. (What the part of a key says
    of its high half is enough: a wrong match only makes a candidate more.)"""
    who, many = np.unique(owners, return_counts=True)
    return np.uint32(len(who)).tobytes() + who.tobytes() + many.astype(np.uint32).tobytes() + keys.astype(np.uint32).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(raw, np.uint32, 1)[0])
    who, many = np.frombuffer(raw, np.int64, m, 4), np.frombuffer(raw, np.uint32, m, 4 + 8 * m)
    return np.frombuffer(raw, np.uint32, -1, 4 + 12 * m), np.repeat(who, many)


def _shared_keys(docs: DataFrame, n_words: int, t: int, n_parts: int) -> DataFrame:
    """(owner, n): how many of an owner's fragment keys others have as well; the
    lowest bit of an owner is its role. Keys go packed to the task of their
    part, each at most twice from one block of a task: what a block shares
    within itself is counted there and goes along."""
    schema = pa.schema([("part", pa.int32()), ("owner", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def send(keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, owners, (common, sent) = _shared(keys, owners)
        who, many = np.unique(owners[common], return_counts=True)
        keys, owners = keys[sent], owners[sent]
        part = ((keys >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int32)
        order = np.lexsort((owners, part))
        keys, owners, part = keys[order], owners[order], part[order]
        ends = np.searchsorted(part, np.arange(n_parts + 1))
        some = np.flatnonzero(np.diff(ends))
        data = [_pack(keys[ends[p] : ends[p + 1]], owners[ends[p] : ends[p + 1]]) for p in some]
        yield pa.RecordBatch.from_arrays([pa.array(who % n_parts, pa.int32()), pa.array(who), pa.array(many), pa.nulls(len(who), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(data, pa.binary())], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held_k, held_o, size = Words(), [], [], 0
        seen: set[int] = set()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                grams = shingles(text, n_words, memory)
                owner = set_digest(grams)
                if len(grams) and owner not in seen:
                    seen.add(owner)
                    for role, keys in fragment_keys(grams, t):
                        held_k.append(keys), held_o.append(np.full(len(keys), owner & -2 | role, np.int64))
                        size += len(keys)
            if size >= KEYS_AT_ONCE:
                yield from send(np.concatenate(held_k), np.concatenate(held_o))
                held_k, held_o, size = [], [], 0
                seen.clear()
        if size:
            yield from send(np.concatenate(held_k), np.concatenate(held_o))

    def meet(table: pa.Table) -> pa.Table:
        packed = [_unpack(x) for x in table.column("data").to_pylist() if x is not None]
        counted = table.filter(pc.is_valid(table.column("owner")))
        keys = np.concatenate([np.zeros(0, np.uint32), *(k for k, _ in packed)])
        owners = np.concatenate([np.zeros(0, np.int64), *(o for _, o in packed)])
        _, owners, (common, _) = _shared(keys, owners)
        who, many = np.unique(owners[common], return_counts=True)
        both = [np.concatenate([counted.column(c).to_numpy(), x]) for c, x in (("owner", who), ("n", many))]
        return pa.table({"owner": pa.array(both[0], pa.int64()), "n": pa.array(both[1], pa.int64())})

    parts = docs.select("text").mapInArrow(cut, "part int, owner bigint, n bigint, data binary")
    return parts.groupBy("part").applyInArrow(meet, "owner bigint, n bigint")


def _sets(docs: DataFrame, n_words: int) -> DataFrame:
    """(owner, n, grams) of documents (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in slices(batches):
            found = [shingles(t, n_words, memory) for t in batch.column(0).to_pylist()]
            grams = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            owners = pa.array([set_digest(g) for g in found], pa.int64())
            yield pa.RecordBatch.from_arrays([owners, pa.array([len(g) for g in found], pa.int64()), pa.ListArray.from_arrays(ends, grams)], ["owner", "n", "grams"])

    return docs.mapInArrow(run, "owner bigint, n bigint, grams array<bigint>")


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def _prefixes(sets: DataFrame, t: int) -> DataFrame:
    """(gram, owner, n, place, lesser) of the n-grams that sets have in common,
    as far as the prefix of a set goes; lesser: within the shorter prefix that
    is enough against sets of the same size or larger ones. N-grams of one set
    come first in the order, so place counts from their number."""
    grams = sets.select("owner", F.explode("grams").alias("gram"))
    # Written, so that the join sees the sizes of both sides and divides the n-grams that many sets have.
    common = written(grams.groupBy("gram").agg(F.count("*").cast("int").alias("sets")).where("sets > 1"), "common")
    ordered = (
        grams.join(common, "gram").groupBy("owner")
        .agg(F.sort_array(F.collect_list(F.struct("sets", "gram"))).alias("common"))
        .join(sets.select("owner", "n"), "owner")
        .withColumn("alone", F.col("n") - F.size("common"))
        .withColumn("long", F.col("n") - _ceil(F.col("n") * t, 100) + 1)
        .withColumn("short", F.col("n") - _ceil(F.col("n") * 2 * t, 100 + t) + 1)
        .where("long > alone")
        .withColumn("common", F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("long") - F.col("alone")).cast("int")))
    )
    return ordered.select("owner", "n", "alone", "short", F.posexplode("common").alias("k", "c")).select(
        F.col("c.gram").alias("gram"), "owner", "n", (F.col("alone") + F.col("k")).alias("place"), (F.col("alone") + F.col("k") < F.col("short")).alias("lesser")
    )


def _possible(a: str, b: str, t: int) -> Column:
    """Sizes allow the threshold, and what the places leave allows the overlap."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = 1 + F.least(n_a - F.col(f"{a}.place") - 1, n_b - F.col(f"{b}.place") - 1)
    return (100 * F.least(n_a, n_b) >= t * F.greatest(n_a, n_b)) & (left * (100 + t) >= t * (n_a + n_b))


def _links(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Those of pairs (x, y) that reach the threshold. The sets' n-grams, ordered
    by hash, are cut where the leading bits change; partial overlaps are counted
    for each fragment and summed per pair."""
    part = lambda g, p: F.filter(g, lambda x: F.shiftrightunsigned(x, 64 - PART_BITS) == p)
    cut = sets.select("owner", "n", F.posexplode(F.array(*(part("grams", p) for p in range(2**PART_BITS)))).alias("part", "grams"))
    one = cut.select(F.col("owner").alias("x"), F.col("n").alias("n_x"), "part", F.col("grams").alias("g_x"))
    two = cut.select(F.col("owner").alias("y"), F.col("n").alias("n_y"), "part", F.col("grams").alias("g_y"))
    overlap = F.size(F.array_intersect("g_x", "g_y"))
    sums = pairs.join(one, "x").join(two, ["y", "part"]).groupBy("x", "y", "n_x", "n_y").agg(F.sum(overlap).alias("both"))
    return sums.where((100 + t) * F.col("both") >= t * (F.col("n_x") + F.col("n_y"))).select("x", "y")


def _linked(one: list[np.ndarray], two: list[np.ndarray], t: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of one its place, and the places of the sets of two that
    reach the threshold with it."""
    sizes = np.array([len(g) for g in two])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    starts = np.r_[0, np.cumsum(sizes)]
    all_, ids = np.unique(np.concatenate([two[k] for k in order]), return_inverse=True)
    has = np.zeros(len(all_), np.int32)
    for k, grams in enumerate(one):
        low, high = np.searchsorted(100 * sizes, t * len(grams)), np.searchsorted(t * sizes, 100 * len(grams), "right")
        if low < high:
            at = np.searchsorted(all_, grams)
            at = at[at < len(all_)]
            at = at[np.isin(all_[at], grams)]
            has[at] = 1
            both = np.add.reduceat(has[ids[starts[low] : starts[high]]], starts[low:high] - starts[low])
            has[at] = 0
            yield k, order[low:high][(100 + t) * both >= t * (sizes[low:high] + len(grams))]


def _link_counts(sets: DataFrame, members: DataFrame, t: int) -> DataFrame:
    """(owner, linked): the number of documents in the other classes that each
    class links with. members: (owner, root, members) of the classes of
    components with more than one; sets: (owner, n, grams)."""
    own = sets.join(members, "owner")
    blocks = own.groupBy("root").agg(F.greatest(_ceil(F.sum("n"), GRAMS_AT_ONCE), _ceil(F.count("*"), CLASSES_AT_ONCE)).cast("int").alias("blocks"))
    dealt = (
        own.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int"))
        .select("root", "owner", "members", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "owner", "members", "grams")
    )

    def meet(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        second = table.column("second").to_numpy()
        owners, members = table.column("owner").to_numpy(), table.column("members").to_numpy()
        grams = [g.values.to_numpy() for g in table.column("grams")]
        one = np.flatnonzero(~second)
        two = one if i == j else np.flatnonzero(second)
        count = np.zeros(len(owners), np.int64)
        if len(one) and len(two):
            for k, found in _linked([grams[x] for x in one], [grams[x] for x in two], t):
                found = two[found]
                found = found[found != one[k]]
                count[one[k]] += members[found].sum()
                if i != j:
                    count[found] += members[one[k]]
        return pa.table({"owner": pa.array(owners, pa.int64()), "linked": pa.array(count)})

    # Dealt out by block: what is there by component already would leave all blocks of a large one in one task.
    return dealt.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(meet, "owner bigint, linked bigint").groupBy("owner").agg(F.sum("linked").alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: int = 80, links: bool = True) -> DataFrame:
    """One row per document: (id, text_hash, n_shingles, component, component_id,
    n_links); n_links only if links are asked for.

    Two documents link when 100 * |A and B| >= threshold * |A or B| for their
    sets of n_words-word shingles; component_id is the smallest id reachable by
    links. component is the component's own key: equal for the documents of a
    component, also where ids are null or repeated. n_links is the number of
    other documents that the document links with, those with an equal set
    included.

    Only the two columns are read, so others may have any name. A null or empty
    text, or one without words, has an empty set, which links with nothing: its
    component_id is its own id, its component null and n_links 0. A null id never is a
    component_id unless all ids of the component are null. Repeated rows are
    documents of their own with equal sets, so they are linked. An empty table
    gives an empty result. Sets are compared by 64-bit hashes of shingles, and
    equal sets recognised by a 64-bit digest and their size.
    """
    t = threshold
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    rows = written(_documents(slim, n_words), "sets")
    lows, _, spares = _size_classes(t)
    keys = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n * 4 * (100 - t) // 100  # at most: two roles, 2 (1 - t) n fragments
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // KEYS_TO_COMPARE)
    shared = _shared_keys(slim, n_words, t, n_parts).groupBy("owner").agg(F.sum("n").alias("shared"))
    shared = shared.select(F.col("owner").bitwiseAND(F.lit(-2)).alias("even"), F.col("owner").bitwiseAND(F.lit(1)).cast("int").alias("role"), "shared")
    classes = rows.where("n > 0").groupBy("owner", "n").agg(F.min(F.struct("id", "text_hash")).alias("pick"), F.min("id").alias("least"), F.count("*").alias("members"))
    lows, spares = (F.array(*(F.lit(int(x)) for x in c)) for c in (lows, spares))
    size_class = F.size(F.filter(lows, lambda x: x <= F.col("n")))
    may = classes.withColumn("even", F.col("owner").bitwiseAND(F.lit(-2))).join(shared, "even").where(F.col("shared") > F.element_at(spares, F.greatest(F.lit(1), size_class - F.col("role"))))
    chosen = written(may.select("owner", "pick.id", "pick.text_hash").distinct(), "chosen")
    listed = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    picked = slim.alias("s").join(
        listed.select(F.col("id").alias("pick_id"), F.col("text_hash").alias("pick_hash")).distinct(),
        F.col("s.id").eqNullSafe(F.col("pick_id")) & (F.col("s.text_hash") == F.col("pick_hash")),
    )
    sets = written(_sets(picked.select("text"), n_words).groupBy("owner", "n").agg(F.first("grams").alias("grams")), "grams")
    prefixes = written(_prefixes(sets, t), "prefixes")

    leaders = written(prefixes.groupBy("gram").agg(F.min(F.struct("place", "n", "owner")).alias("l")).select("gram", "l.*"), "leaders")
    met = leaders.alias("a").join(prefixes.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.owner") != F.col("b.owner")) & _possible("a", "b", t))
    first = met.select(F.least("a.owner", "b.owner").alias("x"), F.greatest("a.owner", "b.owner").alias("y")).distinct()
    tried = written(first, "pairs")
    stars = components(_links(tried, sets, t))

    rooted = written(prefixes.join(stars.withColumnRenamed("node", "owner"), "owner", "left").withColumn("root", F.coalesce("root", "owner")), "rooted")
    a, b = rooted.where("lesser").alias("a"), rooted.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.owner") < F.col("b.owner")))
    rest = a.join(b, (F.col("a.gram") == F.col("b.gram")) & smaller & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", t))
    second = rest.select(F.least("a.owner", "b.owner").alias("x"), F.greatest("a.owner", "b.owner").alias("y")).distinct()
    more = _links(second.join(tried, ["x", "y"], "left_anti"), sets, t)
    found = components(stars.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more))

    rooted_classes = classes.join(found.withColumnRenamed("node", "owner"), "owner", "left").withColumn("root", F.coalesce("root", "owner"))
    least = rooted_classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted_classes.join(least, "root").select("owner", F.col("root").alias("component"), "component_id", (F.col("members") - 1).alias("n_links"))
    if links:
        nodes = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "owner")
        counts = written(_link_counts(sets, nodes.join(classes.select("owner", "members"), "owner"), t), "counts")
        named = named.join(counts, "owner", "left").withColumn("n_links", F.col("n_links") + F.coalesce("linked", F.lit(0))).drop("linked")
    out = rows.where("n > 0").join(named, "owner").unionByName(
        rows.where("n = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("id")).withColumn("n_links", F.lit(0).cast("long")), allowMissingColumns=True
    )
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), "component", "component_id", *["n_links"] * links)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component of found (a result
    of near_duplicates over docs): the one with the smallest id stays, of equal
    ids the one with the smallest hash of its text, of rows that repeat one of
    them. Documents without words stay. All columns stay as they are."""
    rows = found.select(F.col(id_col).alias("id"), "text_hash", "component", "component_id").where("component is not null")
    # The smallest id is named in each row, so only rows that have it are compared, mostly one of a component.
    least = F.col("id").eqNullSafe(F.col("component_id"))
    first = written(rows.where(least).groupBy("component", "id", "text_hash").agg(F.count("*").alias("times")), "first")
    kept = first.groupBy("component").agg(F.min("text_hash").alias("keep")).withColumnRenamed("component", "of")
    judged = first.join(kept, F.col("component") == F.col("of")).withColumn("stays", F.col("text_hash") == F.col("keep"))
    marked = judged.where(~F.col("stays") | (F.col("times") > 1)).select("id", "text_hash", "stays")
    marked = written(marked.unionByName(rows.where(~least).select("id", "text_hash").distinct().withColumn("stays", F.lit(False))), "dropped")
    listed = F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked
    match = lambda m: F.col(f"d.{id_col}").eqNullSafe(F.col(f"{m}.id")) & (F.xxhash64(f"d.{text_col}") == F.col(f"{m}.text_hash"))
    single = docs.alias("d").join(listed.alias("m"), match("m"), "left_anti")
    repeated = docs.alias("d").join(listed.where("stays").alias("m"), match("m"), "left_semi").dropDuplicates([id_col, text_col])
    return single.select(*(F.col(f"d.{c}") for c in docs.columns)).unionByName(repeated)
