"""N-best segmentation: encoding and decoding with a piece vocabulary.

For a chunk (see pieces), a forward Viterbi pass gives the best score up to each
character. A backward A-star search from the end then takes paths in the order
of (score so far + forward score), which is exact: the first N paths that reach
the start are the N best. Segmentations of a text are choices of one path per
chunk; the N best of these come from a queue over the losses of the chunks.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, count, islice
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquery.llm.common import text_blocks
from docquery.llm.pieces import DEFAULT_MODEL, SPACE, Lattice, Memo, Vocabulary, lattice, load, normalized
from docquery.llm.token_counts import MEMORY

#: Bytes of text whose chunks are looked up together.
BLOCK = 1 << 18


def n_best_paths(lat: Lattice, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    """Up to n (score, ids), best first. The first is the one that Viterbi
    takes: among equals, the longest last piece. Later ones of equal score come
    in the order of the search: nearer to the start first, then longer pieces."""
    size = len(chunk)
    into: list[list] = [[] for _ in range(size + 1)]
    best: list = [None] * (size + 1)
    best[0] = 0.0
    for a, b, score, i in lat.edges(chunk):
        into[b].append((a, score, i))  # longer pieces first
        if best[b] is None or best[a] + score > best[b]:
            best[b] = best[a] + score
    found: list[tuple[float, list[int]]] = []
    # (-(score of the path so far + forward score), start, order, score so far, path)
    queue: list = [(-best[size], size, 0, 0, None)]
    pushed = 0
    while queue and len(found) < n:
        _, at, _, behind, path = heapq.heappop(queue)
        if at == 0:
            steps = []
            while path is not None:
                step, path = path
                steps.append(step)
            found.append((behind, lat.ids_of(chunk, steps)))
            continue
        for a, score, i in into[at]:
            pushed += 1
            heapq.heappush(queue, (-(behind + score + best[a]), a, pushed, behind + score, ((a, at, i), path)))
    return found


def best_path(lat: Lattice, chunk: str) -> tuple[float, float | None, bytes]:
    """The forward pass: (best score, loss of the second-best segmentation or
    None, ids of the best one as 32-bit numbers). Among equal sums
    the longest last piece wins."""
    if not lat.singles.issuperset(chunk):  # the search has edges for unknown characters
        found = n_best_paths(lat, chunk, 2)
        (score, ids), loss = found[0], found[0][0] - found[1][0] if len(found) > 1 else None
        return score, loss, array("i", ids).tobytes()
    size = len(chunk)
    best, second, back = [-inf] * (size + 1), [-inf] * (size + 1), [None] * (size + 1)
    best[0] = 0.0
    for last, (length, score, i) in lat.automaton.iter(chunk):
        b = last + 1
        a = b - length
        total = best[a] + score
        if total > best[b]:
            next_, best[b], back[b] = best[b], total, (a, i)
            if (other := second[a] + score) > next_:
                next_ = other
            if next_ > second[b]:
                second[b] = next_
        elif total > second[b]:
            second[b] = total
    ids, at = [], size
    while at:
        at, i = back[at]
        ids.append(i)
    ids.reverse()
    return best[size], None if second[size] == -inf else best[size] - second[size], array("i", ids).tobytes()


class Steps:
    """The pieces as a table of steps from node to node, by which the forward
    pass of best_path goes through many chunks at once.

    Node 0 is the start; nodes that go on have a row of next nodes by character
    (0: none). Characters are numbered from 1, those of most steps first, as many
    as CELLS and 16 bits allow; chunks with another one, or one that is no piece,
    aren't taken."""

    CELLS = 1 << 24

    def __init__(self, lat: Lattice):
        next_: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        for piece, i, score in lat.v.pieces:
            if len(piece) > 1 or piece in lat.inner:
                at = 0
                for c in piece:
                    if (to := next_[at].get(c)) is None:
                        to = next_[at][c] = len(next_)
                        next_.append({})
                    at = to
                ends[at] = (len(piece), score, i)
        known = Counter(c for of in next_ for c in of if c in lat.singles)
        self.going = sum(map(bool, next_[1:])) + 1
        self.width = 1 + min(len(known), max(1, self.CELLS // self.going - 1), (1 << 16) - 1)
        number = {c: k for k, (c, _) in enumerate(known.most_common(self.width - 1), 1)}
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in number]] = list(number.values())
        # nodes that go on come first, so that only they need rows
        order = sorted(range(len(next_)), key=lambda k: k > 0 and not next_[k])
        place = np.empty(len(next_), np.int32)
        place[order] = np.arange(len(next_))
        self.to = np.zeros(self.going * self.width, np.uint16 if len(next_) < 1 << 16 else np.int32)
        for k in order[: self.going]:
            for c, to in next_[k].items():
                if c in number:
                    self.to[place[k] * self.width + number[c]] = place[to]
        self.size, self.score, self.id = np.zeros(len(next_), np.int32), np.zeros(len(next_)), np.zeros(len(next_), np.int32)
        for k, of in ends.items():
            self.size[place[k]], self.score[place[k]], self.id[place[k]] = of

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The characters' numbers, chunk after chunk; 0 for what isn't taken."""
        return self.number[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]

    def best_paths(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What best_path finds for chunks of these sizes (at least 1), whose
        characters' numbers follow each other: scores, losses (infinite: no
        second one), numbers of ids, and the ids one after the other."""
        n, longest = len(sizes), int(sizes.max())
        order = np.argsort(-sizes, kind="stable")  # chunks that go on to a place are the first ones
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        at = np.repeat(rank, sizes)
        chars = np.zeros((longest, n), np.uint16)
        chars[np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes), at] = numbers
        best, second = np.full((longest + 1, n), -inf), np.full((longest + 1, n), -inf)
        back = np.zeros((longest + 1, n), np.int32)
        best[0] = 0
        for a in range(longest):
            rows = np.arange(np.count_nonzero(sizes > a))
            node = np.zeros(len(rows), np.int64)
            for b in range(a, longest):
                node = self.to[node * self.width + chars[b, rows]].astype(np.int64)
                on = np.flatnonzero(node)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                hit = np.flatnonzero(self.size[node])
                if len(hit):
                    r, end = rows[hit], node[hit]
                    score = self.score[end]
                    total, old = best[a, r] + score, best[b + 1, r]
                    second[b + 1, r] = np.maximum(np.maximum(second[b + 1, r], second[a, r] + score), np.minimum(total, old))
                    best[b + 1, r] = np.maximum(total, old)
                    better = np.flatnonzero(total > old)  # longer pieces come first
                    back[b + 1, r[better]] = end[better]
                on = np.flatnonzero(node < self.going)
                rows, node = rows[on], node[on]
        ordered, every = sizes[order], np.arange(n)
        scores, seconds = best[ordered, every][rank], second[ordered, every][rank]
        steps, left, rows = [], ordered.copy(), every
        while len(rows):
            end = back[left[rows], rows]
            steps.append((rows, self.id[end]))
            left[rows] -= self.size[end]
            rows = rows[left[rows] > 0]
        counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n)[rank]
        last = (np.cumsum(counts) - 1)[order]
        ids = np.empty(counts.sum(), np.int32)
        for k, (rows, of) in enumerate(steps):
            ids[last[rows] - k] = of
        return scores, scores - seconds, counts, ids


@lru_cache(2)
def steps_of(vocabulary: Vocabulary) -> Steps:
    """Built once per worker process."""
    return Steps(lattice(vocabulary))


class Paths:
    """What is remembered of chunks: their best paths, in arrays by the number
    that a chunk has in the order of appearance, and the n best of those that
    took part in a choice. Once chunks of CHARS characters are known, all are
    forgotten."""

    CHARS, LONG = 4 * MEMORY, 64

    def __init__(self, lat: Lattice, n: int):
        self.lat, self.n, self.steps = lat, n, steps_of(lat.v)
        self.several = Memo(self._several, MEMORY // 20)
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.chars = 0
        self.score, self.loss = array("d"), array("d")
        self.starts, self.ids = array("q", [0]), array("i")  # ids of chunk k: starts[k] to starts[k + 1]

    def _several(self, chunk: str) -> list[tuple[float, bytes]]:
        found = n_best_paths(self.lat, chunk, self.n)
        return [(found[0][0] - s, array("i", ids).tobytes()) for s, ids in found]

    def of(self, chunks: list[str]) -> np.ndarray:
        """The numbers of chunks, valid until the next call."""
        if self.chars > self.CHARS or len(self.number) >= len(self.starts):  # or a call broke off
            self._forget()
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        return out

    def _learn(self, chunks: list[str]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        numbers = self.steps.numbers(chunks)
        taken = (np.minimum.reduceat(numbers, np.cumsum(sizes) - sizes) > 0) & (sizes < self.LONG)
        score, loss, counts = np.empty(len(chunks)), np.empty(len(chunks)), np.empty(len(chunks), np.int64)
        if taken.any():
            score[taken], loss[taken], counts[taken], ids = self.steps.best_paths(sizes[taken], numbers[np.repeat(taken, sizes)])
        others = {}
        for k in np.flatnonzero(~taken).tolist():
            score[k], other, others[k] = best_path(self.lat, chunks[k])
            loss[k], counts[k] = inf if other is None else other, len(others[k]) // 4
        if others:
            whole = np.empty(counts.sum(), np.int32)
            if taken.any():
                whole[np.repeat(taken, counts)] = ids
            whole[np.repeat(~taken, counts)] = np.frombuffer(b"".join(others.values()), np.int32)
            ids = whole
        self.chars += int(sizes.sum())
        self.score.frombytes(score.tobytes())
        self.loss.frombytes(loss.tobytes())
        self.starts.frombytes((np.cumsum(counts) + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())


@lru_cache(2)
def paths_of(vocabulary: Vocabulary, n: int) -> Paths:
    """A worker process keeps what it remembers for its next tasks."""
    return Paths(lattice(vocabulary), n)


def n_best_choices(losses: Sequence[Sequence[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """losses: per chunk the losses of its paths against its best, rising, from
    0. Returns up to n (loss, {chunk: path other than the first}), least first.

    Only the n - 1 chunks with the smallest first losses can take part: any
    other choice is worse than n - 1 single changes and none. States go from
    chunk to chunk in the order of the first loss: the last changed chunk takes
    its next path, or the next chunk is changed as well or instead.
    """
    some = [(x[1], k) for k, x in enumerate(losses) if len(x) > 1]
    order = [k for _, k in heapq.nsmallest(n - 1, some)]
    found: list = [(0, {})]
    queue: list = [(losses[order[0]][1], ((0, 1),))] if order else []
    while queue and len(found) < n:
        loss, picks = heapq.heappop(queue)
        found.append((loss, {order[j]: p for j, p in picks}))
        j, p = picks[-1]
        of = losses[order[j]]
        if p + 1 < len(of):
            heapq.heappush(queue, (loss - of[p] + of[p + 1], (*picks[:-1], (j, p + 1))))
        if j + 1 < len(order):
            first = losses[order[j + 1]][1]
            heapq.heappush(queue, (loss + first, (*picks, (j + 1, 1))))
            if p == 1:
                heapq.heappush(queue, (loss - of[1] + first, (*picks[:-1], (j + 1, 1))))
    return found


def segment_all(paths: Paths, texts: Sequence[str | None]) -> list[list[tuple[float, bytes]]]:
    """Per text its n best (score, ids), best first. Only the n - 1 chunks
    whose second-best segmentations lose least can differ, so only these are
    searched for more."""
    split = [paths.lat.chunks(normalized(t)) for t in texts]
    of = paths.of(list(chain.from_iterable(split)))
    starts = np.frombuffer(paths.starts, np.int64)
    first, counts = starts[of], starts[of + 1] - starts[of]
    at = np.concatenate([[0], np.cumsum(counts)])  # where the ids of chunks begin, in all texts
    ids = _taken(np.frombuffer(paths.ids, np.int32), first, counts)
    score, loss = np.frombuffer(paths.score)[of], np.frombuffer(paths.loss)[of]
    out, a = [], 0
    for chunks in split:
        b = a + len(chunks)
        top, begin, end = sum(score[a:b].tolist()), 4 * int(at[a]), 4 * int(at[b])
        found = [(top, ids[begin:end])]
        if paths.n > 1 and chunks:
            near = _least(loss[a:b], paths.n - 1)
            several = [paths.several[chunks[k]] for k in near]
            for lost, changed in n_best_choices([[x for x, _ in s] for s in several], paths.n)[1:]:
                parts, done = [], begin
                for j, turn in sorted(changed.items(), key=lambda x: near[x[0]]):
                    k = a + near[j]
                    parts += [ids[done : 4 * int(at[k])], several[j][turn][1]]
                    done = 4 * int(at[k + 1])
                found.append((top - lost, b"".join([*parts, ids[done:end]])))
        out.append(found)
        a = b
    return out


def _taken(values: np.ndarray, first: np.ndarray, counts: np.ndarray, step: int = 1 << 18) -> bytes:
    """Stretches of values, one after the other; the places of `step` stretches
    are in memory at once."""
    out = []
    for k in range(0, len(first), step):
        f, c = first[k : k + step], counts[k : k + step]
        ends = np.cumsum(c)
        out.append(values[np.repeat(f - ends + c, c) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def _least(loss: np.ndarray, n: int) -> list[int]:
    """Places of the n least finite losses, least first, among equals the first."""
    if n < len(loss):
        near = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1])
    else:
        near = np.arange(len(loss))
    near = near[np.argsort(loss[near], kind="stable")][:n]
    return near[loss[near] < inf].tolist()


def segment(paths: Paths, text: str | None) -> list[tuple[float, bytes]]:
    """segment_all of one text."""
    return segment_all(paths, [text])[0]


def all_decode(lat: Lattice, texts: Sequence[str | None], found: Sequence[Sequence[tuple[float, bytes]]]) -> list[bool]:
    """Per text, whether all of its segmentations decode to it. The ids of all
    texts are looked up together; what isn't the text's bytes is decoded by itself."""
    out = [True] * len(texts)
    wanted = [normalized(t).replace(SPACE, " ").encode() for t in texts]
    for turn in range(max(map(len, found), default=0)):
        rows = [k for k, x in enumerate(found) if len(x) > turn]
        ids = [found[k][turn][1] for k in rows]
        flat = np.frombuffer(b"".join(ids), np.int32)
        spelt = lat.spelt.take(pa.array(flat))
        starts = np.frombuffer(spelt.buffers()[1], np.int64) if len(flat) else np.zeros(1, np.int64)
        ends = starts[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        data = bytes(spelt.buffers()[2] or b"")
        for k, i, a, b in zip(rows, ids, ends, ends[1:]):
            if data[a:b] != wanted[k]:
                out[k] &= lat.decode(np.frombuffer(i, "<i4").tolist()) == (texts[k] or "").replace(SPACE, " ")
    return out


def encode(
    docs: DataFrame,
    n_best: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | Vocabulary = DEFAULT_MODEL,
) -> DataFrame:
    """(id, segmentations) for every row of docs: the n_best best segmentations
    of the whole text, array of (score, ids), best first; fewer where there are
    no more. Characters outside the vocabulary become pieces of their bytes.

    Only the two columns are read, so others may have any name. A null or empty
    text has one segmentation, of no pieces, with score 0; a null id stays null;
    repeated rows are segmented one by one; an empty table gives an empty
    result. Among equal scores the order is that of n_best_paths.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else load(model))
    item = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(lattice(vocabulary.value), n_best)  # let go after the task: other operators may follow in this process
        for batch in text_blocks(batches, 1, BLOCK):
            rows = segment_all(paths, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(rows, item)], [id_col, "segmentations"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, segmentations array<struct<score: double, ids: array<int>>>")


def survey(docs: DataFrame, n_best: int, id_col: str = "doc_id", text_col: str = "text", model: str | Vocabulary = DEFAULT_MODEL) -> DataFrame:
    """For every row of docs what encode finds, in short, and whether decoding
    gives the text back: (id, n_pieces, scores, ids_sha256, round_trip). scores
    and ids_sha256 have an item per segmentation; the digest is of the ids as
    32-bit little-endian numbers; n_pieces is of the best one; round_trip holds
    if all of them decode to the text. Odd rows as in encode."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else load(model))
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_()]
    names = ["n_pieces", "scores", "ids_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = paths_of(vocabulary.value, n_best)
        for batch in text_blocks(batches, 1, BLOCK):
            texts = batch.column(1).to_pylist()
            rows = []
            found = segment_all(paths, texts)
            for of, back in zip(found, all_decode(paths.lat, texts, found)):
                rows.append((len(of[0][1]) // 4, [s for s, _ in of], [hashlib.sha256(i).hexdigest() for _, i in of], back))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pieces bigint, scores array<double>, ids_sha256 array<string>, round_trip boolean")


def _packed(rows: list, item: pa.DataType) -> pa.Array:
    """The nested array, built from flat buffers."""
    flat = [x for r in rows for x in r]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]).astype(np.int32))
    ids = pa.array(np.frombuffer(b"".join(i for _, i in flat), "<i4"))
    lists = pa.ListArray.from_arrays(ends(len(i) // 4 for _, i in flat), ids)
    scores = pa.array([s for s, _ in flat], pa.float64())
    structs = pa.StructArray.from_arrays([scores, lists], fields=list(item.value_type))
    return pa.ListArray.from_arrays(ends(map(len, rows)), structs).cast(item)


def decode(encoded: DataFrame, id_col: str, ids_col: str, into: str = "text", model: str | Vocabulary = DEFAULT_MODEL) -> DataFrame:
    """(id, text) of sequences of piece ids; null sequences give null. A text
    without the space mark U+2581 comes back as it was."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else lat.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, into])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{into}` string")
