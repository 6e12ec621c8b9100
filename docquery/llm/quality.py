"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on the driver from the statistics of a bounded sample of
labelled documents, with monotonic constraints, and flattened into arrays; tasks
score whole batches by walking all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the word pattern, the counted symbols, what ends a sentence.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"'”)]。！？"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each statistic with its constraint: -1 where more must not raise the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct_words": 0,
    "upper": -1, "digits": 0, "exclaims": -1, "stops": 0, "other_bytes": 0, "line_words": 0, "entropy": 0, "letters": 0, "ended_lines": 0,
}
_WIDTH = 21  # bits of a word's number in a window key


def _repeated(words: list[bytes], numbers: dict[bytes, int]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if len(numbers) > 2 ** (_WIDTH - 1):
        numbers.clear()
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) >= 2**_WIDTH:  # one text with a million new words
        numbers.clear()
        counts = Counter(zip(words, words[1:], words[2:]))
        twice = np.fromiter((counts[x] > 1 for x in zip(words, words[1:], words[2:])), bool, n - 2)
    else:
        keys = (ids[:-2] << 2 * _WIDTH) | (ids[1:-1] << _WIDTH) | ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def statistics(text: str | None, numbers: dict[bytes, int]) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text. numbers: words met so far."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the same white space
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeat = _repeated(words, numbers)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, other = by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[128:].sum()
    w = max(n, 1)
    times = np.fromiter(Counter(words).values(), float)
    entropy = (np.log(n) - (times * np.log(times)).sum() / n) / np.log(n) if n > 1 else 1.0
    ended = sum(line.rstrip(SPACES)[-1] in ENDS for line in lines)
    features = [
        np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeat / w, len(times) / w,
        upper / max(upper + lower, 1), digits / max(chars, 1), (by[33] + by[63]) / w, (by[46] + by[44]) / w, other / max(len(raw), 1), n / max(len(lines), 1),
        entropy, (upper + lower + other) / max(len(raw), 1), ended / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class Trees(NamedTuple):
    """Nodes of all trees in one array each; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        if not len(self.roots):
            return np.full(len(x), self.start)
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def grow(
    x: np.ndarray,
    y: np.ndarray,
    signs: Sequence[int] = tuple(FEATURES.values()),
    n_trees: int = 40,
    depth: int = 3,
    rate: float = 0.25,
    n_bins: int = 48,
    smoothing: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Boosts trees with logistic loss on quantile bins. Where signs has 1 or
    -1, a split may only raise or lower the score along its feature, and the
    middle of the two sides bounds everything below, so that the whole sum is
    monotone. Without rows, or with one label only, the score is constant."""
    nodes: list[list] = []
    roots: list[int] = []
    share = np.clip((y.sum() + 0.5) / (len(y) + 1), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, 0), int)
    f = np.full(len(x), start)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + smoothing), low, high))

    def build(rows, left_depth, low, high, g, h):
        at = len(nodes)
        nodes.append([0, np.inf, at, at, rate * leaf(g[rows].sum(), h[rows].sum(), low, high)])
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if left_depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                sum_g = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))[:-1]
                sum_h = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))[:-1]
                v_left = np.clip(-sum_g / (sum_h + smoothing), low, high)
                v_right = np.clip(-(total_g - sum_g) / (total_h - sum_h + smoothing), low, high)
                gain = sum_g**2 / (sum_h + smoothing) + (total_g - sum_g) ** 2 / (total_h - sum_h + smoothing) - total_g**2 / (total_h + smoothing)
                ok = (sum_h >= least) & (total_h - sum_h >= least) & ~(signs[j] * (v_right - v_left) < 0)
                gain = np.where(ok, gain, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, v_left[k], v_right[k]))
        if best[1]:
            j, k, v_left, v_right = best[1]
            goes_left = bins[rows, j] <= k
            middle = (v_left + v_right) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            nodes[at][:2] = [j, edges[j][k]]
            nodes[at][2] = build(rows[goes_left], left_depth - 1, *bounds[0], g, h)
            nodes[at][3] = build(rows[~goes_left], left_depth - 1, *bounds[1], g, h)
        return at

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-f))
            roots.append(build(np.arange(len(x)), depth, -np.inf, np.inf, p - y, p * (1 - p)))
            f = start + _flat(nodes, roots, depth, 0.0).score(x)
    return _flat(nodes, roots, depth, start)


def _flat(nodes, roots, depth, start) -> Trees:
    columns = list(zip(*nodes)) or [[]] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Trees(*(np.array(c, k) for c, k in zip(columns, kinds)), np.array(roots, np.int64), depth, start)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 20_000,
) -> Trees:
    """Fits the trees to labels (1 good, 0 bad). At most max_labelled labelled
    ids, the first by hash, are used; of those only the statistics come to the
    driver (one row of 15 numbers each). Null ids and labels are left out; a
    label that is repeated counts as its least value, an id that is repeated in
    docs as its row with the least statistics."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    some = own.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        for batch in batches:
            found = [statistics(t, numbers)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "id"])

    kind = labels.schema[id_col].dataType.simpleString()
    found = texts.select("text", "y", "id").mapInArrow(run, f"x array<double>, y int, id {kind}").groupBy("id").agg(F.min(F.struct("x", "y")).alias("s"))
    rows = sorted((list(r.s.x), r.s.y) for r in found.select("s").collect())
    return grow(np.array([x for x, _ in rows]).reshape(-1, len(FEATURES)), np.array([float(y > 0) for _, y in rows]))


def judge_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, probability, kept) for every row of docs. A row is kept if the
    base rules pass and the trees give it a probability of at least `least`.

    Only the two columns are read, so others may have any name. A null text has
    no words and fails; a null id stays null; repeated rows are judged one by
    one; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        for batch in batches:
            found = [statistics(t, numbers) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
            x = np.array([f for _, f in found]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-sent.value.score(x)))
            failed = base_failed(base[:, 0], base[:, 4])
            columns = [*(pa.array(c) for c in base.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *BASE, "base_failed", "probability", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in BASE)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {counts}, base_failed boolean, probability double, kept boolean")
