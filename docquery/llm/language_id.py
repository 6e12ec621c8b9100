"""Language identification of mixed texts.

Every letter has a feature: itself with its neighbours, hashed to 16 bits. A
language's model is its feature counts, gathered by Spark over all training
texts. A word's score for a language is the sum of its letters' log
probabilities; the script of its first letter narrows the languages to those
whose training texts have it. A Viterbi pass over the words, with a penalty for
switching, labels spans; all texts of a block advance one word at a time together.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import slices, text_blocks, written

#: First code point of each range and its script; letters elsewhere are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
NAMES = sorted({s for _, s in SCRIPTS})
BITS = 16
#: A language has a script if so much of its training letters are in it.
SCRIPT_SHARE = 0.001
BLOCK_CHARS = 300_000
#: Bytes of text that are put in order together.
SORTED_BYTES = 4_000_000
#: Letters times languages whose log probabilities a task holds at once.
CELLS_AT_ONCE = 4_000_000
UNDETERMINED = "und"


class Tables(NamedTuple):
    letter: np.ndarray  # by code point: letters and their marks
    mark: np.ndarray  # by code point: marks alone
    lower: np.ndarray  # by code point: the lower case, where it is one character


@lru_cache(1)
def _tables() -> Tables:
    n = 0x110000
    kinds = [unicodedata.category(chr(i))[0] for i in range(n)]
    letter, mark = (np.fromiter((k in own for k in kinds), bool, n) for own in ("LM", "M"))
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    return Tables(letter, mark, lower)


class Block(NamedTuple):
    """Letters of some texts: one row per letter in order."""

    feature: np.ndarray
    word: np.ndarray  # number of the word of each letter
    place: np.ndarray  # code point offset of each letter in its text
    word_text: np.ndarray  # number of the text of each word
    word_first: np.ndarray  # first letter (row) of each word
    script: np.ndarray  # of each letter: index in NAMES


def block_of(texts: list[str]) -> Block:
    t = _tables()
    joined = "\n".join(["", *texts, ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1, *(len(x) + 1 for x in texts)])
    letter, mark = t.letter[raw], t.mark[raw]
    if mark.any():  # marks belong to a word only behind a letter
        places = np.arange(len(raw))
        letter &= np.maximum.accumulate(np.where(letter & ~mark, places, 0)) > np.maximum.accumulate(np.where(letter, 0, places))
    low = np.where(letter, t.lower[raw], 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = (low[at - 1] * np.uint64(0x9E3779B97F4A7C15) ^ low[at] * np.uint64(0xC2B2AE3D27D4EB4F)) + low[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    first = ~letter[at - 1]
    text = np.searchsorted(starts, at, "right") - 1
    heads = np.flatnonzero(first)
    ranges = np.array([a for a, _ in SCRIPTS], np.uint32)
    kinds = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int64)
    return Block(
        (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.cumsum(first) - 1, at - starts[text], text[heads], heads,
        kinds[np.searchsorted(ranges, raw[at], "right") - 1],
    )


class Model(NamedTuple):
    languages: tuple[str, ...]
    log_prob: np.ndarray  # (2 ** BITS, languages), single precision
    allowed: np.ndarray  # (scripts, languages)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, max_languages: int = 200) -> Model:
    """Counts the features of all rows with text and language. What comes to the
    driver is one count per language and feature, at most max_languages * 65,568
    rows of some 25 bytes whatever the input; more languages are an error."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(lambda: np.zeros(2**BITS + len(NAMES), np.int64))
        for batch in slices(batches, 500):
            texts, langs = (c.to_pylist() for c in batch.columns)
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for a, z in _blocks(own):
                    b = block_of(own[a:z])
                    found[lang] += np.bincount(np.concatenate([b.feature, b.script + 2**BITS]), minlength=2**BITS + len(NAMES))
        for lang, counts in found.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["lang", "feature", "n"])

    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = given.mapInArrow(count, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    sums = written(sums, "features")
    languages = tuple(sorted(r.lang for r in sums.select("lang").distinct().limit(max_languages + 1).collect()))
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(languages), 2**BITS + len(NAMES)))
    found = sums.toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    if languages:
        at = np.array([languages.index(x) for x in names.dictionary.to_pylist()])
        counts[at[names.indices.to_numpy()], found.column("feature").to_numpy()] = found.column("n").to_numpy()
    own, scripts = counts[:, : 2**BITS], counts[:, 2**BITS :]
    seen = max(1, int((own.sum(axis=0) > 0).sum()))
    log_prob = np.log((own + smoothing) / (own.sum(axis=1, keepdims=True) + smoothing * seen)) if languages else np.zeros((0, 2**BITS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(languages, log_prob.T.astype(np.float32).copy(), allowed.T.copy())


def word_scores(model: Model, b: Block) -> np.ndarray:
    """(words, languages): sums of log probabilities, some words at a time."""
    n_lang = len(model.languages)
    ends = np.r_[b.word_first[1:], len(b.feature)]
    out = np.empty((len(b.word_first), n_lang))
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(ends, b.word_first[at] + CELLS_AT_ONCE // max(1, n_lang), "right")))
        first = b.word_first[at]
        out[at:to] = np.add.reduceat(model.log_prob[b.feature[first : ends[to - 1]]], b.word_first[at:to] - first, axis=0)
        at = to
    fits = model.allowed[b.script[b.word_first]]
    fits = fits | ~fits.any(axis=1, keepdims=True)
    return np.where(fits, out, -1e3 * (ends - b.word_first)[:, None])


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a long text, cut after characters that aren't letters,
    so that words and their features stay whole."""
    letter, at = _tables().letter, 0
    while at < len(text):
        to = at + BLOCK_CHARS
        if to < len(text):
            ends = lambda places: next((i + 1 for i in places if not letter[ord(text[i])]), None)
            to = ends(range(to - 1, at - 1, -1)) or ends(range(to, len(text))) or len(text)  # back to the last gap, or on to the next
        yield at, text[at:to]
        at = to


def label_long(model: Model, text: str, penalty: float) -> Iterator[tuple[int, Block, np.ndarray]]:
    """(offset, block, labels) of the parts of a long text: the labels are those
    of the whole text, as the state goes from part to part and only back
    pointers are kept."""
    own = np.arange(len(model.languages), dtype=np.int16)
    value, backs, parts = None, [], []
    for at, part in _parts(text):
        scores = word_scores(model, block_of([part]))
        back = np.empty(scores.shape, np.int16)
        for i, row in enumerate(scores):
            if value is None:
                value = row.copy()
                continue
            top = int(value.argmax())
            switched = value[top] - penalty
            stay = value >= switched
            back[i] = np.where(stay, own, top)
            value = np.where(stay, value, switched) + row
        parts.append((at, part)), backs.append(back)
    now = -1 if value is None else int(value.argmax())
    labels: list = [None] * len(parts)
    left = sum(map(len, backs))
    for k in range(len(parts) - 1, -1, -1):
        labels[k] = np.empty(len(backs[k]), np.int64)
        for i in range(len(backs[k]) - 1, -1, -1):
            labels[k][i] = now
            left -= 1
            if left:
                now = int(backs[k][i, now])
    for (at, part), found in zip(parts, labels):
        yield at, block_of([part]), found


def label_words(model: Model, b: Block, penalty: float) -> np.ndarray:
    """The language (index) of every word: per text the path with the best sum
    of word scores less penalty per switch. Among equals, staying wins, then the
    language that comes first."""
    n_words, n_lang = len(b.word_first), len(model.languages)
    if not n_words:
        return np.zeros(0, np.int64)
    scores = word_scores(model, b)
    begins = np.flatnonzero(np.r_[True, b.word_text[1:] != b.word_text[:-1]])
    sizes = np.diff(np.r_[begins, n_words])
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
    back = np.empty((n_words, n_lang), np.int16)
    own = np.arange(n_lang, dtype=np.int16)
    value = scores[begins]
    ends = np.empty(len(sizes), np.int64)
    for step in range(1, int(sizes[0])):
        n = active[step]
        ends[n : len(value)] = value[n:].argmax(axis=1)
        value = value[:n]
        top = value.argmax(axis=1)
        switched = value[np.arange(n), top] - penalty
        stay = value >= switched[:, None]
        rows = begins[:n] + step
        back[rows] = np.where(stay, own, top[:, None].astype(np.int16))
        value = np.where(stay, value, switched[:, None]) + scores[rows]
    ends[: len(value)] = value.argmax(axis=1)
    out = np.empty(n_words, np.int64)
    now = ends
    for step in range(int(sizes[0]) - 1, -1, -1):
        n = active[step]
        rows = begins[:n] + step
        out[rows] = now[:n]
        if step:
            now[:n] = back[rows, now[:n]]
    return out


def _by_length(texts: pa.Array) -> pa.Array:
    """Places of texts in the order of their lengths: the texts of a block, which
    are labelled word by word side by side, then end at about the same time."""
    return pc.sort_indices(pc.fill_null(pc.binary_length(texts), 0))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def tally(m: Model, texts: list[str], penalty: float, spans: bool) -> tuple[np.ndarray, list[list[dict]]]:
    """(letters per text and language, runs of words with one label per text) of
    a block: some texts, or a long one."""
    n_lang = max(1, len(m.languages))
    letters = np.zeros((len(texts), n_lang))
    runs: list = [[] for _ in texts]
    if not m.languages:
        return letters, runs
    if len(texts) == 1 and len(texts[0]) > BLOCK_CHARS:
        labelled = label_long(m, texts[0], penalty)
    else:
        b = block_of(texts)
        labelled = [(0, b, label_words(m, b, penalty))]
    for at, b, labels in labelled:
        if not len(labels):
            continue
        ends = np.r_[b.word_first[1:], len(b.feature)]
        letters += np.bincount(b.word_text * n_lang + labels, ends - b.word_first, len(texts) * n_lang).reshape(len(texts), -1)
        if spans:
            new = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (b.word_text[1:] != b.word_text[:-1])])
            for w, e in zip(new, ends[np.r_[new[1:], len(labels)] - 1] - 1):
                own, lang = runs[b.word_text[w]], m.languages[labels[w]]
                start, end = at + int(b.place[b.word_first[w]]), at + int(b.place[e]) + 1
                if own and own[-1]["lang"] == lang:  # goes on from the part before
                    own[-1]["end"] = end
                else:
                    own.append({"start": start, "end": end, "lang": lang})
    return letters, runs


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]) for every row of docs. spans: array of
    (start, end, lang) in code points, one for each run of words with one label.
    lang_pred is the language with the most letters (of equals, the one that
    comes first), score its share of the letters.

    Only the two columns are read, so others may have any name. A text that is
    null or has no letter gets `und`, score 0 and no spans, and so does every
    text if the model has no language. A null id stays null; repeated rows are
    judged one by one; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str]):
        m = sent.value
        if not m.languages:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        letters, runs = tally(m, texts, penalty, spans)
        best, total = letters.argmax(axis=1), letters.sum(axis=1)
        return [
            (m.languages[k], float(row[k] / n), r) if n else (UNDETERMINED, 0.0, [])
            for k, n, row, r in zip(best, total, letters, runs)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1, SORTED_BYTES):
            batch = batch.take(_by_length(batch.column(1)))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, z in _blocks(texts):
                found = judge(texts[a:z])
                columns = [batch.column(0).slice(a, z - a), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    columns.append(pa.array([f[2] for f in found], SPANS))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "lang_pred", "score", "spans"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double{more}")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, penalty: float = 12.0) -> DataFrame:
    """The rows of docs with a language that has at least `least` of the
    letters (of equal ones too); all columns, whatever their names, as they are.
    Null and empty texts and texts without letters go, and so do all if the
    model has no language; repeated rows are judged one by one, a null id
    doesn't matter; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in text_blocks(batches, at, SORTED_BYTES):
            order = _by_length(batch.column(at))
            texts = [t or "" for t in batch.column(at).take(order).to_pylist()]
            keep = np.zeros(len(texts), bool)
            for a, z in _blocks(texts):
                letters, _ = tally(m, texts[a:z], penalty, False)
                keep[order.to_numpy()[a:z]] = (letters.max(axis=1) >= least * letters.sum(axis=1)) & (letters.sum(axis=1) > 0)
            yield batch.filter(pa.array(keep))  # in their own order: long texts don't come to the next stage all at once

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """True for the quarter of ids that training leaves out; null ids are in."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
