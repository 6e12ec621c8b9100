"""Token counts without tokens: a count-only Viterbi pass.

An Aho-Corasick automaton enumerates the pieces that end at each character;
dynamic programming carries the best score and its number of pieces, nothing
else. Among equal sums the longest last piece wins, which is the rule of the
tokenizer: it extends from the left and replaces only by something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docquery.llm.pieces import DEFAULT_MODEL, Lattice, Memo, Vocabulary, lattice, load, normalized

#: Chunks remembered in a task, half as many at least.
MEMORY = 400_000


def best_count(lat: Lattice, chunk: str) -> tuple[float, int]:
    """(score, pieces) of the best segmentation of a chunk."""
    n = len(chunk)
    best: list = [None] * (n + 1)
    count = [0] * (n + 1)
    best[0] = 0.0
    for a, b, score, i in lat.edges(chunk):
        total = best[a] + score
        if best[b] is None or total > best[b]:
            best[b] = total
            count[b] = count[a] + (1 if i >= 0 else lat.n_bytes(chunk, a))
    return best[n], count[n]


@lru_cache(2)
def counts(lat: Lattice) -> Memo:
    """Chunk to number of pieces; a worker process keeps it for its next tasks."""
    return Memo(lambda chunk: best_count(lat, chunk)[1], MEMORY)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "n_tokens", model: str | Vocabulary = DEFAULT_MODEL) -> DataFrame:
    """(id, n_tokens) for every row of docs: pieces of the best segmentation of
    the whole text; characters outside the vocabulary count their UTF-8 bytes.

    Only the two columns are read, so others may have any name. A null text
    counts 0, like an empty one; a null id stays null; repeated rows are counted
    one by one; an empty table gives an empty result.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary.value)
        of = counts(lat).__getitem__
        for batch in batches:
            found = [sum(map(of, lat.chunks(normalized(t)))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, into])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{into}` bigint")
