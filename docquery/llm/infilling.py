"""Texts cut in three and reordered, so that a model learns to fill the middle.

DuckDB works inside mapInArrow: each slice of a batch is registered as a table,
one SQL statement cuts, hashes and joins, and its Arrow result goes back to
Spark. No row becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import text_blocks

#: Bytes of text that one statement works on; a longer text is alone with its neighbours.
SLICE = 2_000_000

#: A unit is a run of ASCII letters or one other character. Of the digest of
#: seed and id, the first two groups of eight digits place the cuts, the third
#: decides whether the text is left alone, the fourth which order it gets.
_CUT = """
WITH units AS (
  SELECT id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256(concat($seed, ':', id)) AS digest
  FROM batch),
hashed AS (
  SELECT *, len(units)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::BIGINT) AS h FROM units),
ends AS (
  SELECT id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= $rate THEN 'plain'
      WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
    array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM ends)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END AS output
FROM parts
"""


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of docs.

    n counts the units of the text. `rate` of 100 texts are cut, of these `spm`
    of 100 start with the suffix (form spm), the others with the prefix (psm).
    Texts that contain a mark themselves stay as they are (plain), as do empty
    ones, so `restored` is exact for every output.

    Only the two columns are read, others may have any name. A null text is an
    empty one; a null id is hashed like an empty one; repeated rows get the same
    result each; ids of any type are hashed as the text Spark casts them to; an
    empty table gives an empty result. A text is worked on as a whole, so its
    units must fit into a task's memory (16 bytes each).
    """
    given = {"seed": seed, "rate": rate, "spm": spm}
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for block in text_blocks(batches, 2, SLICE):
                con.register("batch", pa.table({"id": block.column(1), "text": block.column(2)}))
                found = con.sql(_CUT, params=given).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [found.column(k).cast(t).combine_chunks() for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.int64()), (5, pa.string()))]
                yield pa.RecordBatch.from_arrays([block.column(0), *(c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns)], names)

    texts = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("hashed"), F.col(text_col))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. Each mark occurs once in an output
    that isn't plain. Null if either is null; `form` must be psm, spm or plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    psm = F.concat(between("<P>", "<S>"), F.substring_index(output, "<M>", -1), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), F.substring_index(output, "<M>", -1), between("<S>", "<P>"))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
