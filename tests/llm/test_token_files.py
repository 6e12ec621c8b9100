import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquery.llm.token_files import BLOCK, DEFAULT_TOKENIZER, Encoder, TokenFile, decode_blocks, encode_blocks, pack, read_tokens, unpack, write_tokens

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no tokenizer file")
LIBRARY = Tokenizer.from_file(DEFAULT_TOKENIZER) if os.path.exists(DEFAULT_TOKENIZER) else None
ODD = [
    "", " ", "It's I'll they'd 'S", "á ́b é", "\x1c x\x1dy \x85 z w v　u", "ΑΣ ΣΑΣ' ΟΔΟΣ́. İI", "<|endoftext|> x<|startoftext|>y", "12 3४५", "한글하 ㎏",
    "\U0001f600\U0001f468‍\U0001f469 ﻿x", "tab\tnew\nline\r\n\x0b\x0c end", "!!! ... --- \0 \0x", "J̌ ǰ ǰ Word, WORD. é, É... a…, it's! <|ENDOFTEXT|> <|endoftext|>, x,̌ ÷, ×! Œ? don't&&& 'S, A's, 3, ,́", "x" * 5000, "word " * 70_000,
]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 16, 31, 32])
def test_pack(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (3, BLOCK), dtype=np.uint64).astype(np.uint32)
    words = pack(values, width)
    assert words.shape == (3, 32 * width) and (unpack(words, width) == values).all()


@pytest.mark.parametrize("percentile", [0, 50, 90, 100])
def test_blocks(percentile):
    r = np.random.default_rng(percentile)
    rows = [np.full(BLOCK, 7), np.arange(BLOCK), r.integers(0, 50_000, BLOCK), np.where(r.random(BLOCK) < 0.05, 2**32 - 1, r.integers(100, 200, BLOCK)), r.integers(0, 2**32, BLOCK), np.full(BLOCK, 2**32 - 1)]
    ids = np.concatenate(rows).astype(np.uint32)
    blocks = encode_blocks(ids, percentile)
    assert (decode_blocks([memoryview(b) for b in blocks]) == ids).all()
    if percentile == 90:
        assert len(blocks[0]) < 10 and len(blocks[3]) < 2 * BLOCK


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\x1f́ 'Ss"), max_size=30), max_size=5))
def test_encoder_equals_the_library(texts):
    encoder = test_encoder_equals_the_library.__dict__.setdefault("encoder", Encoder(open(DEFAULT_TOKENIZER, encoding="utf-8").read(), 2))
    texts = texts or [""]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert sizes.tolist() == [len(ids_of(t)) for t in texts]


def expected(rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(text)
        out.append((doc_id, at, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("n_files", [None, 5])
def test_round_trip(spark, n_files):
    rows = [(-3, "first")] + [(i, t) for i, t in enumerate(ODD)] + [(50 + i, f"text {i}, " * (i % 7)) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(4)
    manifest = write_tokens(df, n_files=n_files)
    want = expected(rows)
    assert sorted(map(tuple, read_tokens(manifest).collect())) == want
    packed = {r.doc_id: bytes(r.ids) for r in read_tokens(manifest, packed=True).collect()}
    assert packed == {i: np.array(x, "<u4").tobytes() for i, _, x in want}
    files = manifest.orderBy("start").collect()
    assert sum(f.n_docs for f in files) == len(rows) and sum(f.n_ids for f in files) == sum(len(x) for *_, x in want)
    if n_files:
        assert len(files) > 1
    ordered = []
    for f in files:
        file = TokenFile(f.file)
        ordered += file.doc_ids.to_pylist()
        assert all(file.document(k).tolist() == ids_of(dict(rows)[file.doc_ids[k].as_py()]) for k in range(file.n_docs))
        assert os.path.getsize(f.file.removeprefix("file://")) == f.n_bytes
    assert ordered == [i for i, _ in rows]


def test_null_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "no id"), (4, "b"), (4, "a"), (4, "a"), (1, "c")], "n int, t string")
    got = sorted(map(tuple, read_tokens(write_tokens(df, id_col="n", text_col="t", end_id=9), id_col="n").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 4, 4, 4] and all(r[2][-1] == 9 for r in got)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([len(r[2]) for r in got])[:-1]]).tolist()
    assert read_tokens(write_tokens(df.limit(0), id_col="n", text_col="t")).collect() == []
    with pytest.raises(ValueError):
        write_tokens(df, id_col="t", text_col="t")


def test_registered_query(spark, tmp_path):
    from docquery.llm.queries import op13_token_files

    rows = [(3 * i, t) for i, t in enumerate([*ODD, None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in expected(rows)]
    assert sorted(map(tuple, op13_token_files(spark, str(tmp_path)).collect())) == want
