"""Packing against the library's own ids, and the layout's invariants."""

import zlib

import numpy as np
import pytest

from sievewright.llm import packing
from sievewright.llm.queries import tokenizer_path


def whole_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def whole_batch(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, most_padding=1.0):
    ids = dict(zip(docs, whole_ids(docs.values()), strict=True))
    seen, sequences = {k: [] for k in ids}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, spans in seen.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[k])
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding <= most_padding * sum(map(len, ids.values()))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    docs = {r.doc_id: r.text for r in df.collect()}
    check(packing.pack(df, tokenizer_path()).collect(), docs, 0.01)


def test_edge_cases(spark):
    docs = {1: None, 2: "", 3: "word " * 5000, 4: "á\ń <|endoftext|> \x1c x y don't", 5: "ΣΣ 'S", -6: "  \n"}
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, length string")
    check(packing.pack(df, tokenizer_path()).collect(), docs)


def test_letters_that_are_no_letters_once_normalized():
    import pyarrow as pa

    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for before, marks in (("", ".,"), ("\u09b8\u09ae", "?")):
        texts = [f"{before}{c}{marks}" for c in letters]
        ids, sizes = packing.ChunkTokenizer(tokenizer_path())(pa.array(texts))
        whole = whole_batch(texts)
        assert sizes.tolist() == list(map(len, whole))
        assert ids.tolist() == [i for x in whole for i in x]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("fill", [1, 7, 1500, 2047])
def test_close_leaves_powers_of_two(fill):
    p = packing.Packer(0)
    p.close([fill, [(0, 0, np.arange(fill, dtype=np.uint32), fill)]])
    sizes = {}
    for r in p.rows:
        sizes[r[5]] = sizes.get(r[5], 0) + r[2]
    assert sum(sizes.values()) == fill
    assert all(n & (n - 1) == 0 or packing.WINDOW - n < packing.MIN_FILL for n in sizes.values())
