"""Byte-level BPE against the library, an exact round trip, and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from facadelake.llm import byte_bpe as bpe  # noqa: E402
from facadelake.llm.common import flat  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
PARTS = ["a", "Z", "é", "ß", "1", "٣", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'re", "'ve", "'ll", "'l", "'T", "!", "''", "-", "<|endoftext|>", "\U0001f600", "\x1c", "\x85", "́", "½", "漢"]


def texts():
    rng = random.Random(1)
    out = ["", "x", " ", "'", "'s", " 's", "\n's", "a's's't", "!!'s", "don't we'll  've", "  \n  x", "x   ", " \n", "a" * 700, "ab1" * 500, "é" * 300]
    return out + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_boundaries():
    found = texts()
    data, offsets = flat(pa.array(found))
    points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    lengths = [len(t) for t in found]
    starts = np.cumsum([0, *lengths[:-1]])[np.array(lengths) > 0]
    want, base = [], 0
    for t in found:
        want += [base + m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]
        base += len(t)
    assert bpe.boundaries(points, starts).tolist() == want


def test_ids_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(-1, None), (3, "x"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        match = [r for r in by[d] if bytes(r.decoded) == (t or "").encode()]
        assert match, (d, t)
        assert np.frombuffer(match[0].ids, "<u4").tolist() == ids and match[0].n_tokens == len(ids)
        want = np.cumsum([0] + [len(LIBRARY.decode_single_token_bytes(i)) for i in ids])[:-1].tolist()
        assert np.frombuffer(match[0].offsets, "<u4").tolist() == want
    assert sorted(map(str, got)) == sorted(map(str, bpe.encode_decode(docs, PATH).collect()))
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_long_pre_token():
    piece = bytes(random.Random(2).choice(b"abcdetion") for _ in range(20_000))
    assert bpe.merge(piece, bpe.load_ranks(PATH)) == LIBRARY.encode_ordinary(piece.decode())
    for n in (65, 66, 90):
        assert bpe.merge(piece[:n], bpe.load_ranks(PATH)) == LIBRARY.encode_ordinary(piece[:n].decode())
