"""Blocks of ids: exact round trips, the library's ids, places, edge cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from facadelake.llm import token_store as ts  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, (1 << b) - 1 if b else 0)), max_size=300))
def test_round_trip(values):
    values = np.array(values, np.uint64)
    words, escapes = ts.pack(values)
    assert ts.unpack(words, escapes, len(values)).tolist() == values.tolist()
    assert len(escapes) == (values >= 1 << 60).sum()


def test_packs_tightly():
    assert len(ts.pack(np.ones(600, np.uint64))[0]) == 10
    assert len(ts.pack(np.full(400, 49_000, np.uint64))[0]) == 134  # three of 20 bits
    assert len(ts.pack(np.full(400, 32_767, np.uint64))[0]) == 100


def test_ids_and_places(spark, tmp_path):
    words = ["Hello", "wörld's", "don't", "<|endoftext|>", "a\x1cb!", "é́", "ΟΔΟΣ", "12345", "…", "漢字 x", "İ"]
    rows = [(i, " ".join(words[(i * j) % len(words)] for j in range(i % 40)) + "\n\t " * (i % 3)) for i in range(300)]
    rng = random.Random(5)
    chars = "aZé9ß÷× .,!?_-|<>\n\x1c\x85\xa0²µ'st/$ÀΣσ"
    rows += [(1000 + i, "".join(rng.choice(chars[: rng.choice([8, 14, 20, 40])]) for _ in range(rng.randrange(80)))) for i in range(1500)]
    rows += [(500, None), (501, ""), (502, "word " * 90_000), (7, "again"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS shard", "2 AS start")
    ts.write(docs, str(tmp_path / "t"), PATH, 2, shards=4)
    got = ts.crc32(ts.read(spark, str(tmp_path / "t"))).collect()
    library, want, start = ts.tokenizer(PATH), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    ts.write(docs.limit(0), str(tmp_path / "e"), PATH, 2, shards=4)
    assert ts.read(spark, str(tmp_path / "e")).count() == 0


def test_added_tokens_by_case():
    """Names of added tokens in other letters are ordinary pieces, as the library has it."""
    library, own = ts.tokenizer(PATH), ts.WordEncoder(PATH, 2)
    for text in ("a <|ENDOFTEXT|> B", "x<|EndOfText|>y", "<|endoftext|> <|endofTEXT|>", "Plain <| Words", "<|STARTOFTEXT|>É"):
        ids, _ = own.encode([text])
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
