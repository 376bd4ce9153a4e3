"""Byte-level BPE: encoding by a rank file and decoding, many texts at once.

Pre-tokens are found without a regular expression. Every code point has a class from a table; with its
neighbours it gives a symbol, and a symbol is a function from the state before a code point to the state
after it. These functions are closed under composition, so their composites are numbered, and the states
before all code points follow from an associative scan over a multiplication table: within columns of a
block, over the blocks' totals, and back. State and symbol say where a pre-token begins.

The slices are looked up in a bounded table of merged pre-tokens; those not in it are merged by rank.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from facadelake.llm.common import flat, pieces
from facadelake.llm.interning import Interner

# The white space of the pre-token pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters after an apostrophe that make a pre-token of their own with it.
SHORT_ENDINGS = ["s", "t", "m", "d"]
LONG_ENDINGS = ["re", "ve", "ll"]

OTHER, LETTER, NUMBER, SPACE, WIDE = range(5)  # classes
# Symbols: a class, or what neighbours make of it.
SYM_OTHER, SYM_LETTER, SYM_NUMBER, SYM_WHITE, SYM_LAST_SPACE, SYM_LAST_WHITE, SYM_SHORT, SYM_LONG = range(8)
# States: what the pre-token that ends before a code point may still take.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 256
CACHE = 400_000  # merged pre-tokens that a worker keeps


def step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a symbol, and whether a pre-token begins with it."""
    if symbol == SYM_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return DONE, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == SYM_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol == SYM_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == SYM_LAST_SPACE:
        return AFTER_SPACE, True
    if symbol == SYM_LAST_WHITE:
        return DONE, True
    goes_on = state in (IN_OTHERS, AFTER_SPACE)
    if symbol == SYM_OTHER or goes_on:
        return IN_OTHERS, not goes_on
    return (ONE_MORE if symbol == SYM_SHORT else TWO_MORE), True


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions (those at a text's begin after the others), products, values, begins."""
    plain = [tuple(step(s, y)[0] for s in range(8)) for y in range(8)]
    start = [(step(DONE, y)[0],) * 8 for y in range(8)]
    number = {tuple(range(8)): 0}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in plain + start:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    product = np.array([[number[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    begins = np.array([[step(s, y)[1] for y in range(8)] for s in range(8)])
    return np.array([number[f] for f in plain + start], np.uint16), product, np.array(every, np.uint8), begins


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = WIDE
    out[0x20] = SPACE
    return out


def _prefixes(items: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Running products of the function numbers, each with its own item included."""
    n = len(items)
    if n <= BLOCK:
        out = items.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    table, width = product.ravel(), product.shape[1]
    grid = np.zeros(-(-n // BLOCK) * BLOCK, np.uint16)
    grid[:n] = items
    grid = np.ascontiguousarray(grid.reshape(-1, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = table[grid[j - 1].astype(np.int32) * width + grid[j]]
    before = np.concatenate([[0], _prefixes(grid[-1].copy(), product)[:-1]]).astype(np.int32)
    grid = table[before[None, :] * width + grid]
    return grid.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of ``points`` at which pre-tokens begin; ``starts``: where texts that aren't empty begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[points]
    first = np.zeros(n, bool)
    first[starts] = True
    ends = np.ones(n, bool)  # the last of a text
    ends[:-1] = first[1:]
    white = cls >= SPACE
    follows = np.zeros(n, bool)  # something that isn't white space follows in the text
    follows[:-1] = ~white[1:] & ~ends[:-1]
    symbol = np.array([SYM_OTHER, SYM_LETTER, SYM_NUMBER, SYM_WHITE, SYM_WHITE], np.uint8)[cls]
    symbol[white & follows] = np.where(cls[white & follows] == SPACE, SYM_LAST_SPACE, SYM_LAST_WHITE)
    at = np.flatnonzero(points == 0x27)
    at = at[~ends[at]]
    symbol[at[np.isin(points[at + 1], [ord(c) for c in SHORT_ENDINGS])]] = SYM_SHORT
    at = at[~ends[at + 1]]
    pair = points[at + 1].astype(np.int64) << 32 | points[np.minimum(at + 2, n - 1)]
    symbol[at[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in LONG_ENDINGS])]] = SYM_LONG
    functions, product, values, begins = machine()
    scanned = _prefixes(functions[symbol + np.uint8(8) * first], product)
    state = np.zeros(n, np.uint8)
    state[1:] = values[scanned[:-1], DONE]
    return np.flatnonzero(begins[state, symbol] | first)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of least rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    none = 1 << 60
    of = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while of:
        least = min(of)
        if least == none:
            break
        i = of.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del of[i]
        if i < len(of):
            of[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            of[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, with a heap of pairs: n log n for pre-tokens of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, keep in zip(parts, alive) if keep]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes pieces of texts; a worker process keeps what it has merged, up to ``CACHE`` pre-tokens."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.merged = Interner(lambda tokens: (merge(t, ranks) for t in tokens), CACHE)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry than texts)."""
        blob = data.tobytes()
        points = np.frombuffer(blob.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
        begin = lead[boundaries(points, starts)]
        cuts = begin.tolist()
        ids, at = self.merged.rows([blob[a:b] for a, b in zip(cuts, [*cuts[1:], len(blob)])])
        return ids, at[np.searchsorted(begin, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes after each other, and where each id's begin."""
    ranks = load_ranks(path)
    by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])])


def decode_ids(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids after each other, and the offset of each id's first byte (one more entry than ids)."""
    pool, at = token_bytes(path)
    ids = ids.astype(np.int64)
    size = at[ids + 1] - at[ids]
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(at[ids] - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _encoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    ids, bounds = encoder(path).encode(*flat(batch.column("text")))
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
    return pa.record_batch([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), raw.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])


def _decoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    data, at = flat(batch.column("ids"))
    ids, at = np.frombuffer(data.tobytes(), "<u4"), at // 4
    out, offsets = decode_ids(ids, path)
    ends = offsets[at]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
    own = (offsets[:-1] - np.repeat(ends[:-1], np.diff(at))).astype("<u4")
    places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * 4), pa.py_buffer(own)])
    return pa.record_batch([*batch.columns, text.cast(pa.binary()), places.cast(pa.binary())], [*batch.schema.names, "decoded", "offsets"])


ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = [T.StructField("decoded", T.BinaryType()), T.StructField("offsets", T.BinaryType())]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs (doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts have none; repeated rows each
    give a row, a null ``doc_id`` stays null, other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _encoded(batch, path)

    return _texts(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ``ids`` stand for, and ``offsets``: where each id's bytes
    begin (little-endian 32 bit), so that a slice of ids can be found in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 4 << 20):
            yield _decoded(batch, path)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, *DECODED]))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` by one worker, which saves the ids a way through the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _decoded(_encoded(batch, path), path)

    return _texts(docs).mapInArrow(run, ENCODED + ", decoded binary, offsets binary")
