"""Token ids in word-aligned blocks.

A shard is a range of documents in ascending ``doc_id``; it is a sequence of blocks. A block holds the ids of
whole documents, packed by Simple-8b: each 64-bit word has a selector in its top four bits and as many
ids as its 60 other bits hold at the selector's width. A value of 60 bits or more is an escape: a word of
selector 0 that holds the value's place in the block's escape list. Every block says where each of its
documents begins and where it begins itself in its shard, so blocks are decoded alone and in one pass of
numpy each.

Spark writes and reads the blocks, as rows of binary payloads, so any store that Spark reaches will do.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facadelake.llm.common import pieces
from facadelake.llm.interning import Interner

# Ids per word and their width, selectors 1 to 14.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
SMALL_WIDTHS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)  # bits of small values
HEADER = struct.Struct("<4sIIII")  # mark, values, words, escapes, documents
MARK = b"S8B1"
BLOCK_IDS = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Lower-case texts of these characters only, without apostrophes, are cut finer: between letters or digits and the rest
# the tokenizer always cuts, unless an apostrophe makes a contraction.
PLAIN = re.compile(r"[\x00-\x26\x28-\x7eß-öø-ÿ]*")
PART = re.compile(r"[a-z0-9ß-öø-ÿ]+|[^a-z0-9ß-öø-ÿ\x20\x09-\x0D]+")
END = " "  # stands for the end of a text among its words
CACHE = 900_000  # words whose ids a worker keeps


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of unsigned 64-bit values; each word takes as many values as fit."""
    n = len(values)
    if n and values.max() < len(SMALL_WIDTHS):
        width = SMALL_WIDTHS[values]
    else:
        width = np.zeros(n, np.uint8)
        for b in (32, 16, 8, 4, 2, 1):
            width += np.where((values >> width.astype(np.uint64)) >> np.uint64(b) > 0, b, 0).astype(np.uint8)
        width += 1
    selector = np.zeros(n, np.uint8)
    # From one value a word to sixty: where so many values from here fit, that packing is taken.
    for s, (count, bits) in reversed(list(enumerate(PACKINGS, 1))):
        fits = width <= bits
        if count == 1:
            selector[fits] = s
        elif n >= count and int(np.count_nonzero(fits)) >= count:
            runs = np.zeros(n + 1, np.int32)
            np.cumsum(fits, out=runs[1:])
            selector[: n - count + 1][runs[count:] - runs[:-count] == count] = s
    counts = np.array([1, *(c for c, _ in PACKINGS)])[selector].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += counts[i]
    at = np.array(at, np.int64)
    selector = selector[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[own] |= np.bitwise_or.reduce(values[at[own][:, None] + np.arange(count)] << shifts, axis=1)
    own = np.flatnonzero(selector == ESCAPE)
    words[own] = np.arange(len(own), dtype=np.uint64)
    return words, values[at[own]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in PACKINGS), 0])[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[at[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    own = np.flatnonzero(selector == ESCAPE)
    out[at[own]] = escapes[words[own].astype(np.int64)]
    return out


def to_block(values: np.ndarray, begins: np.ndarray) -> bytes:
    """A block's bytes: header, where each document's values begin, words, escapes."""
    words, escapes = pack(values)
    head = HEADER.pack(MARK, len(values), len(words), len(escapes), len(begins))
    return head + begins.astype("<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block, and where each document's begin."""
    mark, n, n_words, n_escapes, n_docs = HEADER.unpack_from(block)
    if mark != MARK:
        raise ValueError("not a block of token ids")
    begins = np.frombuffer(block, "<u4", n_docs, HEADER.size)
    at = HEADER.size + 4 * n_docs
    words = np.frombuffer(block, "<u8", n_words, at)
    escapes = np.frombuffer(block, "<u8", n_escapes, at + 8 * n_words)
    return unpack(words, escapes, n), begins


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of texts by the library, word by word: the tokenizer drops white space and no token crosses it."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = tokenizer(path), end_id
        self.words = Interner(self._find, CACHE)

    def _find(self, words: list[str]) -> Iterator[list[int]]:
        found = iter(self.tokenizer.encode_batch_fast([w for w in words if w != END], add_special_tokens=False))
        return ([self.end_id] if w == END else next(found).ids for w in words)

    @staticmethod
    def split(text: str) -> list[str]:
        """Pieces that give the text's ids one by one. The tokenizer lowers letter by letter, after composing them."""
        low = text.lower()
        if PLAIN.fullmatch(low) and "<|" not in low:
            return PART.findall(low)
        # Added tokens are found in the raw text, by case.
        return WORD.findall(low if "<|" not in text and "Σ" not in text and unicodedata.is_normalized("NFC", text) else text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and where each text's begin (one more entry than texts)."""
        words: list[str] = []
        bounds = [0]
        for text in texts:
            words += self.split(text)
            words.append(END)
            bounds.append(len(words))
        ids, at = self.words.rows(words)
        return ids, at[bounds]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordEncoder:
    """One for all tasks of a worker process."""
    return WordEncoder(path, end_id)


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, shards: int | None = None) -> DataFrame:
    """``(shard, block, start, n_ids, doc_ids, payload)`` of ``docs (doc_id, text)``.

    Shards are ranges of ``doc_id``, ascending; inside a shard documents are ordered by ``doc_id``, those of one id
    by text, null ids first. Null texts count as empty. ``end_id`` follows every document. ``start``: ids of
    the shard before the block.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words = TaskContext.get().partitionId(), encoder(tokenizer_path, end_id)
        block = start = size = 0
        ids: list[np.ndarray] = []
        owners: list[int | None] = []

        def row() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids])
            payload = to_block(np.concatenate(ids).astype(np.uint64), np.cumsum(lengths) - lengths)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                 "doc_ids": pa.array([owners], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())}
            )

        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            every, bounds = words.encode(texts)
            for owner, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                found = every[a:b]
                ids.append(found)
                owners.append(owner)
                size += len(found)
                if size >= BLOCK_IDS:
                    yield row()
                    block, start, size, ids, owners = block + 1, start + size, 0, [], []
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "shard int, block int, start long, n_ids long, doc_ids array<long>, payload binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> None:
    encode_blocks(docs, tokenizer_path, end_id, shards).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the blocks below ``path``.

    ``start``: ids of all documents before it, over all shards; ``ids``: little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema("shard int, block int, start long, n_ids long, doc_ids array<long>, payload binary").parquet(path)
    # One row per shard: as many as the range partitions of the writer, whatever the number of documents. So it is broadcast.
    before = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = before.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, owners, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "payload"))):
                values, begins = from_block(payload)
                ids, ends = values.astype("<u4"), np.append(begins[1:], len(values))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(owners, pa.int64()), "start": pa.array(begins.astype(np.int64) + start, pa.int64()), "n_tokens": pa.array(ends - begins, pa.int64()),
                     "ids": pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())}
                )

    joined = blocks.join(F.broadcast(before), "shard").select((F.col("start") + F.col("base")).alias("start"), "doc_ids", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: DataFrame) -> DataFrame:
    """``ids`` with ``ids_crc32`` in place of the ids."""
    return ids.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
