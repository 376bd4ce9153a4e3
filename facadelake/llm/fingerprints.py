"""Threshold-scaled sketches of documents.

A sketch keeps every word-shingle hash below a fixed fraction of the hash range, so its size follows the
document's, sketches of parts merge into the sketch of the whole, and the share of one document's
sketch that is in another's estimates containment however unequal the two are. Short documents would
keep next to nothing: those with fewer than ``LEAST`` hashes below the threshold also keep their
smallest ones up to that number, and the sketch then is complete below its own last hash only, its reach.
Two sketches are compared below the smaller of their reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.llm.common import flat, pieces
from facadelake.llm.shingles import shingle_sets

SHINGLE = 5  # words
FRACTION = 16  # one hash in so many is kept
LEAST = 32  # hashes that a document keeps at least, if it has them
WHOLE = (1 << 64) - 1


class Sketch:
    """Sorted hashes, all that the document has up to and including ``reach``."""

    __slots__ = ("hashes", "reach")

    def __init__(self, hashes: np.ndarray, reach: int):
        self.hashes, self.reach = hashes, reach

    @classmethod
    def of(cls, shingles: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> Sketch:
        """Of a sorted set of hashes."""
        if len(shingles) <= least:
            return cls(shingles, WHOLE)
        limit = (1 << 64) // fraction - 1
        n = int(np.searchsorted(shingles, np.uint64(limit), "right"))
        return cls(shingles[:n], limit) if n >= least else cls(shingles[:least], int(shingles[least - 1]))

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of both documents together, complete up to the smaller reach."""
        reach = min(self.reach, other.reach)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both[: int(np.searchsorted(both, np.uint64(reach), "right"))], reach)

    def _below(self, reach: int) -> np.ndarray:
        return self.hashes[: int(np.searchsorted(self.hashes, np.uint64(reach), "right"))]

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; 1 for two documents without words, 0 if only one has none."""
        reach = min(self.reach, other.reach)
        a, b = self._below(reach), other._below(reach)
        shared = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - shared
        return shared / union if union else float(len(self.hashes) == len(other.hashes))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this document's shingles that the other has; 1 for a document without words."""
        reach = min(self.reach, other.reach)
        a = self._below(reach)
        return len(np.intersect1d(a, other._below(reach), assume_unique=True)) / len(a) if len(a) else float(not len(self.hashes))

    def text(self) -> str:
        """Reach and hashes in hexadecimal, 16 digits each."""
        return f"{self.reach:016x}:" + self.hashes.astype(">u8").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Sketch:
        head, _, rest = text.partition(":")
        return cls(np.frombuffer(bytes.fromhex(rest), ">u8").astype(np.uint64), int(head, 16))


def sketches(texts: list[str]) -> list[Sketch]:
    data, offsets = flat(pa.array(texts, pa.large_string()))
    return [Sketch.of(s) for s in shingle_sets(data, offsets, SHINGLE)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row of ``docs (doc_id, text)``. A null text counts as empty; its
    sketch is empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [Sketch.of(s).text() for s in shingle_sets(*flat(batch.column("text")), SHINGLE)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last third, rounded down, replaced by the first as many code points of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``(part, place, doc_id, text, fence)``, sorted inside partitions, in which every document's row is followed by the
    next one's: descending ``doc_id`` (null last), rows of one id by text; after the last comes the first.

    Ids are cut into ranges at approximate quantiles. The first document of every range is also put at the end of the
    range before it (``fence``), so no range needs another's rows. Only ranges' bounds pass through the driver.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    placed = rows.withColumn("part", _cuts_above(F.col("doc_id"), sorted(set(cuts), reverse=True)))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head"))
    # One row per range: the range before it that has rows, or the last.
    ordered = Window.orderBy("part")
    heads = heads.select("part", "head", F.coalesce(F.lag("part").over(ordered), F.max("part").over(Window.partitionBy())).alias("to"))
    first = placed.join(F.broadcast(heads), (placed["part"] == heads["part"]) & placed["doc_id"].eqNullSafe(heads["head"]))
    fences = first.select(heads["to"].alias("part"), "doc_id", "text", F.lit(True).alias("fence"))
    every = placed.select("part", "doc_id", "text", F.lit(False).alias("fence")).unionByName(fences)
    return every.repartition("part").sortWithinPartitions("part", "fence", F.col("doc_id").desc_nulls_last(), "text")


def _cuts_above(value: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are above the value, all for null: first among every k-th, then among k."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    chunks = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    lasts = F.array(*(F.lit(c[-1]) for c in chunks))
    whole = F.size(F.filter(lasts, lambda c: c > value))  # chunks all of whose cuts are above
    tables = F.array(*(F.array(*(F.lit(c) for c in chunk)) for chunk in [*chunks, [cuts[-1]]]))
    part = F.when(whole == len(chunks), F.lit(len(cuts))).otherwise(whole * k + F.size(F.filter(F.element_at(tables, whole + 1), lambda c: c > value)))
    return F.coalesce(F.when(value.isNotNull(), part), F.lit(len(cuts)))


def compared(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text and how near they are, and the next document's.

    ``(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next)``; the edited text ends in a
    piece of the next document (``edited``), the next document is that of ``with_next``: a lone one follows itself.
    Null texts count as empty; two texts without words are alike (1.0), one with and one without are not (0.0).
    Repeated rows each give a row; an empty table an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (part, doc_id, text, sketch) of the row before, if it waits for its next
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            done: list[tuple] = []
            for part, doc_id, text, fence, sketch in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), texts, batch.column("fence").to_pylist(), sketches(texts)):
                if held and held[0] == part:
                    done.append((*held[1:], edited(held[2], text), sketch))
                held = None if fence else (part, doc_id, text, sketch)
            changed = sketches([d[3] for d in done])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([d[0] for d in done], pa.int64()),
                    "n_chars": pa.array([len(d[1]) for d in done], pa.int64()),
                    "edited_text": pa.array([d[3] for d in done], pa.string()),
                    "fingerprint": pa.array([d[2].text() for d in done], pa.string()),
                    "edited_fingerprint": pa.array([c.text() for c in changed], pa.string()),
                    "near_edited": pa.array([d[2].likeness(c) for d, c in zip(done, changed)], pa.float64()),
                    "near_next": pa.array([d[2].likeness(d[4]) for d in done], pa.float64()),
                }
            )

    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts).mapInArrow(run, schema)
