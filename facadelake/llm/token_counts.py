"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its words, each behind a word mark. The different new pre-tokens of a piece of the data are sorted, which
lays out their trie: a word shares the nodes of the prefix that it has in common with the word before it. Unigram
forward scores, the best sum of piece scores up to a node, are worked out level by level, once for every node, so once per shared
prefix; the node at which a word ends stores its token count. Counts of words stay known in the worker within a bound, and a
text's count is the sum of its words'. Nothing is shuffled.

Pieces come from a vocabulary file; its order gives their scores: log of a Zipf law, in whole thousandths, so that equal
sums are equal everywhere. Among equally good segmentations the one with fewest tokens counts. A character that no piece covers
costs its UTF-8 bytes, each worse than any piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facadelake.llm.common import pieces
from facadelake.llm.interning import _Known
from facadelake.llm.shingles import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
CACHE = 900_000  # words whose counts a worker keeps
_BASE = np.uint64(0x9E3779B97F4A7C55)
NEVER = -(1 << 60)
DEEP = 64  # characters


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Score of every ordinary piece of a sentencepiece model file, in thousandths."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(names))))
    return {name: round(-1000 * (math.log(r + 2) + total)) for r, name in enumerate(names)}


class Trie:
    """Best segmentations of many words at once."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0) - 10_000
        by_length: dict[int, list[tuple[np.uint64, int]]] = {}
        for piece, score in scores.items():
            by_length.setdefault(len(piece), []).append((_hash(piece), score))
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([h for h, _ in rows], np.uint64), np.array([s for _, s in rows], np.int64))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of every word. The few words deeper than ``DEEP`` gain nothing from stepping level by level: they go one by one."""
        short = [i for i, w in enumerate(words) if len(w) <= DEEP]
        out = np.array([0 if len(w) <= DEEP else self._alone(w) for w in words], np.int64)
        out[short] = self._levels([words[i] for i in short])
        return out

    def _alone(self, word: str) -> int:
        best, tokens = [0], [0]
        for i in range(1, len(word) + 1):
            top, least = NEVER, 0
            for j in range(max(0, i - self.longest), i):
                score = self.scores.get(word[j:i])
                if score is not None and (best[j] + score > top or best[j] + score == top and tokens[j] + 1 < least):
                    top, least = best[j] + score, tokens[j] + 1
            if word[i - 1] not in self.scores:
                size = len(word[i - 1].encode())
                score, n = best[i - 1] + size * self.byte, tokens[i - 1] + size
                if score > top or score == top and n < least:
                    top, least = score, n
            best.append(top)
            tokens.append(least)
        return tokens[-1]

    def _levels(self, words: list[str]) -> np.ndarray:
        order = sorted(range(len(words)), key=words.__getitem__)
        ordered = [words[i] for i in order]
        chars = np.frombuffer("".join(ordered).encode("utf-32-le"), np.uint32).astype(np.uint64)
        length = np.array([len(w) for w in ordered], np.int64)
        begin = np.cumsum(length) - length
        shared = np.array([0, *(_common(a, b) for a, b in zip(ordered, ordered[1:]))], np.int64)
        out = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))  # words that reach the level
        # Of the last levels: hash of the prefix, best score and its tokens, of every living word.
        levels = [(np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))]
        depth = 0
        while True:
            keep = length[alive] > depth
            if not keep.all():
                ends = alive[~keep]
                out[ends] = levels[-1][2][~keep]
                alive = alive[keep]
                levels = [tuple(x[keep] for x in level) for level in levels]
            if not len(alive):
                break
            depth += 1
            fresh = shared[alive] < depth  # a node of its own; the others are in the node of the word before them
            fresh[0] = True
            node = np.cumsum(fresh) - 1
            new = np.flatnonzero(fresh)
            char = chars[begin[alive[new]] + depth - 1]
            prefix = levels[-1][0][new] * _BASE + char + np.uint64(1)
            best, tokens = np.full(len(new), NEVER, np.int64), np.zeros(len(new), np.int64)
            power = 1
            for n in range(1, min(depth, self.longest) + 1):
                power = power * int(_BASE) & 0xFFFFFFFFFFFFFFFF
                before, score, count = (x[new] for x in levels[-n])
                if n in self.tables:
                    hashes, values = self.tables[n]
                    own = mix(prefix - before * np.uint64(power))
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    found = hashes[at] == own
                    total = np.where(found, score + values[at], NEVER)
                    count = count + 1
                else:
                    total = np.full(len(new), NEVER, np.int64)
                if n == 1:
                    size = 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)
                    missing = total == NEVER
                    total = np.where(missing, score + size * self.byte, total)
                    count = np.where(missing, levels[-1][2][new] + size, count)
                better = (total > best) | ((total == best) & (count < tokens))
                best, tokens = np.where(better, total, best), np.where(better, count, tokens)
            levels.append((prefix[node], best[node], tokens[node]))
            if len(levels) > self.longest:
                levels.pop(0)
        result = np.empty(len(words), np.int64)
        result[order] = out
        return result


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _hash(piece: str) -> np.uint64:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([h], np.uint64))[0]


class Counter:
    """Counts of words, kept in the worker."""

    def __init__(self, path: str):
        self.trie = Trie(vocabulary(path))
        self.clear()

    def clear(self) -> None:
        self.known, self.counts = _Known(), np.zeros(0, np.int32)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of every text."""
        if len(self.known) > CACHE:
            self.clear()
        words: list[str] = []
        bounds = [0]
        for text in texts:
            words += WORD.findall(text)
            bounds.append(len(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if new := self.known.new:
            self.counts = np.concatenate([self.counts, self.trie.counts([MARK + w for w in new]).astype(np.int32)])
            self.known.new = []
        total = np.concatenate([[0], np.cumsum(self.counts[at], dtype=np.int64)])
        return np.diff(bounds), np.diff(total[bounds])


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row of ``docs (doc_id, text)``, with the pieces of the model file ``path``.

    Null and empty texts have no tokens. Repeated rows each give a row; other columns are not read; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, tokens = _counter(path).count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
