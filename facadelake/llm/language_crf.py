"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and the lexicons it is in; all go to hashed rows of
weights, one per language, and add up to the word's emission scores, which are worked out once per different word.
Learned transitions join neighbouring words. Forward-backward over a text's words gives every word's
language posteriors, so code-switched text is labelled word by word; a text's language is the one that holds
most of its letters.

Forward-backward runs over all texts of a piece at once: texts are cut into blocks, a block's transfer matrix is the product
of its steps, messages cross a text's blocks through these matrices, and then all blocks step side by side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facadelake.llm.common import pieces
from facadelake.llm.interning import _Known
from facadelake.llm.shingles import mix

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17  # hashed features
# The sample that the model is fitted on: per language about so many documents, chosen by the hash of their text, and
# of each a stretch of so many characters.
FIT_DOCS, FIT_CHARS = 500, 1200
LEXICON = 300  # words per language
ROUNDS, RATE, DECAY = 60, 0.1, 1e-5
TRAIN_LENGTH = 48  # words of a training sequence
BLOCK = 64  # words that step one by one
CACHE = 150_000  # words whose scores a worker keeps
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, list[int]]  # word: languages in whose lexicons it is
    weights: np.ndarray  # (BUCKETS + languages) x languages
    transitions: np.ndarray  # from, to; log scores

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, one row each."""
        owner, rows = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[rows, k], len(words)) for k in range(len(self.languages))], 1)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and weight row of every feature of the words."""
    length = np.array([len(w) for w in words], np.int64) + 2
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(length)
    begin = end - length
    owner = np.repeat(np.arange(len(words)), length)
    owners, rows = [], []

    def add(who: np.ndarray, at: np.ndarray, n: int, kind: int) -> None:
        h = np.full(len(at), kind * 8 + n, np.uint64)
        for j in range(n):
            h = mix(h + chars[at + j] * np.uint64(0x9E3779B97F4A7C55))
        owners.append(who)
        rows.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))

    every = np.arange(len(chars))
    for n in (2, 3, 4):
        ok = every + n <= end[owner]
        add(owner[ok], every[ok], n, 0)
    for n in (1, 2, 3):
        ok = np.flatnonzero(length - 2 >= n)
        add(ok, begin[ok] + 1, n, 1)
        add(ok, end[ok] - 1 - n, n, 2)
    known = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if known:
        who, lang = np.array(known, np.int64).T
        owners.append(who)
        rows.append(BUCKETS + lang)
    return np.concatenate(owners), np.concatenate(rows)


def _chains(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of equal chains (chains, steps, languages), summed pair posteriors, and log partition sums."""
    chains, steps, k = emissions.shape
    top = emissions.max(2, keepdims=True)
    e, t = np.exp(emissions - top), np.exp(transitions)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((chains, steps))
    a = e[:, 0] / k
    for i in range(steps):
        if i:
            a = (alpha[:, i - 1] @ t) * e[:, i]
        scale[:, i] = a.sum(1)
        alpha[:, i] = a / scale[:, i, None]
    pairs = np.zeros((k, k))
    for i in range(steps - 2, -1, -1):
        b = e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        pairs += t * (alpha[:, i].T @ b)
        beta[:, i] = b @ t.T
    return alpha * beta, pairs, np.log(scale).sum(1) + top[:, :, 0].sum(1)


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """The model of ``(language, text)`` samples: gradient ascent on the likelihood of labelled sequences, which are made of
    stretches of the samples, of one language or several."""
    languages = sorted({lang for lang, _ in samples})
    k = len(languages)
    by = [[words_of(t) for lang, t in samples if lang == x] for x in languages]
    counts = [Counter(w for t in texts for w in t) for texts in by]
    total = sum(counts, Counter())
    lexicon: dict[str, list[int]] = {}
    for i, own in enumerate(counts):
        n = sum(own.values()) or 1
        for w, c in sorted(own.items(), key=lambda x: (-x[1] / (1 + (total[x[0]] - x[1]) * n / max(1, sum(total.values()) - n)), x[0]))[:LEXICON]:
            if c > 2:
                lexicon.setdefault(w, []).append(i)
    rng = np.random.default_rng(seed)
    stretches = [(i, t[a : a + n]) for i, texts in enumerate(by) for t in texts for n in [int(rng.integers(4, 80))] for a in range(0, len(t), n)]
    order = rng.permutation(len(stretches))
    words = [w for s in order for w in stretches[s][1]]
    labels = np.array([stretches[s][0] for s in order for _ in stretches[s][1]], np.int64)
    chains = len(words) // TRAIN_LENGTH
    if not chains or k == 1:
        return Model(languages, lexicon, np.zeros((BUCKETS + k, k), np.float32), np.zeros((k, k)))
    words, labels = words[: chains * TRAIN_LENGTH], labels[: chains * TRAIN_LENGTH].reshape(chains, TRAIN_LENGTH)
    different = sorted(set(words))
    number = {w: i for i, w in enumerate(different)}
    at = np.array([number[w] for w in words])
    owner, rows = features(different, lexicon)
    weights, transitions = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    first, second = np.zeros((2, *weights.shape)), np.zeros((2, k, k))
    gold = np.zeros((len(words), k))
    gold[np.arange(len(words)), labels.ravel()] = 1
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    for step in range(1, ROUNDS + 1):
        emissions = np.stack([np.bincount(owner, weights[rows, j], len(different)) for j in range(k)], 1)
        posterior, pairs, _ = _chains(emissions[at].reshape(chains, TRAIN_LENGTH, k), transitions)
        miss = gold - posterior.reshape(-1, k)
        per_word = np.stack([np.bincount(at, miss[:, j], len(different)) for j in range(k)], 1)
        slope = np.stack([np.bincount(rows, per_word[owner, j], len(weights)) for j in range(k)], 1) / chains - DECAY * weights
        for g, m, value in ((slope, first, weights), ((gold_pairs - pairs) / chains - DECAY * transitions, second, transitions)):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            value += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    return Model(languages, lexicon, weights.astype(np.float32), transitions)


def forward_backward(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posteriors of every word; text i has the words ``bounds[i]`` to ``bounds[i + 1]``."""
    n, k = emissions.shape
    t = np.exp(transitions).astype(np.float32)
    e = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    lengths = np.diff(bounds)
    per_text = -(-lengths // BLOCK)
    n_blocks = int(per_text.sum())
    text = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = bounds[:-1][text] + nth * BLOCK
    size = np.minimum(bounds[1:][text] - begin, BLOCK)
    order = np.argsort(-size, kind="stable")  # at each step the blocks that still go on come first
    begin, size = begin[order], size[order]
    place = np.empty(n_blocks, np.int64)
    place[order] = np.arange(n_blocks)
    active = [int(np.searchsorted(-size, -i, "left")) for i in range(BLOCK)]  # blocks longer than i
    fresh = np.zeros(n_blocks, bool)  # a text's first block: no transition leads into it
    fresh[place[np.flatnonzero(nth == 0)]] = True
    # Messages into every block from both sides.
    into, back = np.full((n_blocks, k), 1 / k, np.float32), np.ones((n_blocks, k), np.float32)
    # Within a text: transfer matrices of its blocks, each step a transition and an emission.
    inner = np.flatnonzero(per_text[text[order]] > 1)
    if len(inner):
        transfer = np.tile(np.eye(k, dtype=np.float32), (n_blocks, 1, 1))
        for i in range(BLOCK):
            m = active[i]
            if not m:
                break
            step = (transfer[:m].reshape(-1, k) @ t).reshape(m, k, k)
            if i == 0:
                step[fresh[:m]] = 1 / k
            step *= e[begin[:m] + i][:, None, :]
            transfer[:m] = step / step.max((1, 2), keepdims=True)
        longest = int(per_text.max())
        counts = per_text[lengths > 0]
        starts = np.cumsum(per_text)[lengths > 0] - counts
        carry = np.full((len(counts), k), 1 / k, np.float32)
        for r in range(longest):
            own = np.flatnonzero(counts > r)
            blocks = place[starts[own] + r]
            if r:
                into[blocks] = carry[own]
            carry[own] = np.einsum("bi,bij->bj", carry[own], transfer[blocks])
            carry[own] /= carry[own].sum(1, keepdims=True)
        carry = np.ones((len(counts), k), np.float32)
        for r in range(longest - 1, -1, -1):
            own = np.flatnonzero(counts > r)
            blocks = place[starts[own] + r]
            back[blocks] = carry[own]
            carry[own] = np.einsum("bij,bj->bi", transfer[blocks], carry[own])
            carry[own] /= carry[own].max(1, keepdims=True)
    alpha = np.empty((n, k), np.float32)
    a = into.copy()
    for i in range(BLOCK):
        m = active[i]
        if not m:
            break
        step = a[:m] @ t
        if i == 0:
            step[fresh[:m]] = 1 / k
        step *= e[begin[:m] + i]
        a[:m] = step / step.sum(1, keepdims=True)
        alpha[begin[:m] + i] = a[:m]
    b = back
    for i in range(BLOCK - 1, -1, -1):
        m = active[i]
        if not m:
            continue
        at = begin[:m] + i
        alpha[at] *= b[:m]
        step = (e[at] * b[:m]) @ t.T
        b[:m] = step / step.max(1, keepdims=True)
    return alpha / alpha.sum(1, keepdims=True)


class Labeller:
    """Posteriors of the words of texts; a worker keeps the scores of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, where each text's begin, letters in each word, posteriors."""
        if len(self.known) > CACHE:
            self.clear()
        words: list[str] = []
        bounds = [0]
        for text in texts:
            words += words_of(text)
            bounds.append(len(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if new := self.known.new:
            self.rows = np.concatenate([self.rows, self.model.scores(new).astype(np.float32)])
            self.letters = np.concatenate([self.letters, np.array([sum(map(str.isalpha, w)) if not w.isalpha() else len(w) for w in new], np.int32)])
            self.known.new = []
        bounds = np.array(bounds, np.int64)
        posterior = forward_backward(self.rows[at], bounds, self.model.transitions) if len(words) else np.zeros((0, self.rows.shape[1]), np.float32)
        return words, bounds, self.letters[at], posterior


@lru_cache(maxsize=1)
def _labeller(shared) -> Labeller:
    return Labeller(shared.value)


def train(docs: DataFrame, where: Column | None = None) -> Model:
    """The model of the rows ``where`` holds and ``lang`` is not null.

    It is fitted on the driver, on a bounded sample: per language about ``FIT_DOCS`` documents, chosen by the hash of their text,
    and of each ``FIT_CHARS`` characters from a place that the hash gives.
    """
    rows = docs.where("lang IS NOT NULL AND length(text) > 0")
    rows = rows.where(where) if where is not None else rows
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    share = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int(min(1.0, FIT_DOCS / n) * (1 << 30))))))
    draw = F.xxhash64("text")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - FIT_CHARS, F.lit(1))) + 1
    sample = rows.where(F.pmod(draw, F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("lang", F.substr("text", place.cast("int"), F.lit(FIT_CHARS)).alias("t"))
    return fit(sorted((r["lang"], r["t"]) for r in sample.collect()))


def _held(shared, texts: list[str]) -> np.ndarray:
    """Letters of every text that every language holds."""
    _, bounds, letters, posterior = _labeller(shared).label(texts)
    sums = np.concatenate([np.zeros((1, posterior.shape[1])), np.cumsum(posterior * letters[:, None], 0, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, shares)`` of every row of ``docs (doc_id, text)``.

    ``score``: the share of the text's letters that its language holds by the words' posteriors; ``shares``: that of every language.
    A null text, one without letters, or any text if nothing was learned, is ``und`` with score 0. Ties go to the first language
    by name. Repeated rows each give a row; other columns are not read; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, shares = [], [], []
            held = _held(shared, texts) if languages else None
            for i in range(len(texts)):
                total = held[i].sum() if held is not None else 0.0
                if total < 0.5:
                    langs.append(UNKNOWN), scores.append(0.0), shares.append([])
                else:
                    best = int(held[i].argmax())
                    part = np.clip(held[i] / total, 0.0, 1.0)
                    langs.append(languages[best]), scores.append(float(part[best])), shares.append(list(zip(languages, part.tolist())))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` in which one language holds at least ``least`` of the letters; all columns, nothing shuffled.

    Texts without letters go; if nothing was learned, all do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = _held(shared, [t or "" for t in batch.column("text").to_pylist()]) if k else np.zeros((batch.num_rows, 1))
            total = held.sum(1)
            yield batch.filter(pa.array((total >= 0.5) & (held.max(1) >= least * total - 1e-6)))

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, spans)``: the stretches of words of one language in every text, with their first and last word's number, language and
    least posterior. Texts without words have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string()), ("sure", pa.float64())]))
        for batch in pieces(batches):
            out: list[list[dict]] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not shared.value.languages:
                out = [[] for _ in texts]
            else:
                _, bounds, _, posterior = _labeller(shared).label(texts)
                best, sure = posterior.argmax(1), posterior.max(1)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    cuts = [a, *(np.flatnonzero(np.diff(best[a:b])) + a + 1), b] if b > a else []
                    out.append([{"first": int(x - a), "last": int(y - a - 1), "lang": shared.value.languages[best[x]], "sure": float(sure[x:y].min())} for x, y in zip(cuts, cuts[1:])])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<first:int,last:int,lang:string,sure:double>>")
