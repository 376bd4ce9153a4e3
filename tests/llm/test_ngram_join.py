"""The join against all pairs, on planted copies, and its edge cases."""

import random
import re

import numpy as np
import pytest

from facadelake.llm import ngram_join as nj
from facadelake.llm import shingles as sh
from facadelake.llm.common import flat

import pyarrow as pa


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def plain_components(rows, k, percent):
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random():.6f}"
    return words


def planted(seed, groups, size):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 12, 30, 60, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(size)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, 6, 10]))))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k,percent,leaf", [(3, 90, 2048), (5, 80, 2048), (3, 80, 7)])
def test_against_all_pairs(spark, k, percent, leaf):
    rows = planted(percent + leaf, 25, 24)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nj.ngram_components(docs, k, percent, leaf).collect())
    assert got == plain_components(rows, k, percent)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "one", 1), (4, "one", 1), (5, "ONE", 2), (6, "a b", 1), (7, "x " * 70000, 1)], "doc_id long, text string, n int"
    )
    got = sorted(tuple(r) for r in nj.ngram_components(docs).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7)]
    assert sorted(r.doc_id for r in nj.one_of_each(docs).collect()) == [1, 2, 3, 4, 4, 6, 7]
    assert nj.ngram_components(docs.limit(0)).count() == 0


def test_pigeonhole():
    """Pairs at the limit always share a cell."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for n in [*range(1, 60), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            out = int(len(a) * (100 - percent) / (100 + percent) * 2)
            for drop in range(out + 1):
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, out - drop, dtype=np.uint64)])
                b = np.unique(b)
                if nj.links(len(np.intersect1d(a, b)), len(a), len(b), percent) and len(a) and len(b):
                    if not np.array_equal(a, b):
                        assert len(np.intersect1d(nj.cells_of(a, percent), nj.cells_of(b, percent))), (percent, n, drop)


def test_words():
    texts = pa.array(["A b\tc\x0bD", None, "é É", "", "a\x00b \x1c c"])
    data, offsets = flat(texts)
    begins, ends = sh.word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(begins, ends)] == ["A", "b", "c", "D", "é", "É", "a\x00b", "\x1c", "c"]
    assert [len(s) for s in sh.shingle_sets(data, offsets, 3)] == [2, 0, 1, 0, 1]


def test_every_link(spark):
    """All links of edited copies, those that go through no pivot, too, against all pairs; copies and leaves of a large cell."""
    rng = random.Random(21)
    first = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(first)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, "")]
    found = {d: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for d, t in rows for w in [(t or "").split()]}
    want = {d: sum(bool(s) and d != e and bool(t) and 100 * len(s & t) >= 90 * len(s | t) for e, t in found.items()) for d, s in found.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert max(want.values()) > 10
    for leaf in (2048, 16):
        assert {r.doc_id: r.n_links for r in nj.ngram_links(docs, 3, 90, leaf=leaf).collect()} == want


@pytest.mark.parametrize("n,sides", [(0, 1), (1, 1), (33, 1), (2500, 1), (700, 2)])
def test_tree_of_several_levels(n, sides):
    """The tree lets through just the pairs whose bounds allow a link, each once, whatever its depth."""
    rng = np.random.default_rng(n)
    points = rng.poisson(rng.choice([0.4, 1, 3], (n, 1)) * np.ones((1, 64))).astype(np.uint32)
    if n > 10:
        points[n // 2 :] = points[: n - n // 2] + (rng.random((n - n // 2, 64)) < 0.03).astype(np.uint32)
    sizes, labels = points.sum(1).astype(np.int64), rng.integers(0, 9, n)
    side = rng.integers(0, sides, n)
    want = set()
    for i in range(n):
        j = np.arange(i + 1, n)
        good = np.minimum(points[i], points[j]).sum(1) >= nj.least_shared(sizes[i] + sizes[j], 90)
        # Sets that link are not too unlike in size, whatever they share.
        good &= (labels[i] != labels[j]) & (100 * sizes[i] >= 90 * sizes[j]) & (100 * sizes[j] >= 90 * sizes[i])
        good &= (side[i] != side[j]) | (sides == 1)
        want |= {(i, int(x)) for x in j[good]}
    got = [(int(min(x, y)), int(max(x, y))) for a, b in nj.tree_pairs(points, sizes, labels, side, 90) for x, y in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want
    assert n < 700 or want
