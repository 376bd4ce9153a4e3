"""Sketches against whole sets, the order of next documents, edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facadelake.llm.fingerprints import Sketch, _cuts_above, compared, edited, fingerprints, sketches


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 1, 4, 20, 300, 3000]))) for _ in range(n)]


def test_estimates():
    rng = np.random.default_rng(1)
    for n, m, shared in ((20_000, 20_000, 15_000), (50_000, 2_000, 1_500), (30, 40, 20), (400, 100_000, 200)):
        pool = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
        x, y = Sketch.of(a), Sketch.of(b)
        small, large = (x, y) if n < m else (y, x)
        assert abs(x.likeness(y) - shared / (n + m - shared)) < 0.06
        if n > 100:
            assert abs(small.containment(large) - shared / min(n, m)) < 0.15
        union = x.merged(y)
        whole = Sketch.of(np.union1d(a, b))
        assert union.reach <= max(whole.reach, x.reach) and np.array_equal(union.hashes, np.union1d(a, b)[: len(union.hashes)])
        assert Sketch.parse(x.text()).likeness(x) == 1.0 and Sketch.parse(x.text()).reach == x.reach


@pytest.mark.parametrize("parts", [1, 3, 7, 60])
def test_next_documents(spark, parts):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(101))] + [(7, "seven again"), (None, "no id here"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).selectExpr("*", "1 AS part", "2 AS fence")
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = edited(t, nxt)
        a, b, c = sketches([t, e, nxt])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.text(), b.text(), a.likeness(b), a.likeness(c)))
    got = [(r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in compared(docs, parts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.doc_id, r.fingerprint) for r in fingerprints(docs).collect()} == {(w[0], w[3]) for w in want}


def test_edges(spark):
    docs = spark.createDataFrame([(5, "one two three")], "doc_id long, text string")
    (r,) = compared(docs).collect()
    assert r.near_next == 1.0 and r.edited_text == "one two tone " [: 13 - 4] + "one "
    assert compared(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "é" * 40_000)], "doc_id long, text string")
    assert sorted((r.n_chars, r.near_next) for r in compared(nulls).collect()) == [(0, 0.0), (40_000, 0.0)]


def test_parts(spark):
    cuts = [90, 70, 50, 49, 20, 10, 3]
    got = spark.createDataFrame([(v,) for v in [*range(0, 100), None]], "v long").select("v", _cuts_above(F.col("v"), cuts).alias("p")).collect()
    assert all(r.p == (sum(c > r.v for c in cuts) if r.v is not None else len(cuts)) for r in got)
