"""Classifier and rates against plain versions, targets met, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facadelake.llm import mixing as m

ROOT = "/root/testdata/sf0.01"


def test_held_out(spark):
    """Learned on two thirds of the labels, the posteriors rank the rest: macro-averaged recall well above chance."""
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    model = m.Classifier.fit(docs, labels.where("doc_id % 3 > 0"))
    out = m.with_posteriors(docs, model).join(m.labelled(labels).where("doc_id % 3 = 0"), "doc_id")
    rows = out.select("domain", *(f"p_{d}" for d in m.DOMAINS)).collect()
    prior = np.array(model.prior)
    recall = []
    for k in range(3):
        own = [r for r in rows if r.domain == k]
        recall.append(np.mean([int(np.argmax(np.array(r[1:]) / prior)) == k for r in own]))
    assert np.mean(recall) > 0.6, recall


def plain_rates(p, n, share, steps):
    """The same descent with whole arrays."""
    total, rate = n.sum(), np.ones(len(n))
    gram = (p * n[:, None]).T @ p
    for _ in range(steps):
        miss = (rate * n) @ p - share * total
        if abs(miss).max() <= m.TOLERANCE * total:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, miss))
    return rate


@pytest.mark.parametrize("share", [(0.5, 0.3, 0.2), (0.97, 0.02, 0.01), (0.0, 0.0, 1.0)])
def test_rates(spark, share):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.3, 0.2], 4000)
    n = rng.integers(0, 5000, 4000)
    table = spark.createDataFrame([(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double").repartition(5)
    steps = m.fit_rates(table, dict(zip(m.DOMAINS, share)))
    got = np.array([r.rate for r in table.withColumn("rate", m.rate_of(steps)).orderBy("doc_id").collect()])
    want = plain_rates(p, n.astype(float), np.array(share), m.STEPS)
    assert (got >= 0).all() and np.allclose(got, want, atol=1e-5)
    if share[0] == 0.5:  # met without any rate at zero, or nearly
        assert np.allclose((got * n) @ p / n.sum(), share, atol=1e-3)


def test_mixed(spark):
    """The drawn corpus has about the target shares of expected tokens; rows keep all their columns."""
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    targets = {"high": 0.6, "low": 0.3, "toxic": 0.1}
    model, steps, rated = m.mixing_rates(docs, labels, targets)
    out = m.mixed(docs, labels, targets)
    assert out.columns == docs.columns
    drawn = m.with_posteriors(out, model)
    got = drawn.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in m.DOMAINS)).first()
    assert np.allclose(np.array(got) / sum(got), [0.6, 0.3, 0.1], atol=0.05)
    expected = rated.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in m.DOMAINS)).first()
    assert np.allclose(np.array(expected) / sum(expected), [0.6, 0.3, 0.1], atol=1e-3)


def test_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "a b", 7), (3, "good words here", 7), (3, "good words here", 7), (4, "bad " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain int").selectExpr("*", "1 AS n_tokens0", "2 AS _h", "3 AS high")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (4, 0, 0), (None, 1, 1), (9, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    _, steps, rated = m.mixing_rates(docs, labels)
    got = {(r.doc_id, r.n_tokens): r for r in rated.collect()}
    assert rated.count() == 6 and all(r.rate >= 0 and abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 for r in got.values())
    assert got[(3, 3)].p_high > got[(4, 50_000)].p_high
    assert m.mixed(docs, labels).columns == docs.columns
    assert m.mixed(docs, labels.limit(0)).count() > 0
    assert m.mixing_rates(docs.limit(0), labels)[2].count() == 0 and m.mixed(docs.limit(0), labels.limit(0)).count() == 0


def test_solve():
    rng = random.Random(1)
    for _ in range(50):
        a = np.array([[rng.random() for _ in range(3)] for _ in range(5)])
        g = a.T @ a
        b = [rng.random() for _ in range(3)]
        assert np.allclose(m.solve(g.tolist(), b), np.linalg.solve(g, b))
    assert m.solve([[2.0, 0.0], [0.0, 0.0]], [4.0, 5.0]) == [2.0, 0.0]


@pytest.mark.parametrize("bad", [1, 12])
def test_clean_stay(spark, bad):
    """No document judged clean is drawn away, on a corpus above the targets (1 of 40 toxic) and on one below; bad domains don't rise."""
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        toxic, low = i % 40 < bad, 30 < i % 40 < 31 + bad // 4
        own = "venom" if toxic else "junk" if low else "fine"
        words = [f"{own if rng.random() < 0.3 else 'any'}{rng.randrange(40)}" for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not toxic and not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model, _, rated = m.mixing_rates(docs, labels)
    clean = {r.doc_id for r in rated.where(m.judged_clean()).collect()}
    out = m.mixed(docs, labels, keep_clean=True)
    assert len(clean) > 200 and clean <= {r.doc_id for r in out.collect()}
    shares = [x.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens") for d in m.DOMAINS)).first() for x in (rated, m.with_posteriors(out, model))]
    assert shares[1][0] >= shares[0][0] - 0.005 and shares[1][2] <= shares[0][2] + 0.005
