"""Forward-backward against enumeration and one long plain pass, held-out accuracy, switched text, edge cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from facadelake.llm import language_crf as crf

ROOT = "/root/testdata/sf0.01"


def plain(emissions, transitions):
    """Posteriors of one text by a plain pass in double precision."""
    n, k = emissions.shape
    t, e = np.exp(transitions), np.exp(emissions - emissions.max(1, keepdims=True))
    a, b = np.zeros((n, k)), np.ones((n, k))
    for i in range(n):
        a[i] = e[i] * (a[i - 1] @ t if i else 1)
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = t @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].max()
    g = a * b
    return g / g.sum(1, keepdims=True)


def test_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    weight = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, s in enumerate(path):
            weight[i, s] += p
    want = weight / weight.sum(1, keepdims=True)
    assert np.allclose(plain(e, t), want)
    assert np.allclose(crf.forward_backward(e, np.array([0, 5]), t), want, atol=1e-5)
    got, pairs, _ = crf._chains(np.stack([e, e]), t)
    assert np.allclose(got[0], want) and np.isclose(pairs.sum(), 2 * 4)


def test_blocks():
    """Many texts at once, empty ones and ones of many blocks, equal plain passes."""
    rng = np.random.default_rng(2)
    lengths = [0, 1, 63, 64, 65, 0, 128, 129, 1000, 3, 5000, 0]
    bounds = np.cumsum([0, *lengths])
    e, t = rng.normal(size=(bounds[-1], 4)) * 2, rng.normal(size=(4, 4)) * 1.5
    got = crf.forward_backward(e, bounds, t)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            assert np.allclose(got[a:b], plain(e[a:b], t), atol=2e-4), b - a


def test_held_out(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = crf.train(docs, where=F.col("doc_id") % 4 != 2)
    assert (np.diag(model.transitions) > model.transitions.mean(1)).all()  # languages go on
    out = crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97, right
    parts = {lang: docs.where((F.col("lang") == lang) & (F.col("doc_id") % 4 == 2) & (F.length("text") > 600)).first().text[100:400] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, parts["en"] + " " + parts["de"])], "doc_id long, text string")
    found = crf.spans(mixed, model).first().spans
    words = [len(crf.words_of(parts[x])) for x in ("en", "de")]
    held = {x: sum(s.last - s.first + 1 for s in found if s.lang == x) for x in ("en", "de")}
    assert abs(held["en"] - words[0]) < 0.15 * sum(words) and abs(held["de"] - words[1]) < 0.15 * sum(words)
    shares = crf.identify(mixed, model).first().shares
    assert 0.3 < shares["en"] < 0.7 and 0.3 < shares["de"] < 0.7


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 ½ _ !", "b"), (4, "ünï", None), (None, "wort", "de"), (5, "w" * 200_000, "de"), (5, "w" * 200_000, "de"), (6, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    model = crf.train(docs)
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in crf.identify(docs, model).collect()), key=str)
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3
    empty = crf.train(docs.limit(0))
    assert [r.lang_pred for r in crf.identify(docs, empty).collect()] == ["und"] * len(rows)
    assert crf.identify(docs.limit(0), model).count() == 0
    kept = crf.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {g.doc_id for g in crf.identify(docs, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert crf.accepted(docs, empty).count() == 0
    assert crf.spans(docs, model).count() == len(rows)
