"""The training queries' model: the whole grid is searched, fits in tasks follow the rules of Spark's boosted trees."""

import itertools
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from facadelake.operators import boosting, learn
from facadelake.plans import q_learn


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 4)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=160) > 0.2).astype(int)
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "vec_id long, y int, embedding array<double>"), x, y


def test_whole_grid(spark, some, monkeypatch):
    """All 27 points are searched, once for all queries of a session, and the best one is fitted on all rows."""
    fitted = []
    monkeypatch.setattr(learn, "GBTClassifier", lambda **kw: SimpleNamespace(fit=lambda rows: fitted.append((kw, rows.count())) or SimpleNamespace()))
    monkeypatch.setattr(learn, "PipelineModel", lambda stages: stages[0])
    monkeypatch.setattr(q_learn, "_TRAINED", {})
    t = SimpleNamespace(spark=spark, root="own", features=some[0].limit(60))
    model, scaled = q_learn.trained(t)
    assert q_learn.trained(t)[0] is model and len(fitted) == 1 and scaled.count() == 60
    _, scaled = learn.standardize(t.features, "embedding")
    grid = ((3, 5, 7), (100, 200, 300), (0.01, 0.1, 0.2))
    figures = {tuple(r)[:3]: r["f1"] for r in learn.grid_figures(scaled, "scaled", "y", "vec_id", *grid, 5, learn.class_balance(scaled).first()).collect()}
    assert set(figures) == set(itertools.product(*grid))
    kw, n = fitted[0]
    best = (kw["maxDepth"], kw["maxIter"], kw["stepSize"])
    assert n == 60 and best == max(itertools.product(*grid), key=figures.get)


def test_as_spark(spark, some):
    """Margins of a fit in a task against Spark's own trees, with few values, so that bins are the same."""
    df, x, y = some
    coarse = np.round(x * 2) / 2
    rows = spark.createDataFrame([([float(v) for v in r], float(c), 1.0 + 2 * int(c)) for r, c in zip(coarse, y)], "x array<double>, label double, weight double")
    rows = rows.select(array_to_vector("x").alias("vector"), "label", "weight").repartition(1)
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxDepth=3, maxIter=15, stepSize=0.1, seed=42).fit(rows)
    told = {(tuple(r["vector"].toArray()), r["label"]): r["rawPrediction"][1] for r in model.transform(rows).collect()}
    cells, sign, weight, margin = boosting.binned(coarse), np.where(y == 1, 1.0, -1.0), 1.0 + 2 * y, np.zeros(len(y))
    for m in range(15):
        target = sign if m == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        margin += boosting.tree(cells, target, weight, 3, 32) * (1.0 if m == 0 else 0.1)
    theirs = np.array([told[tuple(float(v) for v in r), float(c)] for r, c in zip(coarse, y)])
    assert np.mean((theirs > 0) == (margin > 0)) >= 0.97 and np.corrcoef(theirs, margin)[0, 1] > 0.98


def test_fewer_rounds(some):
    """The figures of fewer trees are those of a fit that stops there; held-out rows change no tree."""
    _, x, y = some
    cells, held_out, weight = boosting.binned(x), np.arange(160) % 5 == 0, np.ones(160)
    each = [boosting.fold_figures(cells, y == 1, weight, held_out, 3, 0.1, [n])[0] for n in (5, 20, 40)]
    assert boosting.fold_figures(cells, y == 1, weight, held_out, 3, 0.1, [5, 20, 40]) == each
    other = np.where(held_out, 1 - y, y) == 1
    a, b = (boosting.tree(cells, np.where(t, 1.0, -1.0), np.where(held_out, 0.0, weight), 3, 32) for t in (y == 1, other))
    assert (a == b).all()


def test_bound_and_shares(spark, some):
    """A search of 40 of 160 rows keeps the class shares; a model can be trained on it."""
    _, scaled = learn.standardize(some[0], "embedding")
    model = learn.train_filter(scaled, depths=[2], trees=[2, 4], rates=[0.1], search_rows=40)
    assert model.stages[0].getNumTrees in (2, 4) and learn.score(model, scaled).where(F.col("predicted").isNull()).count() == 0


def test_rows_on_all_cores(spark, some, monkeypatch):
    """A fit's rows are dealt over all cores in one round where there are enough, and the margins' lineage is cut."""
    assert [learn.fit_parts(n, 12) for n in (0, 500, 5_001, 120_000, 720_000, 2_400_001)] == [1, 1, 2, 12, 12, 24]
    dealt = []
    monkeypatch.setattr(learn, "GBTClassifier", lambda **kw: SimpleNamespace(fit=lambda rows: dealt.append((rows.rdd.getNumPartitions(), rows.count())) or SimpleNamespace()))
    monkeypatch.setattr(learn, "PipelineModel", lambda stages: stages[0])
    monkeypatch.setattr(learn, "TASK_ROWS", 20)
    _, scaled = learn.standardize(some[0], "embedding")
    learn.train_filter(scaled, depths=[2], trees=[2], rates=[0.1])
    assert dealt == [(8, 160)] and spark.sparkContext.getCheckpointDir()


@pytest.fixture(scope="module")
def many(spark):
    """More rows than Spark cuts its bins from."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=12_000).round(3), rng.exponential(size=12_000), rng.integers(0, 5, 12_000), np.append(np.zeros(11_999), 3.0)], axis=1)
    y = (x[:, 0] + x[:, 1] + rng.normal(scale=0.5, size=12_000) > 1).astype(int)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "vec_id long, y int, scaled array<double>")
    return df.repartition(3).cache(), x, y


def test_values_of_all_rows(many):
    """Bins are cut from all rows: the values in the middle of 32 equal shares, all values where they are few."""
    df, x, _ = many
    values = learn.bin_values(df, "scaled")
    middle = (2 * np.arange(32) + 1) * 12_000 // 64
    for f in (0, 1):
        assert values[f] == sorted(set(np.sort(x[:, f])[middle]))
    assert values[2:] == [[0, 1, 2, 3, 4], [0, 3]]
    one = df.where("vec_id = 11999").select(learn.to_bins(F.col("scaled"), values).alias("at"), learn.to_bins(F.col("scaled"), values, snap=True).alias("x")).first()
    near = [np.array(v)[np.argmin(np.abs(np.array(v) - own))] for v, own in zip(values, x[-1])]
    assert list(one["x"]) == near and [v[i] for v, i in zip(values, one["at"])] == near


@pytest.mark.parametrize("binned", [False, True])
def test_search_sees_all_rows(many, binned):
    """The figures of a grid point are those of folds of all rows, however many there are."""
    df, x, y = many
    values = learn.bin_values(df, "scaled") if binned else None
    found = learn.grid_figures(df, "scaled", "y", "vec_id", [2], [2], [0.1], 3, learn.class_balance(df).first(), values).first()["f1"]
    place = {r["vec_id"]: r["fold"] for r in learn.stratified_folds(df, "y", "vec_id", 3).collect()}
    fold, ratio = np.array([place[i] for i in range(len(y))]), (y == 0).sum() / (y == 1).sum()
    cells = np.stack([np.searchsorted((np.array(v[1:]) + np.array(v[:-1])) / 2, x[:, f]) for f, v in enumerate(values)], axis=1) if binned else boosting.binned(x)
    mine = [boosting.fold_figures(cells, y == 1, np.where(y == 1, ratio, 1.0), fold == i, 2, 0.1, [2])[0] for i in range(3)]
    assert len(place) == 12_000 and found == pytest.approx(np.mean(mine), abs=1e-9)


def test_thresholds_of_all_rows(many, monkeypatch):
    """Where Spark would cut bins from a sample, its thresholds are the midpoints of values that come from all rows, whatever the partitions."""
    df = many[0]
    values, models = learn.bin_values(df, "scaled"), []
    for parts in (1, 4):
        monkeypatch.setattr(learn, "fit_parts", lambda *_: parts)
        models.append(learn.train_filter(df, depths=[4], trees=[3], rates=[0.1]).stages[0].toDebugString)
    told = {(int(f), float(t)) for f, t in re.findall(r"feature (\d+) <= (\S+?)\)", models[0])}
    assert told and told <= {(f, (a + b) / 2) for f, v in enumerate(values) for a, b in itertools.pairwise(v)}
    assert told == {(int(f), float(t)) for f, t in re.findall(r"feature (\d+) <= (\S+?)\)", models[1])}
