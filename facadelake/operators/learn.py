"""The false-positive filter: features, folds, training, scoring and its figures."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from facadelake.config import DEFAULTS
from facadelake.session import ensure_checkpoint_dir

from . import boosting
from .hotkeys import ranked, spread_values

TASK_ROWS, PART_ROWS = 5_000, 200_000  # labelled rows that are worth a task, and that a partition holds at most
SEARCH_ROWS = 1_000_000  # labelled rows that one task of a search holds at most, about 400 bytes each; more are searched by Spark's trees, on all of them, too
SPARK_ROWS = 10_000  # labelled rows up to which Spark's trees cut their bins from all rows; beyond, from a sample of as many


# --- features ---------------------------------------------------------------------------------------


def assemble_vector(df: DataFrame, parts: Sequence[str], out: str = "features") -> DataFrame:
    """Feature parts (arrays) in order, as one array."""
    return df.withColumn(out, F.concat(*[F.col(p).cast("array<double>") for p in parts]))


@dataclass
class Standardizer:
    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
        mean, std = (F.array(*[F.lit(v) for v in values]) for values in (self.mean, self.std))
        triples = F.arrays_zip(F.col(col).cast("array<double>").alias("x"), mean.alias("m"), std.alias("s"))
        return df.withColumn(out, F.transform(triples, lambda t: (t["x"] - t["m"]) / t["s"]))


def standardize(df: DataFrame, col: str, out: str = "scaled") -> tuple[Standardizer, DataFrame]:
    """Mean 0 and population deviation 1 per dimension; a constant dimension is only centred. One
    tree-aggregated pass; the model is two numbers per dimension."""
    vec = array_to_vector(F.col(col).cast("array<double>"))
    row = df.agg(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    std = [((v * (n - 1) / n) ** 0.5 if n > 1 else 0.0) or 1.0 for v in row["variance"].toArray()]
    model = Standardizer([float(m) for m in row["mean"].toArray()], [float(s) for s in std])
    return model, model.transform(df, col, out)


def reduce_pca(df: DataFrame, col: str, k: int = 128, out: str = "reduced", fit: bool = True):
    """``k`` principal components; unfitted, the first ``k`` dimensions as they are."""
    if not fit:
        return None, df.withColumn(out, F.slice(col, 1, k))
    vectors = df.withColumn("__v", array_to_vector(F.col(col).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors)
    return model, model.transform(vectors).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def pca_report(df: DataFrame, col: str, k: int) -> DataFrame:
    """One row on a reduction to ``k`` components, worked out from the reduced rows: the table's number of dimensions and total variance,
    whether the components' variances fall, whether no component goes together with the next, and whether they hold the share of the variance that the model says.
    """
    model, reduced = reduce_pca(df, col, k)
    said = float(sum(model.explainedVariance.toArray()))
    dims = df.select(F.posexplode(F.col(col).cast("array<double>")).alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("v"))
    whole = dims.agg(F.count(F.lit(1)).cast("int").alias("dims"), F.sum("v").alias("total"))
    parts = [F.col("reduced")[i] for i in range(k)]
    variances = [F.var_samp(p) for p in parts]
    # Each component against the next, the last against the first.
    pairs = [(i, (i + 1) % k) for i in range(k)] if k > 1 else []
    together = [F.abs(F.covar_samp(parts[i], parts[j])) for i, j in pairs]
    kept = reduced.agg(F.array(*variances).alias("v"), F.array(*together, F.lit(0.0)).alias("c"))
    both = whole.crossJoin(F.broadcast(kept))  # one row each
    power = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    slack = F.col("total") * 1e-6
    falling = F.forall(F.sequence(F.lit(1), F.lit(max(1, k - 1))), lambda i: F.coalesce(F.get("v", i) <= F.get("v", i - 1) + slack, F.lit(True)))
    return both.select(
        "dims", F.round("total", 6).alias("total_variance"), falling.alias("falling"), F.forall("c", lambda x: x <= slack).alias("uncorrelated"),
        (F.abs(power - F.col("total") * said) <= slack).alias("share_kept"),
    )


# --- folds and balance ---------------------------------------------------------------------------------


def _by_hash(df: DataFrame, keys: Sequence[str], id_col: str, out: str) -> DataFrame:
    """Rank within a class by the hash of the id: two classes hold all rows, so ranks are made per hash range."""
    h = F.md5(F.col(id_col).cast("string"))
    hashed = df.withColumn("__h", h)
    return ranked(hashed, keys, ["__h", id_col], F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"), out).drop("__h")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, out: str = "fold") -> DataFrame:
    return _by_hash(df, [label], id_col, "__r").withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def stratified_split(df: DataFrame, label: str, id_col: str, weights: Sequence[float] = (0.70, 0.15, 0.15), out: str = "split") -> DataFrame:
    """Train, validation and test parts with the class shares kept."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    placed = _by_hash(df, [label], id_col, "__r").join(F.broadcast(sizes), label)
    a, b = weights[0], weights[0] + weights[1]
    part = F.when(F.col("__r") <= F.col("__n") * a, "train").when(F.col("__r") <= F.col("__n") * b, "validation").otherwise("test")
    return placed.withColumn(out, part).drop("__r", "__n")


def class_balance(labels: DataFrame, label: str = "y") -> DataFrame:
    """Class counts and the weight of a positive; a missing class is an error."""
    counts = labels.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    ok = (F.col("positives") > 0) & (F.col("negatives") > 0)
    checked = F.when(ok, F.col("negatives") / F.nullif(F.col("positives"), F.lit(0))).otherwise(
        F.raise_error(F.lit("Training set must contain both classes.")).cast("double")
    )
    return counts.withColumn("imbalance_ratio", checked)


def upsample_plan(df: DataFrame, label: str, id_col: str, target: int = DEFAULTS.upsample_target) -> DataFrame:
    """Rows plus seeded copies up to ``target``, class shares kept; already large sets stay as they are.
    ``copy_no`` is 0 for the rows themselves."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = per_class.agg(
        F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__classes"), F.sum(F.when(F.col(label) == 1, F.col("__n")).otherwise(0)).alias("__pos")
    )
    pos = F.floor(F.lit(target) * (F.col("__pos") / F.nullif(F.col("__total"), F.lit(0))))
    wanted = F.when(F.col("__classes") == 1, F.lit(target)).when(F.col(label) == 1, pos).otherwise(F.lit(target) - pos)
    need = F.when(F.col("__total") >= target, 0).otherwise(F.greatest(F.lit(0), wanted - F.col("__n"))).cast("int")
    # Two classes and one total: a handful of rows. The draws grow with ``target``, so their join is left to run-time figures.
    draws = (
        per_class.crossJoin(F.broadcast(totals))
        .withColumn("__need", need)
        .where("__need > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__need"))))
        .select(label, "copy_no", (F.pmod(F.xxhash64(label, "copy_no"), F.col("__n")) + 1).alias("__r"))
    )
    numbered = _by_hash(df, [label], id_col, "__r")
    copies = numbered.join(draws, [label, "__r"]).select(*df.columns, "copy_no")
    return df.withColumn("copy_no", F.lit(0)).unionByName(copies)


# --- the model --------------------------------------------------------------------------------------------


def bin_values(df: DataFrame, features: str, bins: int = 32) -> list[list[float]]:
    """Up to ``bins`` values a feature, from all rows: those in the middle of as many equal shares of them, or all it has."""
    each = df.select(F.posexplode(F.col(features).cast("array<double>")).alias("dim", "x"))
    return [r["values"] for r in spread_values(each, ["dim"], "x", bins, "values").orderBy("dim").collect()]


def to_bins(x: Column, values: list[list[float]], snap: bool = False) -> Column:
    """A row's bins, a byte a feature: how many midpoints of the feature's ``values`` lie below. With ``snap``, the values of these bins, as an array."""

    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = [np.array(v, float) for v in values]
        cuts = [(v[:-1] + v[1:]) / 2 for v in own]
        for rows in batches:
            if not len(rows):
                yield pd.Series([], dtype=object)
                continue
            matrix = np.stack(rows.to_numpy())
            at = np.stack([np.searchsorted(c, matrix[:, f], "left") for f, c in enumerate(cuts)], axis=1)
            yield pd.Series([*np.stack([v[at[:, f]] for f, v in enumerate(own)], axis=1)] if snap else [r.tobytes() for r in at.astype(np.uint8)])

    return F.pandas_udf(cells, "array<double>" if snap else "binary")(x.cast("array<double>"))


def grid_figures(df: DataFrame, features: str, label: str, id_col: str, depths: Sequence[int], trees: Sequence[int], rates: Sequence[float], k: int,
                 balance: Row, values: list[list[float]] | None = None) -> DataFrame:
    """``(depth, trees, rate, f1)``: every grid point's mean over ``k`` stratified folds, of all rows.

    A depth, rate and fold is one fit, which has the figures of all numbers of trees, and one task (``boosting``). With ``values`` (``bin_values``) a task
    gets a byte a feature and row; without, it cuts the bins itself.
    """
    ratio = float(balance["imbalance_ratio"])
    fits = [(d, float(r), i) for d in depths for r in rates for i in range(k)]
    counts = [int(n) for n in trees]
    x = F.col(features).cast("array<double>") if values is None else to_bins(F.col(features), values)
    rows = _by_hash(df.select(id_col, label, x.alias("x")), [label], id_col, "__r")
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1))).alias("fit"), F.col("__r").cast("long").alias("r"), (F.col(label) == 1).alias("y"), "x")

    def one(pdf):
        pdf = pdf.sort_values(["y", "r"])
        depth, rate, i = fits[pdf["fit"].iloc[0]]
        y, r, x = pdf["y"].to_numpy(bool), pdf["r"].to_numpy(), pdf.pop("x")
        cells = boosting.binned(np.stack(x.to_numpy())) if values is None else np.frombuffer(b"".join(x), np.uint8).reshape(len(y), -1)
        cells = np.asfortranarray(cells, np.uint8)
        del pdf, x
        figures = boosting.fold_figures(cells, y, np.where(y, ratio, 1.0), (r - 1) % k == i, depth, rate, counts)
        return pd.DataFrame({"depth": depth, "trees": counts, "rate": rate, "f1": figures})

    done = each.repartition(4 * len(fits), "fit").groupBy("fit").applyInPandas(one, "depth int, trees int, rate double, f1 double")
    return done.groupBy("depth", "trees", "rate").agg(F.avg("f1").alias("f1"))


def fit_parts(rows: int, cores: int) -> int:
    """Partitions of a fit: a pass over the rows is one round of tasks on all cores, or as few as ``PART_ROWS`` allows; few rows are few tasks."""
    return max(1, min(-(-rows // TASK_ROWS), cores * -(-rows // (cores * PART_ROWS))))


def train_filter(df: DataFrame, features: str = "scaled", label: str = "y", id_col: str = "vec_id", depths: Sequence[int] = (3, 5, 7), trees: Sequence[int] = (100, 200, 300),
                 rates: Sequence[float] = (0.01, 0.1, 0.2), forest: bool = False, seed: int = 42, search_rows: int = SEARCH_ROWS) -> PipelineModel:
    """Boosted trees, positives weighted by the class ratio, the grid searched with stratified folds on F1; equal figures: the first of the grid.

    Search and fit see all rows. Up to ``search_rows`` of them a fit of the search is one task; more are searched by Spark's own distributed trees.
    The best point's model is fitted by Spark. A round of boosting is a Spark job per level of a tree, so rows are dealt by ``fit_parts``:
    small sets pay for one task a job, large ones keep all cores busy at once. Beyond ``SPARK_ROWS`` Spark would cut its bins from a sample that depends on
    the partitions: there each feature's values are replaced by 32 of them (``bin_values``), at whose midpoints Spark then parts the rows as it would the
    original ones, and ``maxBins`` is raised until its sample is all rows; bins stay at 32. Margins are checkpointed every ten trees, or the tasks of the
    last trees would carry all trees before them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    balance = class_balance(df, label).first()
    total = balance["positives"] + balance["negatives"]
    k = min(5, max(2, min(balance["positives"], balance["negatives"])))
    weight = F.when(F.col(label) == 1, F.lit(float(balance["imbalance_ratio"]))).otherwise(1.0)
    by_spark = forest or total > search_rows
    # Only a search in Spark reads folds from the rows.
    folds = ["fold"] if by_spark else []
    values = bin_values(df, features) if total > SPARK_ROWS else None
    vector = F.col(features).cast("array<double>") if values is None else to_bins(F.col(features), values, snap=True)
    rows = (stratified_folds(df, label, id_col, k) if by_spark else df).select(
        F.col(label).cast("double").alias("label"), array_to_vector(vector).alias("vector"), weight.alias("weight"), *folds, F.col(id_col).alias("__id")
    )
    parts = fit_parts(total, df.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, "__id").sortWithinPartitions("__id").drop("__id").persist()
    shared = {"featuresCol": "vector", "labelCol": "label", "weightCol": "weight", "seed": seed, "maxBins": max(32, math.isqrt(total) + 1) if values else 32}
    try:
        if by_spark:
            base = RandomForestClassifier(**shared) if forest else GBTClassifier(**shared)
            grid = ParamGridBuilder().addGrid(base.maxDepth, list(depths)).addGrid(base.numTrees if forest else base.maxIter, list(trees))
            grid = (grid if forest else grid.addGrid(base.stepSize, [float(r) for r in rates])).build()
            judge = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
            search = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=k, foldCol="fold", parallelism=2, seed=seed)
            return PipelineModel([search.fit(rows).bestModel])
        figures = {(r["depth"], r["trees"], r["rate"]): r["f1"] for r in grid_figures(df, features, label, id_col, depths, trees, rates, k, balance, values).collect()}
        depth, n, rate = max(((d, n, float(r)) for d in depths for n in trees for r in rates), key=figures.get)
        base = GBTClassifier(**shared, maxDepth=depth, maxIter=n, stepSize=rate)
        return PipelineModel([base.fit(rows)])
    finally:
        rows.unpersist()


def score(model: PipelineModel | None, df: DataFrame, features: str = "scaled", threshold: float = DEFAULTS.false_positive_threshold) -> DataFrame:
    """Probability of a true defect and its label; without a model everything is a true defect."""
    if model is None:
        return df.withColumns({"p": F.lit(1.0), "predicted": F.lit(1)})
    out = model.transform(df.withColumn("vector", array_to_vector(F.col(features).cast("array<double>"))))
    p = vector_to_array("probability")[1]
    return out.withColumns({"p": p, "predicted": F.when(p >= threshold, 1).otherwise(0)}).select(*df.columns, "p", "predicted")


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Importance per feature; as many numbers as the model has inputs."""
    values = [(i, float(v)) for i, v in enumerate(model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(values, "feature int, importance double")


def top_features(model: PipelineModel, spark: SparkSession, k: int = 10) -> DataFrame:
    return importances(model, spark).orderBy(F.col("importance").desc(), "feature").limit(k)


def save_filter(model: PipelineModel, path: str, threshold: float = DEFAULTS.false_positive_threshold, enabled: bool = True) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.range(1).select(F.lit(json.dumps({"threshold": threshold, "enabled": enabled})).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_filter(path: str) -> tuple[PipelineModel, dict]:
    settings = json.loads(SparkSession.active().read.text(f"{path}/settings").first()[0])
    return PipelineModel.load(f"{path}/model"), settings


def flag_false_positives(defects: DataFrame, scored: DataFrame, key: str = "defect_id") -> DataFrame:
    """The filter's verdict on the defects; a defect that was not scored stays a true one."""
    verdict = scored.select(key, (F.col("predicted") == 0).alias("__fp"), F.col("p").alias("__p"))
    return defects.drop("is_false_positive", "fp_confidence").join(verdict, key, "left").select(
        *[c for c in defects.columns if c not in ("is_false_positive", "fp_confidence")],
        F.coalesce("__fp", F.lit(False)).alias("is_false_positive"), F.coalesce("__p", F.lit(1.0)).alias("fp_confidence"),
    )


# --- figures -----------------------------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(scored: DataFrame, threshold: float = DEFAULTS.false_positive_threshold, label: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1, the confusion matrix and the area under the curve.

    The area is the rank sum with average ranks: scores are counted, put in 4096 ranges of [0, 1], and
    ranked within a range after the totals of the ranges before it.
    """
    yes, pos = F.col(p) >= threshold, F.col(label) == 1
    cells = scored.agg(
        F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn")
    )
    counted = scored.groupBy(F.col(p).alias("__p")).agg(F.count_if(pos).alias("__pos"), F.count_if(~pos).alias("__neg")).withColumn(
        "__range", F.floor(F.col("__p") * 4096).cast("int")
    )
    ranges = counted.groupBy("__range").agg(F.sum("__neg").alias("__n")).withColumn(
        "__below", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = Window.partitionBy("__range").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("__below") + F.coalesce(F.sum("__neg").over(inside), F.lit(0))
    area = counted.join(ranges.select("__range", "__below"), "__range").withColumn("__a", F.col("__pos") * (lower + F.col("__neg") / 2.0)).agg(F.sum("__a").alias("__area"))
    both = cells.crossJoin(F.broadcast(area))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return both.select(
        precision.alias("precision"), recall.alias("recall"), _ratio(precision * recall * 2, precision + recall).alias("f1"),
        F.try_divide(F.col("__area"), ((F.col("tp") + F.col("fn")) * (F.col("fp") + F.col("tn"))).cast("double")).alias("auc"), "tp", "fp", "fn", "tn",
    )
