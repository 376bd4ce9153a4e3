"""Queries of the false-positive filter and of descriptor matches (L*, A27, A28, J14, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.operators import descriptors, learn
from facadelake.plans.registry import query, sql_view
from facadelake.session import work_dir

_PAIR = "CAST(vec_id // 2 % 4 AS INT)"
sql_view("half_v", f"SELECT vec_id, {_PAIR} AS pair_id, vec_id % 2 AS side, embedding::DOUBLE[] AS v FROM features_v")
sql_view(
    "near2_v",
    "SELECT pair_id, l_id, arg_min(r_id, (d, r_id)) AS r_id, list_sort(list(d))[1] AS d1, list_sort(list(d))[2] AS d2 FROM (SELECT l.pair_id, l.vec_id AS l_id, r.vec_id AS r_id, list_distance(l.v, r.v) AS d FROM half_v l JOIN half_v r ON l.pair_id = r.pair_id AND l.side = 0 AND r.side = 1) x GROUP BY 1, 2",
)


@query("j14_ratio_match", "SELECT pair_id, l_id, r_id, round(d1, 5) AS distance FROM near2_v WHERE d1 < 0.95 * d2")
def _(t):
    rows = t.features.select(F.expr("CAST(vec_id div 2 % 4 AS INT)").alias("pair_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = descriptors.ratio_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "pair_id", 0.95, block=32)
    return out.select("pair_id", "l_id", "r_id", F.round("distance", 5).alias("distance"))


@query(
    "j15_reprojection_error",
    """SELECT i.inspection_id AS pair_id, round(avg(e), 5) AS mean_error, round(sqrt(avg(e * e)), 5) AS rmse FROM inspections_v i JOIN (
         SELECT inspection_id, sqrt(((1.01 * x + 0.02 * y + inspection_id % 9) / w - dx) ** 2 + ((0.01 * x + 0.99 * y - 2) / w - dy) ** 2) AS e
         FROM (SELECT inspection_id, centroid_x * 1e0 AS x, centroid_y * 1e0 AS y, centroid_x + line_no * 1e0 AS dx, centroid_y - line_no * 5e-1 AS dy, centroid_x * 1e-5 + centroid_y * 2e-5 + 1 AS w FROM defects_v) d) m ON i.inspection_id = m.inspection_id GROUP BY 1""",
)
def _(t):
    h = F.array(F.lit(1.01), F.lit(0.02), (F.col("inspection_id") % 9) * 1.0, F.lit(0.01), F.lit(0.99), F.lit(-2.0), F.lit(1e-5), F.lit(2e-5), F.lit(1.0))
    matrices = t.inspections_base.select(F.col("inspection_id").alias("pair_id"), h.alias("h"))
    matches = t.defects.select(
        F.col("inspection_id").alias("pair_id"), F.col("centroid_x").alias("src_x"), F.col("centroid_y").alias("src_y"),
        (F.col("centroid_x") + F.col("line_no") * 1.0).alias("dst_x"), (F.col("centroid_y") - F.col("line_no") * 0.5).alias("dst_y"),
    )
    out = descriptors.reprojection_error(matches, matrices).where("mean_error < double('infinity')")
    return out.withColumns({c: F.round(c, 5) for c in ("mean_error", "rmse")})


@query(
    "l1_standardize",
    """SELECT vec_id, CAST(dim AS INT) AS dim, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS z FROM (
         SELECT *, avg(x) OVER (PARTITION BY dim) AS m, stddev_pop(x) OVER (PARTITION BY dim) AS s FROM (
           SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM features_v) u) w""",
)
def _(t):
    _, scaled = learn.standardize(t.features, "embedding")
    return scaled.select("vec_id", F.posexplode("scaled").alias("dim", "z")).withColumn("z", F.round("z", 5))


@query("l2_reduce_pca", "SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS power FROM features_v")
def _(t):
    """All components: a turn of the space, which keeps every vector's length."""
    width = t.features.select(F.size("embedding")).first()[0]
    _, reduced = learn.reduce_pca(t.features, "embedding", min(128, width))
    return reduced.select("vec_id", F.size("reduced").alias("dims"), F.round(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x), 4).alias("power"))


@query(
    "l2_pca_variance",
    """SELECT CAST(count(*) AS INT) AS dims, round(sum(var_samp), 6) AS total_variance, true AS falling, true AS uncorrelated, true AS share_kept
       FROM (SELECT dim, var_samp(x) AS var_samp FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM features_v) u GROUP BY dim) v""",
)
def _(t):
    """A quarter of the components: their variances fall, add up to the model's share of the table's, and they are uncorrelated."""
    width = t.features.select(F.size("embedding")).first()[0]
    return learn.pca_report(t.features, "embedding", max(1, width // 4))


@query(
    "l3_assemble_vector",
    "SELECT vec_id, CAST(len(embedding) * 2 + 2 AS INT) AS dims, round(list_sum(embedding::DOUBLE[]) * 2 + vec_id % 7 + y, 4) AS total FROM features_v",
)
def _(t):
    parts = t.features.withColumns({"edge": F.array((F.col("vec_id") % 7).cast("double"), F.col("y").cast("double")), "texture": F.col("embedding"), "deep": F.col("embedding")})
    out = learn.assemble_vector(parts, ["edge", "texture", "deep"])
    return out.select("vec_id", F.size("features").alias("dims"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_TRAINED: dict[tuple[str, str], tuple] = {}


def trained(t):
    """One model a session and folder for all queries of it, by the operator's whole grid on all labelled rows."""
    key = (t.spark.sparkContext.applicationId, t.root)
    if key not in _TRAINED:
        standard, scaled = learn.standardize(t.features, "embedding")
        _TRAINED[key] = (learn.train_filter(scaled), standard)
    model, standard = _TRAINED[key]
    return model, standard.transform(t.features, "embedding", "scaled")


@query("l4_l5_train_and_score")
def _(t):
    model, scaled = trained(t)
    return learn.score(model, scaled).select("vec_id", "y", "predicted", F.round("p", 6).alias("p"))


@query("l5_score_rules", "SELECT vec_id, true AS in_range, true AS by_threshold, true AS as_loaded FROM features_v")
def _(t):
    """What holds of any model: probabilities in range, the verdict by the threshold, a loaded model scores as the saved one."""
    model, scaled = trained(t)
    path = work_dir(t.spark, "filter")
    learn.save_filter(model, path)
    loaded, settings = learn.load_filter(path)
    back = learn.score(loaded, scaled, threshold=settings["threshold"]).select("vec_id", F.col("p").alias("q"))
    rows = learn.score(model, scaled).join(back, "vec_id")
    return rows.select("vec_id", F.col("p").between(0, 1).alias("in_range"), (F.col("predicted") == (F.col("p") >= 0.75).cast("int")).alias("by_threshold"), (F.abs(F.col("p") - F.col("q")) < 1e-12).alias("as_loaded"))


@query("l5_pass_through", "SELECT vec_id, 1e0 AS p, CAST(1 AS INT) AS predicted FROM features_v")
def _(t):
    return learn.score(None, t.features).select("vec_id", "p", "predicted")


@query("l6_importances")
def _(t):
    model, _ = trained(t)
    return learn.importances(model, t.spark)


@query("k6_top_features")
def _(t):
    model, _ = trained(t)
    return learn.top_features(model, t.spark)


sql_view("hash_v", "SELECT vec_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM features_v")


@query("l7_stratified_split", "SELECT vec_id, y, CAST((r - 1) % 5 AS INT) AS fold, CASE WHEN r <= n * 0.7 THEN 'train' WHEN r <= n * 0.85 THEN 'validation' ELSE 'test' END AS split FROM hash_v")
def _(t):
    rows = t.features.select("vec_id", "y")
    folds = learn.stratified_folds(rows, "y", "vec_id", 5)
    return learn.stratified_split(folds, "y", "vec_id").select("vec_id", "y", "fold", "split")


@query(
    "l8_upsample_plan",
    """SELECT y, CASE WHEN total >= 100000 THEN n ELSE greatest(n, CASE WHEN y = 1 THEN tp ELSE 100000 - tp END) END AS rows, n AS originals FROM (
         SELECT y, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(floor(100000 * (sum(CASE WHEN y = 1 THEN n ELSE 0 END) OVER () / (sum(n) OVER ()))) AS BIGINT) AS tp FROM (SELECT y, count(*) AS n FROM features_v GROUP BY 1) c) x""",
)
def _(t):
    out = learn.upsample_plan(t.features.select("vec_id", "y"), "y", "vec_id", target=100_000)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("copy_no") == 0).alias("originals"))


@query("l9_save_load")
def _(t):
    model, scaled = trained(t)
    path = work_dir(t.spark, "filter")
    learn.save_filter(model, path)
    loaded, settings = learn.load_filter(path)
    return learn.score(loaded, scaled, threshold=settings["threshold"]).select("vec_id", "predicted", F.round("p", 6).alias("p"))


@query(
    "l10_flag_false_positives",
    "SELECT d.defect_id, p IS NOT NULL AND p < 0.75 AS is_false_positive, coalesce(p, 1) AS fp_confidence FROM defects_v d LEFT JOIN (SELECT doc_id, p FROM scores_v) s ON d.part_no * 3 + d.line_no = s.doc_id",
)
def _(t):
    rows = t.defects.withColumn("doc_id", F.col("part_no") * 3 + F.col("line_no"))
    verdicts = t.scores.withColumn("predicted", F.when(F.col("p") >= 0.75, 1).otherwise(0))
    return learn.flag_false_positives(rows, verdicts, "doc_id").select("defect_id", "is_false_positive", "fp_confidence")


@query(
    "a27_binary_metrics",
    """SELECT tp * 1e0 / (tp + fp) AS precision, tp * 1e0 / (tp + fn) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1, round((rs - np * (np + 1) / 2) / (np * nn), 9) AS auc, tp, fp, fn, tn FROM (
         SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
                sum(rk) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) * 1e0 AS np, count(*) FILTER (WHERE y = 0) * 1e0 AS nn
         FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM scores_v) r) m""",
)
def _(t):
    return learn.binary_metrics(t.scores, 0.5).withColumns({"f1": F.round("f1", 9), "auc": F.round("auc", 9)})


@query("a28_class_balance", "SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 0) * 1e0 / count(*) FILTER (WHERE y = 1) AS imbalance_ratio FROM features_v")
def _(t):
    return learn.class_balance(t.features)
