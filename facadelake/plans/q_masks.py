"""Queries of masks, skeletons, bars and frame kernels (M*, A19-A26, A31, N7, J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.operators import components, kernels, masks
from facadelake.plans.registry import query, sql_view
from facadelake.sources.tables import IMAGE_H, IMAGE_W

COUNTS = ["part_no % 50", "1 + supp_no % 30", "part_no % 20", "1 + line_no * 5", "part_no % 300", "1 + supp_no"]


def rle_masks(t):
    """A 16 x 20 mask per defect as six run lengths; some overflow the mask."""
    return t.defects.select(
        F.col("defect_id").alias("mask_id"), F.expr("array(" + ", ".join(f"CAST({c} AS INT)" for c in COUNTS) + ")").alias("counts"),
        F.lit(16).alias("height"), F.lit(20).alias("width"),
    )


sql_view(
    "rle_v",
    "SELECT defect_id, p.pos, CASE p.pos " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(COUNTS)) + " END AS n FROM defects_v, (SELECT unnest(range(6)) AS pos) p",
)
sql_view(
    "decoded_v",
    """SELECT mask_id, y, greatest(s - y * 20, 0) AS x0, least(e - y * 20, 20) - 1 AS x1 FROM (
         SELECT defect_id AS mask_id, least(end_px - n, 320) AS s, least(end_px, 320) AS e, pos FROM (SELECT *, sum(n) OVER (PARTITION BY defect_id ORDER BY pos) AS end_px FROM rle_v) a WHERE pos % 2 = 1) b,
         (SELECT unnest(range(16)) AS y) r WHERE s < e AND y BETWEEN s // 20 AND (e - 1) // 20""",
)


@query("m2_decode_runs", "SELECT mask_id, CAST(y AS INT) AS y, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM decoded_v")
def _(t):
    return masks.decode_runs(rle_masks(t))


@query(
    "m2_encode_runs",
    """SELECT defect_id AS mask_id, string_agg(CAST(least(end_px, 320) - (end_px - n) AS VARCHAR), ' ' ORDER BY pos) AS counts FROM (
         SELECT *, sum(n) OVER (PARTITION BY defect_id ORDER BY pos) AS end_px FROM (SELECT defect_id, pos, CASE WHEN pos > 0 AND n = 0 THEN 1 ELSE n END AS n FROM rle_v) a) b
       WHERE (pos % 2 = 1 AND end_px - n < 320) OR (pos % 2 = 0 AND end_px < 320) GROUP BY 1""",
)
def _(t):
    """Encoding the decoded masks; equal to the clipped input where no inner run is empty."""
    sizes = rle_masks(t).select("mask_id", "height", "width").where(F.lit(True))
    out = masks.encode_runs(masks.decode_runs(rle_masks(t).withColumn("counts", _no_gaps())), sizes)
    return out.select("mask_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), " ").alias("counts"))


def _no_gaps():
    # Inner background runs of at least one pixel keep the two foreground runs apart.
    return F.transform("counts", lambda c, i: F.when((i == 0) | (c > 0), c).otherwise(1))


sql_view("detection_v", "SELECT defect_id AS mask_id, bbox_x AS bbx, bbox_y AS bby, bbox_w AS bw, bbox_h AS bh, line_no % 2 = 0 AS has_mask FROM boxes_v")


@query(
    "n7_place_masks",
    """SELECT mask_id, count(*) AS n_runs, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area_px, min(y) AS min_y, max(y) AS max_y FROM (
         SELECT mask_id, CAST(y AS INT) AS y, greatest(x0, 0) AS x0, least(x1, 511) AS x1 FROM (
           SELECT d.mask_id, r.y + d.bby AS y, r.x0 + d.bbx AS x0, r.x1 + d.bbx AS x1 FROM decoded_v r JOIN detection_v d ON r.mask_id = d.mask_id WHERE has_mask
           UNION ALL SELECT mask_id, bby + k, bbx, bbx + bw - 1 FROM detection_v, (SELECT unnest(range(140)) AS k) s WHERE NOT has_mask AND k < bh) a
         WHERE y >= 0 AND y < 384 AND x1 >= 0 AND x0 < 512) b GROUP BY 1""",
)
def _(t):
    det = t.boxes.select(
        F.col("defect_id").alias("mask_id"), F.col("bbox_x").alias("bx"), F.col("bbox_y").alias("by"), F.col("bbox_w").alias("bw"), F.col("bbox_h").alias("bh"),
        F.lit(IMAGE_W).alias("image_w"), F.lit(IMAGE_H).alias("image_h"), (F.col("line_no") % 2 == 0).alias("has_mask"),
    )
    placed = masks.place_masks(masks.decode_runs(rle_masks(t)), det)
    return placed.groupBy("mask_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area_px"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


sql_view("run_px_v", "SELECT mask_id, y * 1e0 AS y, x * 1e0 AS x FROM runs_v, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) p")
sql_view(
    "moment_v",
    """SELECT *, 0.5 * atan2(2 * cxy, cxx - cyy) AS theta FROM (SELECT mask_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy,
         sum(x * x) / count(*) - cx * cx AS cxx, sum(y * y) / count(*) - cy * cy AS cyy, sum(x * y) / count(*) - cx * cy AS cxy FROM run_px_v GROUP BY 1) m""",
)


@query(
    "a22_mask_moments",
    """SELECT m.mask_id, n * 1e0 AS area_px, CAST(min_x AS INT) AS min_x, CAST(min_y AS INT) AS min_y, CAST(max_x - min_x + 1 AS INT) AS bbox_w, CAST(max_y - min_y + 1 AS INT) AS bbox_h, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
         round(len, 5) AS length_px FROM moment_v m JOIN (SELECT p.mask_id, max(x * cos(theta) + y * sin(theta)) - min(x * cos(theta) + y * sin(theta)) AS len FROM run_px_v p JOIN moment_v m ON p.mask_id = m.mask_id GROUP BY 1) l
         ON m.mask_id = l.mask_id""",
)
def _(t):
    out = masks.mask_moments(t.runs)
    return out.select(
        "mask_id", "area_px", "min_x", "min_y", "bbox_w", "bbox_h", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"),
        F.round("length_px", 5).alias("length_px"),
    )


sql_view(
    "skel_v",
    """SELECT mask_id, sum(px) AS length_px, sum(cm) AS length_cm FROM (
         SELECT a.mask_id, o.px, o.cm FROM pixels_v a, (VALUES (1, 0, 1e0, 0.2e0), (0, 1, 1e0, 0.15e0), (1, 1, sqrt(2e0), 0.25e0), (-1, 1, sqrt(2e0), 0.25e0)) AS o(dx, dy, px, cm)
         WHERE EXISTS (SELECT 1 FROM pixels_v b WHERE b.mask_id = a.mask_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy)) e GROUP BY 1""",
)


@query("a20_skeleton_length", "SELECT mask_id, round(length_px, 5) AS length_px, round(length_cm, 5) AS length_cm FROM skel_v")
def _(t):
    out = masks.skeleton_length(t.pixels, 0.2, 0.15)
    return out.select("mask_id", F.round("length_px", 5).alias("length_px"), F.round("length_cm", 5).alias("length_cm"))


@query(
    "a21_tortuosity",
    """SELECT p.mask_id, round(s.length_px / p.d, 6) AS tortuosity FROM (SELECT mask_id, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS d FROM pixels_v GROUP BY 1) p JOIN skel_v s ON p.mask_id = s.mask_id""",
)
def _(t):
    return masks.tortuosity(t.pixels).select("mask_id", F.round("tortuosity", 6).alias("tortuosity"))


@query(
    "a19_width_profile",
    """SELECT s.mask_id, n AS n_points, round(med * 1.5, 6) AS median_width_mm, round(top * 1.5, 6) AS max_width_mm, p.profile
       FROM (SELECT mask_id, count(*) AS n, median(w) AS med, max(w) AS top FROM prof_v GROUP BY 1) s
       JOIN (SELECT mask_id, string_agg(CAST(CAST(round(w * 15) AS BIGINT) AS VARCHAR), ',' ORDER BY rn) AS profile
             FROM (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY y, x) - 1 AS rn, count(*) OVER (PARTITION BY mask_id) AS n FROM prof_v) q
             WHERE list_contains(list_transform(range(least(10, n)), lambda i: CASE WHEN i = least(10, n) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) * 1e0 / greatest(least(10, n) - 1, 1))) AS BIGINT) END), rn) GROUP BY 1) p
         ON s.mask_id = p.mask_id""",
)
def _(t):
    points = t.pixels.withColumn("distance", ((F.col("x") * 7 + F.col("y") * 3) % 20) / 2.0)
    out = masks.width_profile(points, 0.15)
    text = F.array_join(F.transform("profile_mm", lambda w: F.round(w * 10).cast("long").cast("string")), ",")
    return out.select("mask_id", "n_points", F.round("median_width_mm", 6).alias("median_width_mm"), F.round("max_width_mm", 6).alias("max_width_mm"), text.alias("profile"))


sql_view("prof_v", "SELECT mask_id, x, y, ((x * 7 + y * 3) % 20) / 2e0 * 2 AS w FROM pixels_v")


@query(
    "a23_checked_area",
    "SELECT defect_id, CASE WHEN c = 0 OR abs(p - c) / greatest(p, 1e-6) > 0.02 THEN p ELSE (p + c) / 2 END AS area FROM (SELECT defect_id, area_cm2 AS p, CASE WHEN line_no = 7 THEN 0 ELSE area_cm2 * (1 + (part_no % 9 - 4) / 1.3e2) END AS c FROM defects_v) d",
)
def _(t):
    contour = F.when(F.col("line_no") == 7, 0.0).otherwise(F.col("area_cm2") * (F.lit(1) + (F.col("part_no") % 9 - 4) / F.lit(130.0)))
    return t.defects.select("defect_id", masks.checked_area("area_cm2", contour).alias("area"))


def component_rows(t):
    """Detections per image with a unique ordinal."""
    return t.defects.select(
        F.col("inspection_id").alias("image_id"), (F.col("line_no") * 10_000_000_000 + F.col("part_no") * 100_000 + F.col("supp_no")).alias("ordinal"),
        "length_cm", "width_mm", (F.col("part_no") % 91).cast("double").alias("angle_deg"), (F.lit(1.0) + (F.col("supp_no") % 70) / 10.0).alias("elongation"),
    )


sql_view(
    "comp_v",
    "SELECT inspection_id AS image_id, CAST(line_no AS BIGINT) * 10000000000 + part_no * 100000 + supp_no AS ordinal, length_cm, width_mm, CAST(part_no % 91 AS DOUBLE) AS angle_deg, 1e0 + (supp_no % 70) / 1e1 AS elongation FROM defects_v",
)


@query(
    "a24_primary_detection",
    """SELECT i.inspection_id AS image_id, coalesce(n, 0) AS detected_count, coalesce(g.ordinal, 0) AS geo_ordinal, coalesce(g.length_cm, 0) AS geo_length_cm, coalesce(c.ordinal, 0) AS cv_ordinal FROM inspections_v i
       LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM comp_v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY elongation >= 3 DESC, elongation * length_cm DESC, ordinal) = 1) g ON i.inspection_id = g.image_id
       LEFT JOIN (SELECT * FROM comp_v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY length_cm DESC, ordinal) = 1) c ON i.inspection_id = c.image_id""",
)
def _(t):
    images = t.inspections_base.select(F.col("inspection_id").alias("image_id"))
    rows = component_rows(t)
    geo = masks.with_primary(images, masks.primary_detection(rows, "geometry"))
    cv = masks.primary_detection(rows, "cv").select("image_id", F.col("ordinal").alias("cv_ordinal"))
    return geo.join(cv, "image_id", "left").select(
        "image_id", "detected_count", F.coalesce("ordinal", F.lit(0)).alias("geo_ordinal"), F.col("length_cm").alias("geo_length_cm"), F.coalesce("cv_ordinal", F.lit(0)).alias("cv_ordinal")
    )


# Lines of bars in one region per building block: upright ones and others.
LINE = {
    "line_id": "CAST(line_no AS BIGINT) * 10000000000 + part_no * 100000 + supp_no * 1000 + CAST(inspection_id % 1000 AS INT)",
    "x1": "CAST(part_no % 640 AS INT)", "y1": "CAST(supp_no % 50 AS INT)",
    "x2": "CAST(part_no % 640 + line_no * 9 - 18 AS INT)", "y2": "CAST(supp_no % 50 + 90 AS INT)",
}


def lines(t, key: str):
    return t.defects.select(F.expr(f"{key}").alias("image_id"), *[F.expr(e).alias(n) for n, e in LINE.items()])


sql_view("line_v", "SELECT inspection_id, CAST(floor(inspection_id / 30) AS BIGINT) AS image_id, " + ", ".join(f"{e} AS {n}" for n, e in LINE.items()) + " FROM defects_v")
sql_view(
    "upright_v",
    """WITH RECURSIVE c AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id ORDER BY x) AS rn FROM (SELECT DISTINCT image_id, CAST(floor((x1 + x2) / 2.0) AS INT) AS x FROM line_v WHERE abs(x2 - x1) / 90.0 < 0.18) d),
       walk AS (SELECT image_id, x, rn, x AS kept, true AS take FROM c WHERE rn = 1
         UNION ALL SELECT c.image_id, c.x, c.rn, CASE WHEN c.x - w.kept > 30 THEN c.x ELSE w.kept END, c.x - w.kept > 30 FROM walk w JOIN c ON c.image_id = w.image_id AND c.rn = w.rn + 1)
       SELECT image_id, x FROM walk WHERE take""",
)


@query(
    "a25_bar_spacing",
    """SELECT i.image_id, round(coalesce(s.med, 0) * 0.15, 6) AS spacing_cm, CAST(coalesce(s.n, 0) AS INT) AS detected_rods FROM (SELECT DISTINCT image_id FROM line_v) i
       LEFT JOIN (SELECT image_id, median(gap) AS med, count(*) AS n FROM (SELECT image_id, x - lag(x) OVER (PARTITION BY image_id ORDER BY x) AS gap FROM upright_v) g GROUP BY 1 HAVING count(*) >= 2) s ON i.image_id = s.image_id""",
)
def _(t):
    return masks.bar_spacing(lines(t, "CAST(floor(inspection_id / 30) AS BIGINT)"), 0.15).withColumn("spacing_cm", F.round("spacing_cm", 6))


sql_view(
    "near_line_v",
    """SELECT *, CASE WHEN med > 45 THEN (x1 + x2) / 2e0 ELSE (y1 + y2) / 2e0 END AS pos FROM (SELECT *, median(a) OVER (PARTITION BY image_id) AS med FROM (
         SELECT *, ((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180 AS a FROM line_v) x) y WHERE abs(a - med) < 15""",
)


@query(
    "a26_parallel_bars",
    """SELECT image_id, count(*) AS bar_count, round(coalesce(avg(gap), 0) * 1.5, 5) AS spacing_mm, min((y1 + y2) / 2e0) * 1.5 AS cover_mm, least(1.0::DOUBLE, count(*) / 10e0) AS confidence FROM (
         SELECT *, sqrt(((x1 + x2) / 2e0 - lag((x1 + x2) / 2e0) OVER w) ** 2 + ((y1 + y2) / 2e0 - lag((y1 + y2) / 2e0) OVER w) ** 2) AS gap FROM near_line_v WINDOW w AS (PARTITION BY image_id ORDER BY pos, line_id)) g GROUP BY 1 HAVING count(*) >= 2""",
)
def _(t):
    return masks.parallel_bars(lines(t, "CAST(floor(inspection_id / 30) AS BIGINT)"), 1.5, by="image_id").withColumn("spacing_mm", F.round("spacing_mm", 5))


@query(
    "a31_contour_stats",
    """SELECT i.inspection_id AS image_id, coalesce(c.n, 0) AS spall_count, round(coalesce(m, 0), 5) AS mean_spall_area_px2, round(coalesce(x, 0), 5) AS max_spall_area_px2, coalesce(l.n, 0) AS crack_line_count, (i.inspection_id % 977) * 255e0 / 196608 AS edge_density
       FROM inspections_v i LEFT JOIN (SELECT inspection_id, count(*) AS n, avg(area_cm2 * 12.3456789e0) AS m, max(area_cm2 * 12.3456789e0) AS x FROM defects_v WHERE area_cm2 * 12.3456789e0 > 200 GROUP BY 1) c ON i.inspection_id = c.inspection_id
       LEFT JOIN (SELECT inspection_id, count(*) AS n FROM line_v GROUP BY 1) l ON i.inspection_id = l.inspection_id""",
)
def _(t):
    images = t.inspections_base.select(F.col("inspection_id").alias("image_id"), (F.col("inspection_id") % 977).alias("edge_px"), F.lit(IMAGE_W * IMAGE_H).alias("n_px"))
    contours = t.defects.select(F.col("inspection_id").alias("image_id"), (F.col("area_cm2") * 12.3456789).alias("area_px2"))
    return masks.contour_stats(images, contours, lines(t, "inspection_id")).withColumns(
        {c: F.round(c, 5) for c in ("mean_spall_area_px2", "max_spall_area_px2")}
    )


_GREY = "CAST((x * 37 + y * 91 + mask_id * 13 + x * y * 5) % 256 AS INT)"
sql_view("grey_v", f"SELECT *, {_GREY} // 8 AS level FROM pixels_v")


@query(
    "m5_cooccurrence",
    """SELECT mask_id, CAST(angle AS INT) AS angle, round(sum(p * (i - j) ** 2), 6) AS contrast, round(sum(p / (1 + (i - j) ** 2)), 6) AS homogeneity, round(sqrt(sum(p * p)), 6) AS energy,
         round(CASE WHEN sum(p * i * i) - sum(p * i) ** 2 < 1e-12 THEN 1 ELSE (sum(p * i * j) - sum(p * i) * sum(p * j)) / sqrt((sum(p * i * i) - sum(p * i) ** 2) * (sum(p * j * j) - sum(p * j) ** 2)) END, 6) AS correlation
       FROM (SELECT mask_id, angle, i, j, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY mask_id, angle) AS p FROM (
         SELECT mask_id, angle, unnest([li, lj]) AS i, unnest([lj, li]) AS j FROM (
           SELECT a.mask_id, o.angle, a.level AS li, b.level AS lj FROM grey_v a, (VALUES (0, 1, 0), (45, 1, 1), (90, 0, 1), (135, -1, 1)) AS o(angle, dx, dy), grey_v b
           WHERE b.mask_id = a.mask_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy) q) u GROUP BY 1, 2, 3, 4) g GROUP BY 1, 2""",
)
def _(t):
    out = masks.cooccurrence(t.pixels.withColumn("grey", F.expr(_GREY)))
    return out.select("mask_id", "angle", *[F.round(c, 6).alias(c) for c in ("contrast", "correlation", "homogeneity", "energy")])


_CONTOUR = {
    "contour_area": "min(area_cm2) * 1e1", "perimeter_px": "max(length_cm) * 8e0", "hull_area": "max(area_cm2) * 1.1e1", "major_px": "max(bbox_w) * 1e0", "minor_px": "min(bbox_h) * 1e0",
    "n_points": "CAST(count(*) AS INT)",
}


@query(
    "m7_shape_vector",
    """SELECT mask_id, round(CASE WHEN k >= 3 THEN greatest(a, b) / least(a, b) ELSE 1 END, 6) AS elongation, round(CASE WHEN k >= 3 THEN ar / hull ELSE 1 END, 6) AS solidity,
         round(CASE WHEN k >= 3 THEN least(1, greatest(0, 4 * pi() * ar / (per * per))) ELSE 1 END, 6) AS circularity,
         round(CASE WHEN k >= 3 THEN -sign(e20 + e02) * log10(abs(e20 + e02)) ELSE 0 END, 5) AS hu1 FROM (
           SELECT p.mask_id, (sum((x - cx) ** 2)) / (count(*) * count(*)) AS e20, (sum((y - cy) ** 2)) / (count(*) * count(*)) AS e02, any_value(c.k) AS k, any_value(c.a) AS a, any_value(c.b) AS b, any_value(c.ar) AS ar, any_value(c.hull) AS hull, any_value(c.per) AS per
           FROM run_px_v p JOIN moment_v m ON p.mask_id = m.mask_id JOIN (SELECT inspection_id, count(*) AS k, max(bbox_w) * 1e0 AS a, min(bbox_h) * 1e0 AS b, min(area_cm2) * 1e1 AS ar, max(area_cm2) * 1.1e1 AS hull, max(length_cm) * 8e0 AS per FROM defects_v GROUP BY 1) c
             ON p.mask_id = c.inspection_id GROUP BY 1) s""",
)
def _(t):
    contours = t.defects.groupBy(F.col("inspection_id").alias("mask_id")).agg(*[F.expr(e).alias(n) for n, e in _CONTOUR.items()])
    out = masks.shape_vector(t.runs, contours)
    return out.select("mask_id", *[F.round(c, 6).alias(c) for c in ("elongation", "solidity", "circularity")], F.round("hu1", 5).alias("hu1"))


@query(
    "m8_patch_bounds",
    """SELECT defect_id, greatest(0, x1) AS ix1, greatest(0, y1) AS iy1, least(512, x1 + 96) AS ix2, least(384, y1 + 96) AS iy2, greatest(0, -x1) AS px1, greatest(0, -y1) AS py1, 96 - greatest(0, x1 + 96 - 512) AS px2, 96 - greatest(0, y1 + 96 - 384) AS py2
       FROM (SELECT defect_id, centroid_x - 48 AS x1, centroid_y - 48 AS y1 FROM defects_v) d""",
)
def _(t):
    return t.defects.select("defect_id", g.patch_bounds("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("b")).select("defect_id", "b.*")


def text_frames(t, width: int = 32):
    """Each document's bytes as a grey frame of fixed width; the last row is filled with blanks."""
    raw = F.col("text").cast("binary")
    height = F.greatest(F.ceil(F.octet_length(raw) / width), F.lit(1)).cast("int")
    return t.raw("documents").select(F.col("doc_id").alias("frame_id"), height.alias("height"), F.lit(width).alias("width"), F.rpad(raw, height * width, F.lit(b" ")).alias("pixels"))


sql_view(
    "grey_px_v",
    """SELECT doc_id, CAST(i // 32 AS INT) AS y, CAST(i % 32 AS INT) AS x, CAST(('0x' || b)::INT AS DOUBLE) AS v
       FROM (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, unnest(range(CAST(len(h) // 2 AS BIGINT))) AS i
             FROM (SELECT doc_id, rpad(hex(encode(text)), CAST(greatest(ceil(octet_length(encode(text)) / 32.0), 1) * 64 AS INT), '20') AS h FROM documents) d) p""",
)


@query(
    "m1_frame_quality",
    """SELECT doc_id AS frame_id, round(sqrt(var_pop(l)), 5) AS laplacian_deviation, round(avg(v), 6) AS mean_intensity FROM (
         SELECT doc_id, v, coalesce(w, e) + coalesce(e, w) + coalesce(n, s, v) + coalesce(s, n, v) - 4 * v AS l FROM (
           SELECT doc_id, v, lag(v) OVER r AS w, lead(v) OVER r AS e, lag(v) OVER c AS n, lead(v) OVER c AS s FROM grey_px_v
           WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y)) a) b GROUP BY 1""",
)
def _(t):
    out = kernels.frame_quality(text_frames(t))
    return out.select("frame_id", F.round(F.sqrt("laplacian_variance"), 5).alias("laplacian_deviation"), F.round("mean_intensity", 6).alias("mean_intensity"))


@query("m4_colour_cues")
def _(t):
    """The same frames read as triples: a third of the width, three channels."""
    return kernels.colour_cues(text_frames(t, 33).withColumn("width", F.lit(11)))


@query(
    "m6_gradient_stats",
    """SELECT doc_id AS frame_id, round(avg(sqrt(gx * gx + gy * gy)), 5) AS sobel_gradient_mean FROM (
         SELECT doc_id, coalesce(lag(d) OVER c, lead(d) OVER c, d) + 2 * d + coalesce(lead(d) OVER c, lag(d) OVER c, d) AS gx, coalesce(lead(h) OVER c - lag(h) OVER c, 0) AS gy FROM (
           SELECT doc_id, y, x, coalesce(e - w, 0) AS d, coalesce(w, e) + 2 * v + coalesce(e, w) AS h FROM (
             SELECT *, lag(v) OVER r AS w, lead(v) OVER r AS e FROM grey_px_v WINDOW r AS (PARTITION BY doc_id, y ORDER BY x)) a) b
         WINDOW c AS (PARTITION BY doc_id, x ORDER BY y)) g GROUP BY 1""",
)
def _(t):
    return kernels.gradient_stats(text_frames(t)).select("frame_id", F.round("sobel_gradient_mean", 5).alias("sobel_gradient_mean"))


@query("m8_crop_patches")
def _(t):
    frames = text_frames(t)
    boxed = frames.withColumn("bounds", g.patch_bounds(F.lit(16), F.expr("height div 2"), F.col("width"), F.col("height"), 24))
    return kernels.crop_patches(boxed, 24).select("frame_id", F.sha2("patch", 256).alias("patch_hash"))


# Reachability over touching runs; a mask of the test tables has few runs.
sql_view("run_id_v", "SELECT *, row_number() OVER (ORDER BY mask_id, y, x0) AS id FROM runs_v")
sql_view(
    "touch_v",
    "SELECT a.id AS a, b.id AS b FROM run_id_v a JOIN run_id_v b ON a.mask_id = b.mask_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.id <> b.id AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1",
)
sql_view("reach_v", "WITH RECURSIVE w(a, b) AS (SELECT id, id FROM run_id_v UNION SELECT w.a, t.b FROM w JOIN touch_v t ON w.b = t.a) SELECT a, min(b) AS root FROM w GROUP BY a")


@query(
    "m3_components",
    """SELECT mask_id, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area_px, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h,
         round(sum((x1 - x0 + 1) * (x0 + x1) / 2) / sum(x1 - x0 + 1), 6) AS cx, round(sum((x1 - x0 + 1) * y * 1e0) / sum(x1 - x0 + 1), 6) AS cy
       FROM run_id_v r JOIN reach_v q ON r.id = q.a GROUP BY mask_id, root HAVING sum(x1 - x0 + 1) >= 15""",
)
def _(t):
    return components.components(t.runs, min_area=15, tile=64).select("mask_id", "area_px", "x", "y", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def detections(t, parity: int):
    return t.defects.where(F.col("supp_no") % 2 == parity).select(
        F.col("inspection_id").alias("image_id"), F.expr("CAST(line_no * 10000000 + part_no * 1000 + supp_no AS INT)").alias("ordinal"), F.col("centroid_x").alias("cx"), F.col("centroid_y").alias("cy"),
        "length_cm", "width_mm", (F.col("part_no") % 91).cast("double").alias("angle_deg"), (F.lit(1.0) + (F.col("supp_no") % 7) / 10.0).alias("tortuosity"), F.lit("crack").alias("kind"),
        F.lit(IMAGE_W).alias("img_w"), F.lit(IMAGE_H).alias("img_h"),
    )


@query("j3_pair_detectors")
def _(t):
    return kernels.pair_detectors(detections(t, 0), detections(t, 1))


@query("k8_top_pairs")
def _(t):
    return kernels.pair_detectors(detections(t, 0), detections(t, 1), limit=12).where("matched")
