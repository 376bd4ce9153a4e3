"""Queries of windows, numbering and flight statistics (W*, A8-A10, J10-J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.operators import admission, gates, hotkeys, numbering
from facadelake.plans.q_geometry import with_gsd
from facadelake.plans.registry import query, sql_view


@query(
    "w1_altitude_anomaly",
    """SELECT f.frame_id, n >= 3 AND sd > 0 AND coalesce(abs(alt - med) > 2 * sd, false) AS altitude_anomaly
       FROM (SELECT f.frame_id, f.flight_id, CASE WHEN r.has THEN relative_altitude ELSE gps_altitude END AS alt FROM frames_v f
             JOIN (SELECT flight_id, bool_or(relative_altitude IS NOT NULL) AS has FROM frames_v GROUP BY 1) r ON f.flight_id = r.flight_id) f
       JOIN (SELECT flight_id, count(relative_altitude) AS n, stddev_samp(relative_altitude) AS sd, median(relative_altitude) AS med FROM frames_v GROUP BY 1) s ON f.flight_id = s.flight_id""",
)
def _(t):
    return gates.altitude_anomaly(t.frames).select("frame_id", "altitude_anomaly")


sql_view("gap_v", "SELECT frame_id, flight_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY flight_id ORDER BY ts, frame_id), ts) / 1e6 AS gap FROM frames_v")


@query(
    "w2_temporal_gap",
    """SELECT g.frame_id, coalesce(n >= 3 AND med > 0 AND gap > 3 * med, false) AS temporal_gap FROM gap_v g
       JOIN (SELECT flight_id, count(*) AS n, median(gap) AS med FROM gap_v GROUP BY 1) s ON g.flight_id = s.flight_id""",
)
def _(t):
    return gates.temporal_gap(t.frames, bucket_seconds=86400).select("frame_id", "temporal_gap")


@query(
    "w6_sliding_admission",
    """SELECT client_id, earlier, earlier < 2 AS admitted, count(*) AS n FROM (
         SELECT client_id, count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND 1 PRECEDING) AS earlier
         FROM (SELECT DISTINCT client_id, epoch_us(ts) AS us FROM requests_v) d) x GROUP BY 1, 2, 3""",
)
def _(t):
    out = admission.sliding_admission(t.requests, limit=2, window_s=36_000)
    return out.groupBy("client_id", "earlier", "admitted").agg(F.count(F.lit(1)).alias("n"))


sql_view(
    "bucket_v",
    """WITH RECURSIVE ordered AS (SELECT client_id, request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, request_id) AS rn FROM requests_v),
       step AS (
         SELECT client_id, request_id, rn, us, true AS ok, CAST(2 AS DOUBLE) AS tokens FROM ordered WHERE rn = 1
         UNION ALL
         SELECT o.client_id, o.request_id, o.rn, o.us, avail >= 1, CASE WHEN avail >= 1 THEN avail - 1 ELSE avail END
         FROM (SELECT o.*, least(s.tokens + (o.us - s.us) / 1e6 * 0.00004::DOUBLE, 3) AS avail FROM step s JOIN ordered o ON o.client_id = s.client_id AND o.rn = s.rn + 1) o)
       SELECT client_id, request_id, ok, tokens FROM step""",
)


@query("t2_token_bucket", "SELECT client_id, request_id, ok AS admitted, round(tokens, 6) AS tokens_left FROM bucket_v")
def _(t):
    out = admission.token_bucket(t.requests, cap=3.0, rate=0.00004, bucket_seconds=86400)
    return out.withColumn("tokens_left", F.round("tokens_left", 6))


@query("w4_run_ends", "SELECT defect_id AS mask_id, CAST(pos AS INT) AS pos, CAST(end_px AS BIGINT) AS end_px FROM (SELECT defect_id, pos, sum(n) OVER (PARTITION BY defect_id ORDER BY pos) AS end_px FROM rle_v) x")
def _(t):
    from facadelake.operators import masks
    from facadelake.plans.q_masks import rle_masks

    return masks.run_ends(rle_masks(t)).select("mask_id", "pos", "end_px")


@query("w5_latest_per_key", "SELECT building_id, arg_max(inspection_id, (inspection_date, inspection_id)) AS inspection_id, max(inspection_date) AS inspection_date FROM inspections_v GROUP BY 1")
def _(t):
    return hotkeys.latest(t.inspections_base, ["building_id"], ["inspection_date", "inspection_id"]).select("building_id", "inspection_id", "inspection_date")


@query(
    "w7_defect_numbers",
    """SELECT defect_id, 'DEFECT-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS number_a,
         building_id || '_C' || cycle_id || '_' || lpad(CAST(i AS VARCHAR), 4, '0') AS number_b
       FROM (SELECT d.*, row_number() OVER (PARTITION BY d.inspection_id ORDER BY line_no, part_no, supp_no, price) AS rn FROM
              (SELECT c.*, row_number() OVER (PARTITION BY c.inspection_id ORDER BY line_no, part_no, supp_no, price) - 1 AS i FROM cbox_v c) d WHERE confidence >= 0.5) x""",
)
def _(t):
    order = ["line_no", "part_no", "supp_no", "price"]
    heads = t.inspections.select("inspection_id", "building_id", "cycle_id")
    detected = hotkeys.ranked(t.defects, ["inspection_id"], order, F.col("line_no"), "rn").withColumn("ordinal", F.col("rn") - 1).join(heads, "inspection_id")
    kept = numbering.number_flat(detected, "building_id", "cycle_id", "ordinal", "number_b").where("confidence >= 0.5")
    return numbering.number_phased(kept, "inspection_id", order, F.col("line_no"), "number_a").select("defect_id", "number_a", "number_b")


# --- flights on the map ---------------------------------------------------------------------------


@query(
    "a8_flight_gsd",
    """SELECT flight_id, count(gsd) AS count, round(median(gsd), 8) AS median_cm_per_px, round(avg(gsd), 8) AS mean_cm_per_px, round(stddev_pop(gsd), 8) AS std_cm_per_px,
         round(min(gsd), 8) AS min_cm_per_px, round(max(gsd), 8) AS max_cm_per_px FROM gsd_v WHERE gsd IS NOT NULL GROUP BY 1""",
)
def _(t):
    from facadelake.operators import georef

    out = georef.flight_gsd(with_gsd(t.frames))
    return out.select("flight_id", "count", *[F.round(c, 8).alias(c) for c in out.columns if c.endswith("_px")])


@query("a10_gps_centroid", "SELECT flight_id, round(avg(gps_latitude), 9) AS latitude, round(avg(gps_longitude), 9) AS longitude FROM frames_v GROUP BY 1")
def _(t):
    from facadelake.operators import georef

    return georef.gps_centroid(t.frames).withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


MOSAIC = "CAST(1500 + flight_id % 7 * 500 AS INT) AS mosaic_w, CAST(1000 + flight_id % 5 * 400 AS INT) AS mosaic_h"


def mosaics(t):
    return t.frames.select("flight_id").distinct().selectExpr("flight_id", MOSAIC.split(", ")[0], MOSAIC.split(", ")[1])


sql_view("mosaic_v", f"SELECT DISTINCT flight_id, {MOSAIC} FROM frames_v")


@query(
    "j11_grid_points",
    "SELECT flight_id, CAST(x * 500 AS INT) AS pixel_x, CAST(y * 500 AS INT) AS pixel_y FROM mosaic_v, (SELECT unnest(range(40)) AS x) a, (SELECT unnest(range(40)) AS y) b WHERE x * 500 < mosaic_w AND y * 500 < mosaic_h",
)
def _(t):
    from facadelake.operators import georef

    return georef.grid_points(mosaics(t))


_H = "[1.02, 0.01, (frame_id % 50) * 10.0, 0.015, 0.98, (frame_id % 30) * 7.0, 0.00001, 0.00002, 1.0]"


def homographies(t):
    i = F.col("frame_id")
    h = F.array(F.lit(1.02), F.lit(0.01), (i % 50) * 10.0, F.lit(0.015), F.lit(0.98), (i % 30) * 7.0, F.lit(1e-5), F.lit(2e-5), F.lit(1.0))
    return t.frames.where(i % 3 == 0).select("frame_id", h.alias("h"))


sql_view(
    "control_v",
    """SELECT f.frame_id, f.flight_id, rn, gps_latitude, gps_longitude,
         CASE WHEN f.frame_id % 3 = 0 THEN (1.02::DOUBLE * 320 + 0.01::DOUBLE * 240 + (f.frame_id % 50) * 10.0) / w ELSE (rn / greatest(n - 1, 1)) * mosaic_w END AS pixel_x,
         CASE WHEN f.frame_id % 3 = 0 THEN (0.015::DOUBLE * 320 + 0.98::DOUBLE * 240 + (f.frame_id % 30) * 7.0) / w ELSE mosaic_h / 2 END AS pixel_y
       FROM (SELECT *, 1e-5 * 320 + 2e-5 * 240 + 1e0 AS w, CAST(row_number() OVER (PARTITION BY flight_id ORDER BY ts, frame_id) - 1 AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY flight_id) AS DOUBLE) AS n FROM frames_v) f
       JOIN mosaic_v m ON f.flight_id = m.flight_id WHERE gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL""",
)


def controls(t):
    from facadelake.operators import georef

    frames = t.frames.withColumns({"image_width_px": F.lit(640), "image_height_px": F.lit(480)})
    return georef.control_points(frames, mosaics(t), homographies(t), bucket=hotkeys.time_bucket("ts", 86400))


@query("j12_control_points", "SELECT frame_id, round(pixel_x, 6) AS pixel_x, round(pixel_y, 6) AS pixel_y, gps_latitude, gps_longitude FROM control_v")
def _(t):
    return controls(t).select("frame_id", F.round("pixel_x", 6).alias("pixel_x"), F.round("pixel_y", 6).alias("pixel_y"), "gps_latitude", "gps_longitude")


sql_view(
    "idw_v",
    """SELECT g.flight_id, g.pixel_x, g.pixel_y, CASE WHEN min(d) < 1 THEN arg_min(lat, (d, rn)) ELSE sum(lat / (d * d)) / sum(1 / (d * d)) END AS lat,
         CASE WHEN min(d) < 1 THEN arg_min(lon, (d, rn)) ELSE sum(lon / (d * d)) / sum(1 / (d * d)) END AS lon
       FROM (SELECT flight_id, x * 500 AS pixel_x, y * 500 AS pixel_y FROM mosaic_v, (SELECT unnest(range(40)) AS x) a, (SELECT unnest(range(40)) AS y) b WHERE x * 500 < mosaic_w AND y * 500 < mosaic_h) g
       JOIN (SELECT flight_id, rn, gps_latitude AS lat, gps_longitude AS lon, pixel_x AS px, pixel_y AS py, count(*) OVER (PARTITION BY flight_id) AS n FROM control_v) c ON g.flight_id = c.flight_id AND c.n >= 2,
       LATERAL (SELECT greatest(sqrt((c.px - g.pixel_x) ** 2 + (c.py - g.pixel_y) ** 2), 1e-9) AS d) z
       GROUP BY 1, 2, 3""",
)


@query("j10_idw_grid", "SELECT flight_id, CAST(pixel_x AS INT) AS pixel_x, CAST(pixel_y AS INT) AS pixel_y, round(lat, 7) AS gps_latitude, round(lon, 7) AS gps_longitude FROM idw_v")
def _(t):
    from facadelake.operators import georef

    out = georef.idw(georef.grid_points(mosaics(t)), controls(t))
    return out.select("flight_id", "pixel_x", "pixel_y", F.round("gps_latitude", 7).alias("gps_latitude"), F.round("gps_longitude", 7).alias("gps_longitude"))


@query(
    "a9_gps_rmse",
    """SELECT flight_id, round(sqrt(avg(e)), 3) AS rmse_m, sqrt(avg(e)) < 0.5 AS passed FROM (
         SELECT flight_id, ((lat - tlat) * 111320) ** 2 + ((lon - tlon) * 111320 * cos(radians(tlat))) ** 2 AS e
         FROM (SELECT *, 22.001 + pixel_x * 1e-6 AS tlat, 87.002 + pixel_y * 1e-6 AS tlon FROM idw_v) x) y GROUP BY 1""",
)
def _(t):
    from facadelake.operators import georef

    predicted = georef.idw(georef.grid_points(mosaics(t)), controls(t))
    truth = georef.grid_points(mosaics(t)).select(
        "flight_id", "pixel_x", "pixel_y", (F.lit(22.001) + F.col("pixel_x") * 1e-6).alias("true_latitude"), (F.lit(87.002) + F.col("pixel_y") * 1e-6).alias("true_longitude")
    )
    return georef.gps_rmse(predicted, truth).withColumn("rmse_m", F.round("rmse_m", 3))
