"""Inspection-domain tables over the star-schema parquet files.

The mappings are SQL text that both Spark and the checking engine accept; column meaning is
invented, only shape and skew matter. Sources are passed by name, so no catalogue view is made.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facadelake.operators.hotkeys import ranked

DEFECTS = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 1e2) AS BIGINT)) AS defect_id,
       l_orderkey AS inspection_id, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no, l_extendedprice AS price,
       CASE l_partkey % 8 WHEN 0 THEN 'crack' WHEN 1 THEN 'spalling' WHEN 2 THEN 'corrosion' WHEN 3 THEN 'water_seepage'
            WHEN 4 THEN 'efflorescence' WHEN 5 THEN 'shear_crack' WHEN 6 THEN 'compression_crack' ELSE 'stain' END AS type,
       CASE l_partkey % 3 WHEN 0 THEN 'hairline' WHEN 1 THEN 'moderate' ELSE 'severe' END AS severity_b,
       ((l_partkey * 37 + l_suppkey * 11) % 799) / 1e2 AS width_mm,
       l_quantity AS length_cm, l_extendedprice / 1e3 AS area_cm2,
       CAST((l_partkey * 131 + l_linenumber * 17) % 512 AS INT) AS centroid_x,
       CAST((l_suppkey * 57 + l_linenumber * 29) % 384 AS INT) AS centroid_y,
       CAST(80 + l_partkey % 60 AS INT) AS bbox_w, CAST(80 + l_suppkey % 60 AS INT) AS bbox_h,
       1e0 - l_discount * 6e0 AS confidence, l_tax * 1e1 AS fp_prob, l_tax >= 7e-2 AS is_false_positive,
       CASE l_suppkey % 7 WHEN 0 THEN 'column' WHEN 1 THEN 'beam' WHEN 2 THEN 'slab' WHEN 3 THEN 'wall_structural'
            WHEN 4 THEN 'wall_partition' WHEN 5 THEN 'unknown' END AS member_type,
       CASE l_linenumber WHEN 1 THEN 'shear' WHEN 2 THEN 'corrosion_induced' WHEN 3 THEN 'settlement' WHEN 4 THEN 'flexural'
            WHEN 5 THEN 'shrinkage_crazing' WHEN 6 THEN 'unknown' END AS crack_subtype,
       CASE l_returnflag WHEN 'R' THEN 'coastal' WHEN 'A' THEN 'severe' ELSE 'normal' END AS exposure_condition
FROM {lineitem}
"""

# Everything of an inspection but its cycle number, which is a rank per building.
INSPECTIONS_BASE = """
SELECT o.o_orderkey AS inspection_id, o.o_custkey AS building_id, c.c_nationkey AS org_id,
       CAST(o.o_orderdate AS DATE) AS inspection_date,
       CASE o.o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'W' END AS orientation,
       o.o_totalprice * 1e1 AS facade_area_cm2
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

FRAMES = """
SELECT event_id AS frame_id, user_id AS flight_id, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE 15e0 + (event_id % 7) * 5e-1 + CASE WHEN value > 1e2 THEN 2e1 ELSE 0e0 END END AS relative_altitude,
       60e0 + (event_id % 5) AS gps_altitude,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 22e0 + (event_id % 97) * 1e-4 END AS gps_latitude,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 87e0 + (event_id % 89) * 1e-4 END AS gps_longitude,
       CASE event_type WHEN 'click' THEN 'dji_phantom_4_pro' WHEN 'view' THEN 'dji_mavic_3' WHEN 'error' THEN 'custom'
            WHEN 'signup' THEN 'dji_air_2s' ELSE 'not_a_profile' END AS camera_profile,
       CASE WHEN event_id % 4 = 0 THEN 10e0 END AS focal_length_mm,
       value AS laplacian_variance, CAST((event_id * 31) % 256 AS DOUBLE) AS mean_intensity
FROM {events}
"""

REQUESTS = """
SELECT event_id AS request_id, user_id AS client_id, ts, event_type AS endpoint, value AS latency_ms, props AS meta_json
FROM {events}
"""

# One run per mask row, so that moments over runs equal moments over pixels.
RUNS = """
SELECT mask_id, y, x0, x0 + CAST(n AS INT) - 1 AS x1 FROM (
  SELECT l_orderkey AS mask_id, CAST(l_partkey % 40 AS INT) AS y, CAST(l_suppkey % 50 AS INT) AS x0, l_quantity AS n,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey % 40
                            ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM {lineitem}) t
WHERE rn = 1
"""

PIXELS = """
SELECT DISTINCT CAST(floor(l_orderkey / 150) AS INT) AS mask_id, CAST(l_partkey % 32 AS INT) AS x,
       CAST((l_suppkey * 7 + l_linenumber) % 32 AS INT) AS y
FROM {lineitem}
"""

NAMES = """
SELECT p_partkey AS image_id,
       concat(p_name, ' ', CASE p_size % 10 WHEN 0 THEN 'Shear' WHEN 1 THEN 'stage 3' WHEN 2 THEN 'leakage joint' WHEN 3 THEN 'column'
              WHEN 4 THEN 'beam plaster' WHEN 5 THEN 'Salt' WHEN 6 THEN 'nonstructural' WHEN 7 THEN 'fire' ELSE 'plain' END, '.jpg') AS filename,
       (p_partkey % 250) / 1e2 AS width_mm, (p_partkey % 91) * 1e0 AS angle_deg,
       (p_size % 12) / 1e2 AS rust, (p_size % 25) / 1e2 AS efflorescence
FROM {part}
"""

FEATURES = "SELECT vec_id, embedding, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM {embeddings}"
SCORES = "SELECT doc_id, quality AS y, ((doc_id * 7919) % 1000) / 1e3 AS p FROM {labels}"

IMAGE_W, IMAGE_H = 512, 384


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in names})

    @cached_property
    def defects(self) -> DataFrame:
        return self._sql(DEFECTS, "lineitem")

    def spread_defects(self) -> DataFrame:
        """Defects dealt evenly over the cluster, for costly work on each row: a small file with one row group is one task."""
        return self.spark.sql(DEFECTS, lineitem=self.raw("lineitem").repartition(self.parts()))

    def dealt_defects(self) -> DataFrame:
        """Defects dealt by inspection; the shuffle holds the plain columns only."""
        return self.spark.sql(DEFECTS, lineitem=self.raw("lineitem").where("l_orderkey IS NOT NULL").repartition("l_orderkey"))

    def parts(self) -> int:
        """Partitions for work that bytes say little about."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.spark.sparkContext.defaultParallelism)

    @cached_property
    def boxes(self) -> DataFrame:
        """Defects with the top-left corner of their box."""
        return self._boxed(self.defects)

    @staticmethod
    def _boxed(defects: DataFrame) -> DataFrame:
        return defects.withColumns(
            {"bbox_x": F.expr("CAST(centroid_x - bbox_w div 2 AS INT)"), "bbox_y": F.expr("CAST(centroid_y - bbox_h div 2 AS INT)")}
        )

    def defects_of(self, heads: DataFrame) -> DataFrame:
        """``boxes`` joined with ``heads`` on ``inspection_id``. What a defect derives is worked out after the join, so the
        shuffle holds the plain columns only."""
        extra = [c for c in heads.columns if c != "inspection_id"]
        raw = self.raw("lineitem").join(heads.withColumnRenamed("inspection_id", "l_orderkey"), "l_orderkey")
        text = DEFECTS.replace("\nFROM {lineitem}", "".join(f", {c}" for c in extra) + "\nFROM {lineitem}")
        return self._boxed(self.spark.sql(text, lineitem=raw))

    @cached_property
    def inspections(self) -> DataFrame:
        base = self._sql(INSPECTIONS_BASE, "orders", "customer")
        month = F.year("inspection_date") * 12 + F.month("inspection_date")
        return ranked(base, ["building_id"], ["inspection_date", "inspection_id"], month, "cycle_id").withColumn(
            "cycle_id", F.col("cycle_id").cast("int")
        )

    @cached_property
    def inspections_base(self) -> DataFrame:
        """Inspections without the cycle number: no shuffle for the plans that do not use it."""
        return self._sql(INSPECTIONS_BASE, "orders", "customer")

    @cached_property
    def frames(self) -> DataFrame:
        return self._sql(FRAMES, "events")

    @cached_property
    def requests(self) -> DataFrame:
        return self._sql(REQUESTS, "events")

    @cached_property
    def runs(self) -> DataFrame:
        """RUNS with the first row per mask row taken by an aggregate, combined before the shuffle."""
        first = F.min_by(
            F.struct((F.col("l_suppkey") % 50).cast("int").alias("x0"), F.col("l_quantity").cast("int").alias("n")),
            F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"),
        )
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("mask_id"), (F.col("l_partkey") % 40).cast("int").alias("y"))
            .agg(first.alias("r"))
            .select("mask_id", "y", F.col("r.x0").alias("x0"), (F.col("r.x0") + F.col("r.n") - 1).alias("x1"))
        )

    @cached_property
    def pixels(self) -> DataFrame:
        return self._sql(PIXELS, "lineitem")

    @cached_property
    def names(self) -> DataFrame:
        return self._sql(NAMES, "part")

    @cached_property
    def features(self) -> DataFrame:
        return self._sql(FEATURES, "embeddings")

    @cached_property
    def scores(self) -> DataFrame:
        return self._sql(SCORES, "labels")


def _plain(text: str) -> str:
    names = ["lineitem", "orders", "customer", "events", "part", "embeddings", "labels"]
    return text.format(**{n: n for n in names})


# The same tables for the checking engine, as named subqueries.
ORACLE_VIEWS = {
    "defects_v": _plain(DEFECTS),
    "inspections_v": f"""
SELECT *, CAST(row_number() OVER (PARTITION BY building_id ORDER BY inspection_date, inspection_id) AS INT) AS cycle_id
FROM ({_plain(INSPECTIONS_BASE)}) b""",
    "boxes_v": "SELECT *, CAST(centroid_x - bbox_w // 2 AS INT) AS bbox_x, CAST(centroid_y - bbox_h // 2 AS INT) AS bbox_y FROM defects_v",
    "frames_v": _plain(FRAMES),
    "requests_v": _plain(REQUESTS),
    "runs_v": _plain(RUNS),
    "pixels_v": _plain(PIXELS),
    "names_v": _plain(NAMES),
    "features_v": _plain(FEATURES),
    "scores_v": _plain(SCORES),
}
