"""Deep pages against a plain sort."""

import math

import pytest
from pyspark.sql import functions as F

from facadelake.operators import listing


@pytest.fixture(scope="module")
def defects(spark):
    # A third of the rows share one area, some have none, and the largest values are not finite.
    area = F.expr("CASE WHEN id % 3 = 0 THEN 42.5D WHEN id % 41 = 0 THEN NULL WHEN id = 7 THEN double('NaN') WHEN id = 8 THEN double('Infinity') ELSE (id * 7919 % 5003 - 800) / 3D END")
    return spark.range(3000).select(F.format_string("d%05d", "id").alias("defect_id"), area.alias("area_px2"))


def test_deep_pages(spark, defects):
    def place(row):
        a = row.area_px2
        return (2, 0.0) if a is None else (0, 0.0) if math.isnan(a) else (1, -a)

    want = [r.defect_id for r in sorted(defects.collect(), key=lambda r: (*place(r), r.defect_id))]
    for page in (1, 8, 15, 16):
        got, totals = listing.page_defects(defects, "area", page=page, size=200, shallow=0)
        assert [r.defect_id for r in got.collect()] == want[(page - 1) * 200 : page * 200]
        assert got.columns == defects.columns
    assert totals.first().total == 3000


def test_no_rows(spark, defects):
    assert listing.page_defects(defects.limit(0), "area", page=3, shallow=0)[0].collect() == []
