"""Every named query of the subpackage: against its SQL where it has one, else that it runs over whole tables."""

import pytest

import __spark_entry__ as entry
from facadelake.llm.queries import ORACLES, QUERIES
from tests.test_catalogue import ROOT, con, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):  # noqa: F811
    df = entry.queries()[name](spark, ROOT)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole(spark, name):
    found = entry.queries()[name](spark, ROOT).count()
    if name.startswith("op11"):  # a row per node: the root and at least one more
        assert found > 1
        return
    table = "pages" if name.startswith("op4") else "conversations" if name.startswith("op12") else "documents"
    rows = spark.read.parquet(f"{ROOT}/{table}.parquet")
    assert found == (rows.select("conv_id").distinct() if table == "conversations" else rows).count()
