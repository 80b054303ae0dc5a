import pytest
from pyspark.sql import functions as F

from cadenza.functions.scalars import clamp_ratio
from cadenza.operators import export


def test_rows_take_the_form_of_a_schema(spark):
    rows = spark.createDataFrame([("7", 1.5, "x")], "b string, a double, more string")
    want = spark.createDataFrame([], "a int, b bigint, c string").schema
    got = export.coerced(rows, want)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want]
    assert [tuple(r) for r in got.collect()] == [(1, 7, None)]


def test_a_broken_rule_stops_the_export(spark):
    checks = spark.createDataFrame([("labels", 0), ("positions", 2)], "check string, n long")
    export.assert_valid(checks.where("n = 0"))
    with pytest.raises(ValueError, match="positions"):
        export.assert_valid(checks)


def test_play_ratio_stays_below_one(spark):
    rows = spark.createDataFrame([(30.0, 60.0), (70.0, 60.0), (-1.0, 60.0), (5.0, 0.0)], "elapsed double, duration double")
    got = rows.select(clamp_ratio(F.col("elapsed"), F.col("duration"))).collect()
    assert [r[0] for r in got][:3] == [0.5, 0.99, 0.0]
