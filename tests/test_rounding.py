"""Rounding as SQL does it: the sign of zero counts where vectors are compared as a whole."""

import math

from pyspark.sql import functions as F

from cadenza.functions.scalars import rounded
from cadenza.plans import features, files


def test_negative_values_round_to_negative_zero(spark):
    frame = spark.createDataFrame([(v,) for v in (-4e-7, 4e-7, -0.5, 1.2345675, -1.2345675, 0.0)], "x double")
    got = [r.y for r in frame.select(rounded(F.col("x"), 6).alias("y")).collect()]
    assert got == [0.0, 0.0, -0.5, 1.234568, -1.234568, 0.0]
    assert [math.copysign(1, y) for y in got] == [-1, 1, -1, 1, -1, 1]


def test_mean_vectors_keep_the_sign_of_zero(spark, monkeypatch):
    means = spark.createDataFrame([(1, 2, 0, -4e-7), (1, 2, 1, 0.5)], "user_id long, size long, dim int, value double")
    monkeypatch.setattr(features.f, "mean_centroids", lambda *_: means)
    row = files.centroid_or_zero(spark, "/root/testdata/sf0.001").where("user_id = 1").first()
    assert row.known and [str(x) for x in row.vector] == ["-0.0", "0.5"]


def test_centroids_keep_the_sign_of_zero(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 0, [-4e-6, 4e-6, 0.123456], 2)], "user_id long, centroid_idx int, centroid array<double>, cluster_size long")
    monkeypatch.setattr(features, "centroids", lambda *_: frame)
    row = features.user_centroids_kmeans(spark, "").first()
    assert [str(x) for x in row.centroid] == ["-0.0", "0.0", "0.12346"]
