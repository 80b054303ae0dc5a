"""Canonical tables of a listening service, as views over the sample star schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import play_label
from cadenza.sources.shared import deal_by_size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    deal_by_size(spark, f"{sf_dir}/{name}.parquet")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback events: open ones (no ratio) and finalized ones."""
    e = table(spark, sf_dir, "events")
    track = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        (F.lit(3_000_000) + F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 3)).alias("session_int_id"),
        F.col("user_id").alias("user_int_id"),
        track.alias("track_id"),
        F.when(F.col("event_type") != "signup", F.least(F.col("value") / 100, F.lit(1.0))).alias("playratio"),
        F.when(F.col("event_type") == "error", "skip")
        .when(F.col("event_type") == "purchase", "complete")
        .otherwise("playback_start")
        .alias("event_type"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(mins=track.cast("int"))).alias("updated_at"),
    )


def session_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("track_id"),
        (F.row_number().over(place) - 1).alias("position"),
        (F.col("l_discount") * 10).alias("playratio"),
        play_label(F.col("l_discount") * 10).alias("label"),
    )


def playlist_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist entries; positions may repeat, `place` is the order of the entries."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(
        F.col("l_orderkey").alias("playlist_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("track_id"),
        F.row_number().over(order).alias("place"),
    )


def playlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of `playlist_tracks` without `place`, the order by (position, track_id, supplier)."""
    key = F.col("l_orderkey").alias("playlist_id")
    return table(spark, sf_dir, "lineitem").select(key, F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("supplier"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users; the even ones signed up online and have ids from 100000."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user_"), key).alias("user_id"), F.when(key % 2 == 0, key + 100_000).otherwise(key).alias("user_int_id")
    )


def loved_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_linestatus = 'F'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id")).agg(F.max("l_shipdate").alias("loved_at"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        size.alias("duration_sec"),
        (size != 13).alias("is_playable"),
        F.when(size == 26, "quarantined").otherwise("available").alias("availability_status"),
        F.when(size == 26, "fixture").alias("quarantine_reason"),
        F.when(size != 39, F.concat(F.lit("nav_"), F.col("p_partkey"))).alias("nav_id"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding")


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("metric_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("m"), key % 3).alias("model_version"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "catalog_insufficient")
        .when(F.col("o_orderpriority") == "2-HIGH", "model_degraded")
        .otherwise("healthy")
        .alias("fallback_state"),
        ((F.col("o_orderstatus") == "P") & (key % 5 == 0)).alias("pipeline_error"),
        (F.col("o_totalprice") / 100).alias("total_latency_ms"),
        (key % 19).alias("returned_count"),
        F.col("o_orderdate").alias("created_at"),
    )


def playable() -> Column:
    """Tracks that may be served: playable, available, mapped and not quarantined."""
    return F.col("is_playable") & (F.col("availability_status") == "available") & F.col("nav_id").isNotNull() & F.col("quarantine_reason").isNull()
