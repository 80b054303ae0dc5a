"""Event streams: idempotent ingest, start-to-end merging, hourly counts and per-session track lists.

Each has a batch form, and the streams run with `availableNow`, a checkpoint folder and a Parquet or memory sink.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import new_folder

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; times become timestamps, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """The first event of each key; keys are forgotten after `delay`."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def hourly_counts(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def whole_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All results of an aggregate over the data that is there now; every batch overwrites the files with all of them."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All data that is there now, appended to Parquet files; a rerun with the same checkpoint adds nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder for the files and the state of a stream."""
    return new_folder(spark, "streams")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB, as processors with timers need; the setting before comes back after."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def stream_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different (track, user, event type), kept for the whole span of the data."""
    events = read_events(spark, sf_dir).withColumn("track_id", F.get_json_object("props", "$.k").cast("bigint"))
    own = folder(spark)
    kept = deduplicated(events, ["track_id", "user_id", "event_type"], "60 days").select("track_id", "user_id", "event_type")
    return write_once(kept, f"{own}/out", f"{own}/state")


def stream_hourly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = folder(spark)
    counts = whole_once(hourly_counts(read_events(spark, sf_dir)), f"{own}/out", f"{own}/state")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def lifecycle_events(plays: DataFrame) -> DataFrame:
    """Every play as a start and, if it ended, an end of the same id."""
    start = plays.select("event_id", F.lit("start").alias("phase"), F.col("created_at").alias("at"), F.lit(None).cast("double").alias("playratio"), F.lit("playback_start").alias("event_type"))
    end = plays.where("event_type <> 'playback_start'").select("event_id", F.lit("end").alias("phase"), F.col("updated_at").alias("at"), "playratio", "event_type")
    return start.unionByName(end)


def lifecycle(events: DataFrame) -> DataFrame:
    """Ends merged into their starts; an end without a start is lost."""
    last = F.max_by(F.struct("playratio", "event_type"), F.when(F.col("phase") == "end", F.col("at")))
    merged = events.groupBy("event_id").agg(
        F.min(F.when(F.col("phase") == "start", F.col("at"))).alias("created_at"), F.max(F.when(F.col("phase") == "end", F.col("at"))).alias("updated_at"), last.alias("l")
    )
    return merged.where("created_at IS NOT NULL AND updated_at IS NOT NULL").select("event_id", "created_at", "updated_at", "l.playratio", "l.event_type")


def _newest(rows: DataFrame, at: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_int_id").orderBy(F.desc(f"{at}.created_at"), F.desc(f"{at}.event_id")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("session_int_id", "track_id", "place")


def recent_tracks(plays: DataFrame, most: int = 50) -> DataFrame:
    """Tracks of a session, last played first, each once."""
    return _newest(plays.groupBy("session_int_id", "track_id").agg(F.max(F.struct("created_at", "event_id")).alias("last")), "last", most)


def recommended_tracks(plays: DataFrame, most: int = 500) -> DataFrame:
    """Tracks of a session, last recommended first, each once: a track that is recommended again moves to the front."""
    return recent_tracks(plays, most)
