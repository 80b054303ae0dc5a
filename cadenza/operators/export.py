"""Incremental export of finalized plays: positions, windows, checks, checkpoints and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.scalars import play_label, ratio


def positioned(plays: DataFrame) -> DataFrame:
    """Finalized plays with their place in the whole session's finalized history, from 0."""
    order = Window.partitionBy("session_int_id").orderBy("created_at", "event_id")
    return plays.where("playratio IS NOT NULL").withColumn("position", F.row_number().over(order) - 1)


def event_time() -> Column:
    """When a play counts: finalized ones (skip, complete or with a ratio) at their last update, if there is one, others at their start."""
    final = F.coalesce(F.col("event_type").isin("skip", "complete"), F.lit(False)) | F.col("playratio").isNotNull()
    return F.when(final, F.coalesce("updated_at", "created_at")).otherwise(F.col("created_at"))


def delta(plays: DataFrame, last: str, cutoff: str, event_time: str = "created_at") -> DataFrame:
    """Rows of the half-open window (last, cutoff], with positions of the whole history.

    `event_time` created_at leaves out plays that began before a cutoff and ended after it; updated_at has them.
    """
    when = F.col(event_time)
    rows = positioned(plays).where((when > F.lit(last).cast("timestamp_ntz")) & (when <= F.lit(cutoff).cast("timestamp_ntz")))
    return rows.select(
        F.col("session_int_id").alias("session_id"),
        F.col("user_int_id").alias("user_id"),
        "position",
        "track_id",
        "playratio",
        play_label(F.col("playratio")).alias("label"),
    )


def session_meta(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "user_id").distinct()


def coerced(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """`rows` with exactly the fields of `schema`: missing ones null, others cast, in its order."""
    return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def violations(sessions: DataFrame, playlists: DataFrame, labels: tuple[str, ...] = ("positive", "neutral", "skip")) -> DataFrame:
    """(check, n) for the rules of an export; the export is good if all are 0."""

    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))

    bad = sessions.agg(
        F.coalesce(F.sum(F.when(~F.col("label").isin(*labels), 1).otherwise(0)), F.lit(0)).alias("unknown_label"),
        F.coalesce(F.sum(F.when(~F.col("playratio").between(0, 1), 1).otherwise(0)), F.lit(0)).alias("ratio_out_of_range"),
    )
    checks = bad.select(F.explode(F.create_map(F.lit("unknown_label"), F.col("unknown_label"), F.lit("ratio_out_of_range"), F.col("ratio_out_of_range"))).alias("check", "n"))
    for name, rows in (("session_position", repeated(sessions, "session_id", "position")), ("playlist_position", repeated(playlists, "playlist_id", "position"))):
        checks = checks.unionByName(rows.select(F.lit(name).alias("check"), "n"))
    return checks.select("check", F.col("n").cast("bigint").alias("n"))


def assert_valid(checks: DataFrame) -> None:
    """Stop an export that breaks a rule."""
    broken = {r.check: r.n for r in checks.where("n > 0").collect()}
    if broken:
        raise ValueError(f"export rules broken: {broken}")


def row_counts(outputs: dict[str, DataFrame]) -> DataFrame:
    """(output, n_rows) of every output."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("output"), "n_rows") for k, d in outputs.items()])


def watermark(rows: DataFrame, last: int) -> DataFrame:
    return rows.agg(F.coalesce(F.max("session_id"), F.lit(last).cast("bigint")).alias("session_int_id_watermark"))


def daily_checkpoints(plays: DataFrame) -> DataFrame:
    """(version, status, session_tracks_rows, session_int_id_watermark, exported_at): what an export at the end of every day records.

    A day's export has its finalized plays; days without any record an export without rows as skipped. The watermark
    never falls.
    """
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz")
    rows = plays.groupBy(day.alias("day")).agg(
        F.count(F.when(F.col("playratio").isNotNull(), 1)).alias("session_tracks_rows"), F.max(F.when(F.col("playratio").isNotNull(), F.col("session_int_id"))).alias("_top")
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each day
    return rows.select(
        F.date_format("day", "yyyyMMdd").alias("version"),
        F.when(F.col("session_tracks_rows") > 0, "success").otherwise("skipped").alias("status"),
        "session_tracks_rows",
        F.max("_top").over(upto).alias("session_int_id_watermark"),
        (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("exported_at"),
    )


def retrain_trigger(rows: DataFrame, threshold: int = 1000) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("triggered", F.col("n_rows") >= threshold)


def degradation(plays: DataFrame, start: str, end: str, least: int = 50, skip_limit: float = 0.8, skip_below: float = 0.2) -> DataFrame:
    """One row: finalized plays of the window, their skip rate, and set, clear or (too few plays) unchanged."""
    inside = plays.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) & F.col("playratio").isNotNull())
    sums = inside.agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col("playratio") < skip_below, 1)).alias("n_skips"))
    rate = ratio(F.col("n_skips"), F.col("n_events"))
    action = F.when(F.col("n_events") < least, "unchanged").when(rate > skip_limit, "set").otherwise("clear")
    return sums.select("n_events", "n_skips", rate.alias("skip_rate"), action.alias("action"))
