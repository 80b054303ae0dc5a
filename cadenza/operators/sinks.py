"""Files that jobs leave behind: CSV, JSON and versioned exports, and the tables built of these."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.export import delta, session_meta

CHECKPOINT = "version string, status string, session_tracks_rows bigint, session_int_id_watermark bigint"
WHOLE_CHECKPOINT = f"{CHECKPOINT}, exported_at timestamp_ntz, rows_exported map<string,bigint>"
#: The first export begins here.
BEGINNING = "2000-01-01 00:00:00"


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def checkpoints(spark: SparkSession, root: str, schema: str = CHECKPOINT) -> DataFrame:
    """The exports that ended, none if there is no such folder yet; WHOLE_CHECKPOINT also has cutoffs and rows of all outputs."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/checkpoints")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_checkpoint(spark: SparkSession, root: str) -> tuple[str, int]:
    """(cutoff, watermark) of the export that ended last."""
    row = checkpoints(spark, root, WHOLE_CHECKPOINT).orderBy(F.desc_nulls_last("exported_at"), F.desc("version")).first()
    return (str(row.exported_at or BEGINNING), row.session_int_id_watermark) if row else (BEGINNING, 0)


def export_version(outputs: dict[str, DataFrame], root: str, version: str, last: int = 0, exported_at: str | None = None) -> None:
    """Write every output under `root/version`, then append the checkpoint row: cutoff, rows of every output, watermark of session_tracks.

    A version counts once it has its row: then it is not written again; one that broke off before is overwritten as a whole.
    """
    spark = outputs["session_tracks"].sparkSession
    if not checkpoints(spark, root).where(F.col("version") == version).isEmpty():
        return
    counts = None
    for name, rows in outputs.items():
        path = f"{root}/{version}/{name}.parquet"
        rows.write.mode("overwrite").option("compression", "snappy").parquet(path)
        written = spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.struct(F.lit(name).alias("key"), F.col("n").alias("value")).alias("e"))
        counts = written if counts is None else counts.unionByName(written)
    sessions = spark.read.schema(outputs["session_tracks"].schema).parquet(f"{root}/{version}/session_tracks.parquet")
    row = sessions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("session_id"), F.lit(last)).cast("bigint").alias("session_int_id_watermark"))
    row = row.crossJoin(counts.agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("rows_exported")))  # a row each
    row = row.select(
        F.lit(version).alias("version"),
        F.lit("success").alias("status"),
        F.col("n").alias("session_tracks_rows"),
        "session_int_id_watermark",
        F.lit(exported_at).cast("timestamp_ntz").alias("exported_at"),
        "rows_exported",
    )
    row.write.mode("append").parquet(f"{root}/checkpoints")


def export_next(plays: DataFrame, root: str, version: str, cutoff: str) -> None:
    """Export the finalized plays of (last cutoff, cutoff], with the positions of the whole history, and their sessions."""
    last, watermark = last_checkpoint(plays.sparkSession, root)
    rows = delta(plays, last, cutoff)
    export_version({"session_tracks": rows, "session_meta": session_meta(rows)}, root, version, watermark, cutoff)


def export_stream(arrivals: DataFrame, history: Callable[[], DataFrame], root: str, checkpoint: str) -> None:
    """One export for every batch of `arrivals` that there is now; `history` reads all plays that have come in.

    A batch's cutoff is the time of its latest play. The version is the batch's number, so a batch that comes again after a
    failure repeats its export from the same beginning, or finds that it has ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        cutoff = batch.agg(F.max("created_at")).first()[0]
        if cutoff is not None:
            plays = history().where(F.col("created_at") <= F.lit(str(cutoff)).cast("timestamp_ntz"))
            export_next(plays, root, f"{number:05d}", str(cutoff))

    arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def exported(spark: SparkSession, root: str) -> DataFrame:
    """The session rows of all exports that ended, with `version` and `rows_of_version`, the number in its checkpoint."""
    ended = checkpoints(spark, root)
    versions = sorted(r.version for r in ended.select("version").collect())  # one row for each export
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{x}/session_tracks.parquet").withColumn("version", F.lit(x)) for x in versions])
    return rows.join(F.broadcast(ended.select("version", F.col("session_tracks_rows").alias("rows_of_version"))), "version")


def with_deltas(snapshot: DataFrame, deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """The snapshot with all deltas; of rows with one key the one of the latest delta stays."""
    numbered = [d.withColumn("_turn", F.lit(k)) for k, d in enumerate([snapshot, *deltas])]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_turn")))
    return reduce(DataFrame.unionByName, numbered).withColumn("_place", place).where("_place = 1").drop("_turn", "_place")


def manifest_status(manifest: DataFrame, bulk: DataFrame, mapped: DataFrame) -> DataFrame:
    """(track_id, nav_id, status) of manifest rows (track_id, nav_id) by the bulk map and the stored mappings.

    The bulk id comes before the row's own. verified: the stored id is still the same, or there is no id but the track is
    mapped; missing: there is neither; remap: the id is new or another.
    """
    rows = manifest.select("track_id", F.nullif("nav_id", F.lit("")).alias("own"))
    rows = rows.join(bulk.select("track_id", F.nullif("nav_id", F.lit("")).alias("bulk")), "track_id", "left")
    rows = rows.join(mapped.select("track_id", F.nullif("nav_id", F.lit("")).alias("stored"), F.lit(True).alias("known")), "track_id", "left")
    rows = rows.withColumn("nav_id", F.coalesce("bulk", "own"))
    status = (
        F.when(F.col("nav_id").isNull(), F.when(F.col("known"), "verified").otherwise("missing"))
        .when(F.col("stored") == F.col("nav_id"), "verified")
        .otherwise("remap")
    )
    return rows.select("track_id", "nav_id", status.alias("status"))


def manifest_gaps(manifests: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """`manifests` (version, files) with `missing`, the required names that are absent, sorted, `forbidden` and `valid`."""
    names = F.transform("files", lambda f: F.element_at(F.split(F.trim(f), "/"), -1))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), names))
    text = F.lower(F.array_join("files", " "))
    found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in forbidden])
    out = manifests.select("version", missing.alias("missing"), found.alias("forbidden"))
    return out.withColumn("valid", (F.size("missing") == 0) & ~F.col("forbidden"))
