"""Readers of CSV, JSON and folder listings, each giving a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import first_filled

# The names that a music manifest may give its columns, the first filled one counts.
MANIFEST_NAMES = {
    "track_id": ("track_id", "id", "song_id", "item_id", "track", "tid"),
    "path": ("path", "file", "filename", "filepath", "relative_path"),
    "title": ("title", "track_title", "song", "name"),
    "artist": ("artist", "artist_name", "creator"),
    "album": ("album", "album_name"),
    "duration_sec": ("duration_sec", "duration", "length_sec", "seconds"),
}


def csv_columns(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """`columns` of CSV files whose header must name the fields of `schema`."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).select(*columns)


def csv_required(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV files as strings; an error if a required column is missing or there is no row."""
    rows = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def _stem(path: Column) -> Column:
    """The file name of a path without its last suffix; a name that begins with its only dot stays whole."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]*\z", "$1")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a CSV manifest under any of its column names.

    A row without an id takes the stem of its file; without either it is left out. A missing title is the id, a missing
    artist "Unknown Artist", a missing album empty and a missing duration 0.
    """
    rows = spark.read.option("header", True).csv(path)
    given = {c.strip().lower(): c for c in rows.columns}

    def named(field: str) -> Column:
        there = [rows[given[n]] for n in MANIFEST_NAMES[field] if n in given]
        return first_filled(*there) if there else F.lit(None).cast("string")

    rows = rows.select(*[named(f).alias(f) for f in MANIFEST_NAMES])
    rows = rows.withColumn("track_id", F.coalesce("track_id", _stem(F.col("path")))).where("track_id IS NOT NULL")
    return rows.select(
        "track_id",
        F.coalesce("title", "track_id").alias("title"),
        F.coalesce("artist", F.lit("Unknown Artist")).alias("artist"),
        F.coalesce("album", F.lit("")).alias("album"),
        F.coalesce(F.col("duration_sec").try_cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.concat(F.lit("/covers/"), "track_id").alias("cover_art_url"),
    )


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, stem, modified) of the files under a folder that end in one of the suffixes, in any case, also of empty ones.

    The driver lists the names, as for every table that Spark reads, without reading a file. Names with a component under
    the folder that begins with _ or . are left out.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found, files = system.makeQualified(root).toString(), [], system.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()
        if not re.search(r"/[_.]", name[len(top) :]):
            found.append((name, status.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, ms bigint")
    rows = rows.select("path", _stem(F.col("path")).alias("stem"), F.timestamp_millis("ms").alias("modified"))
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1)).isin(*suffixes)) if suffixes else rows


def json_rows(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The structs in the array `field` of JSON documents, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(field))


def json_map(rows: DataFrame, column: str, value: str = "bigint") -> DataFrame:
    """(key, value) of the JSON objects in a string column."""
    return rows.select(F.explode(F.from_json(column, f"map<string,{value}>")).alias("key", "value"))


def newest_prefix(files: DataFrame, name: str = "manifest.json") -> DataFrame:
    """One row: the folder of the file `name` that was modified last, of equally new ones the last by name."""
    prefix = F.regexp_extract("path", r"(?s)\A(.*/)[^/]*\z", 1)
    named = files.where(F.endswith("path", F.lit(f"/{name}"))).select(prefix.alias("prefix"), "modified")
    return named.agg(F.max(F.struct("modified", "prefix")).alias("last")).select("last.prefix", "last.modified")
