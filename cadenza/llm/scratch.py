"""Intermediate tables in the folder that the cluster shares (`spark.checkpoint.dir`)."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.tokens import give_back

_OWN: dict[str, str] = {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where that is unset, as in tests, a temporary folder if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cadenza-scratch-")
    return _OWN[app]


def tidy() -> None:
    """What the driver built for a plan that has run (tables, columns and the JVM objects they hold) is let go."""
    gc.collect()
    give_back()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if f"{shared_dir(spark)}/cadenza/".split("://")[-1] in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """From now on the session's Arrow batches have at most `most_bytes` (or one row): 10,000 long texts in one batch, held
    several times over by an executor and its Python worker, cost more memory than all else in a task."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if now > most_bytes:
        spark.conf.set(BATCH_BYTES, f"{most_bytes}b")


@contextmanager
def short_plans(spark: SparkSession, most: int = 100_000) -> Iterator[None]:
    """Inside, the plans that Spark describes for its listeners are cut at `most` characters: it keeps those of a thousand
    queries in the driver, and a literal table of megabytes is in each of them several times."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """`df` marked for a broadcast if it has at most `most` rows (counted), else `df` for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
