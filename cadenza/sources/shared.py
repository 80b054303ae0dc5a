"""The folder that all machines of a cluster share, and tables kept there between two steps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
PARTITIONS, ADVISORY, DEALT = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "cadenza.dealt"
#: Parquet bytes of a table for one shuffle partition, and the most that two partitions are joined up to.
PARTITION_BYTES = 4 << 20
_BYTES: dict[tuple[str, str], int] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a temporary one only where driver and executors are one process."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    return f"/tmp/cadenza-{spark.sparkContext.applicationId}"


def file_bytes(spark: SparkSession, path: str) -> int:
    """The length of the files of a table, as they are listed; each path is listed once in an application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _BYTES:
        _BYTES[key] = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    return _BYTES[key]


def deal_by_size(spark: SparkSession, path: str, size: int = PARTITION_BYTES) -> None:
    """From now on the session has at least one shuffle partition for `size` bytes of the table, so a task's share does not grow with it."""
    need, now = -(-file_bytes(spark, path) // size), int(spark.conf.get(PARTITIONS))
    if need > now:
        before = spark.conf.get(DEALT, None) or f"{now} {spark.conf.get(ADVISORY)}"
        spark.conf.set(DEALT, before)
        spark.conf.set(PARTITIONS, need)
        spark.conf.set(ADVISORY, f"{min(size, _plain_bytes(before.split()[1]))}b")


def deal_as_before(spark: SparkSession) -> None:
    """The session's own settings again, as they were before `deal_by_size` raised them."""
    before = spark.conf.get(DEALT, None)
    if before:
        for name, value in zip((PARTITIONS, ADVISORY), before.split(), strict=True):
            spark.conf.set(name, value)
        spark.conf.unset(DEALT)


def _plain_bytes(text: str) -> int:
    """Bytes of a setting like 64MB, 8m or 1048576b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back: several readers, and executors that are lost, find them there."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with `name`, their number from 0 in the order of the columns `order` (nulls first), which no two rows have alike.

    Ranges of rows are numbered each for itself and moved by the sizes of the ranges before, of which there is one row each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)
