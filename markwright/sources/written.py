"""Tables that are written between two steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where it is unset, as in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="markwright-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/markwright/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a written table: its readers don't compute it again, and it survives lost executors."""
    path = fresh_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A scanned table in as many partitions as there are cores, if it has fewer: for much work on few bytes. A table of
    more files or row groups stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def parts_of(scanned: DataFrame, times: int = 8) -> int:
    """So many parts for each of a scan's, and as many as there are shuffle partitions at least: they grow in number with
    the table, not in size."""
    least = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, times * scanned.rdd.getNumPartitions())


def dealt(rows: DataFrame, key: str, times: int = 8) -> DataFrame:
    """A scanned table dealt out by a key before its rows unfold, so that what goes by that key later needs no shuffle."""
    return rows.repartition(parts_of(rows, times), key)
