"""A table in hash partitions that streams merge into: upserts, replaced sets, deletes; each batch once.

The table's rows are dealt to ``buckets`` folders by a hash of the key that changes go by. A batch reads and rewrites
only the folders that its keys are in (dynamic partition overwrite); which they were is told in a ledger with the
batch's number, so that a batch which is played again changes nothing. A batch that failed half-way isn't in the ledger;
played again it comes to the same rows, as every change is by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markwright.sources.readers import keep_latest
from markwright.sources.written import fresh_path

BUCKET = "_bucket"
LEDGER = "batch long, action string, buckets array<int>"


class MergedTable:
    """``key``: the column that changes go by - an id, or the owner of a set."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    @classmethod
    def create(cls, rows: DataFrame, label: str, key: str, buckets: int = 64) -> MergedTable:
        made = cls(rows.sparkSession, fresh_path(rows.sparkSession, label), rows.schema, key, buckets)
        made._write(rows)
        return made

    def rows(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def ledger(self) -> DataFrame:
        return self._read(self.path + "-ledger", StructType.fromDDL(LEDGER))

    def upsert(self, changes: DataFrame, number: int, order: list[Column]) -> None:
        """Changes replace the rows of their keys; of several for one key the first in ``order`` (latest first)."""
        newest = keep_latest(changes.where(F.col(self.key).isNotNull()), [self.key], order)
        self._merge("upsert", newest, number, lambda old, new: old.join(new, self.key, "left_anti").unionByName(new.select(*self.schema.names)))

    def replace(self, changes: DataFrame, number: int, present: str) -> None:
        """All rows of the owners in the batch go, and those of its rows where ``present`` is true take their place."""
        put = F.coalesce(F.col(present), F.lit(False))
        self._merge("replace", changes, number, lambda old, new: old.join(new.select(self.key).distinct(), self.key, "left_anti").unionByName(new.where(put).select(*self.schema.names)))

    def delete(self, gone: DataFrame, number: int) -> None:
        """All rows of these keys go."""
        self._merge("delete", gone.select(self.key).distinct(), number, lambda old, new: old.join(new, self.key, "left_anti"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, path: str, schema: StructType) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def _stored(self) -> DataFrame:
        return self._read(self.path, StructType([*self.schema.fields, *StructType.fromDDL(f"{BUCKET} int").fields]))

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _merge(self, action: str, changes: DataFrame, number: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        if self.ledger().where((F.col("batch") == number) & (F.col("action") == action)).limit(1).count():
            return
        changes = changes.persist()
        try:
            touched = sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())  # ``buckets`` numbers at most
            old = self._stored().where(F.col(BUCKET).isin(touched)).select(*self.schema.names)
            rows = merged(old, changes).persist()
            try:
                left = {r[0] for r in rows.select(self._bucket()).distinct().collect()}
                self._write(rows)
                self._empty([b for b in touched if b not in left])  # a write doesn't see folders without rows
            finally:
                rows.unpersist()
        finally:
            changes.unpersist()
        self.spark.createDataFrame([(number, action, touched)], LEDGER).coalesce(1).write.mode("append").parquet(self.path + "-ledger")

    def _empty(self, buckets: list[int]) -> None:
        for b in buckets:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def merge_stream(stream: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Passes all batches of a stream to ``change(batch, number)``, to the stream's end."""
    stream.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def delete_cascade(tables: list[MergedTable], gone: DataFrame, number: int) -> None:
    """Children first, then the parent: what breaks off can be played again. ``gone`` has the key of each table."""
    for t in tables:
        t.delete(gone.select(F.col(gone.columns[0]).alias(t.key)), number)


def write_both(stream: DataFrame, first: str, second: str, accepted: Column, checkpoint: str):
    """A stream to two stores: a batch is done once the first has it. What the second takes goes there; if it fails, those
    rows go to a table beside the first (``<first>-retry``) with the batch's number and the reason, to be taken up again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(first)
        rest = batch.where(F.coalesce(accepted, F.lit(False)))
        try:
            rest.write.mode("append").parquet(second)
        except Exception as error:  # the second store is best effort, and what it lost is kept
            rest.withColumns({"_batch": F.lit(number).cast("long"), "_reason": F.lit(str(error)[:200])}).write.mode("append").parquet(first + "-retry")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
