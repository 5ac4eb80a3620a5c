"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Broadcasts are built only from data that was measured to be below this many bytes.
BROADCAST_LIMIT = 64 << 20

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="markwright-")
    return _LOCAL_DIRS[app]


class Scratch:
    """Written tables that cut the lineage of a job, in a folder of their own below the shared one.

    They survive the loss of executors. Tables that nothing reads any more are dropped as soon as the next one is
    written; what a returned DataFrame still reads stays, for the cluster's own retention rules.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/markwright/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def free(name: str, taken: list[str]) -> str:
    """A column name that is not among ``taken``, whatever the input's own columns are called."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = "_" + name
    return name


#: the column that ``row_ids`` adds
ROW = "_row"


def row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``: the doc_id, but a new id above all others for null ids and for later rows of an id."""
    columns = docs.columns
    rows, ids, most = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.coalesce(F.max("doc_id"), F.lit(-1))).first()
    if rows == ids:
        return docs.withColumn(ROW, F.col("doc_id"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", salt).orderBy(*[c for c in columns if c != "doc_id"]))
    numbered = docs.withColumn("_new", F.col("doc_id").isNull() | (nth > 1)).withColumn("_at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    numbered = Scratch(docs.sparkSession, "rows").save(numbered, "rows")
    # one row for each partition of the table
    sizes = numbered.groupBy(F.col("_part").alias("_p")).agg((F.max("_at") + 1).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    fresh = F.lit(most + 1).cast("long") + F.col("_start") + F.col("_at")
    return numbered.join(starts, F.col("_part") == F.col("_p")).select(*columns, F.when(F.col("_new"), fresh).otherwise(F.col("doc_id")).alias(ROW))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out_bucket(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# ---------------------------------------------------------------------------------------------------------
# Inside tasks


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads all bits (three xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def hash_words(texts: list[bytes | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts in turn, and how many each text has.

    ``table`` translates bytes before. A hash is a polynomial over the word's bytes, from differences of prefix sums.
    """
    joined = b" ".join(t or b"" for t in texts) + b" "
    raw = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=prefix[1:])
        hashes = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def tidy(task):
    """A task of ``mapInArrow`` that gives freed memory back to the machine when it ends, as Python workers are reused."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return run


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes each, to bound a task's memory."""
    out, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most:
            out.append((lo, i + 1))
            lo, held = i + 1, 0
    return out + ([(lo, len(texts))] if lo < len(texts) else [])


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
