"""Rules with state over event streams, whose state goes when a timer ends it: rate limits and cool-downs.

Both are processors of ``transformWithState``: state is one row for each key that is within a window or rests, and an
event-time timer at its end removes it, so that the store holds live keys only. A micro-batch's events of a key are
passed in the order of their time; how much a micro-batch holds is the source's own option (``maxFilesPerTrigger``,
``maxBytesPerTrigger``). Each event's outcome depends on the one before it: a key's events are one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from markwright.sources.written import fresh_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Window(StatefulProcessor):
    """Events of a key in windows of ``span`` microseconds from a window's first event; those above ``most`` are refused."""

    def __init__(self, span: int, most: int):
        self.span, self.most = span, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["t", "id"])
        before, n = self.window.get() if self.window.exists() else (None, 0)
        opened, counts, waits = before, [], []
        for t in every["t"].tolist():
            if opened is None or t >= opened + self.span:
                opened, n = t, 0
            n += 1
            counts.append(n)
            waits.append(-((t - opened - self.span) // 1_000_000) if n > self.most else None)
        self.window.update((opened, n))
        if opened != before:  # windows that opened and ended within the batch need no timer: each call is a round trip
            self.handle.registerTimer((opened + self.span) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "id": every["id"].to_numpy(), "n": counts, "allowed": [c <= self.most for c in counts], "wait_s": pd.array(waits, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and (self.window.get()[0] + self.span) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


class Rest(StatefulProcessor):
    """Calls of a key: one that fails makes it rest for as long as its error says; calls within a rest are refused, and
    what they would have met doesn't prolong it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["t", "id"])
        until = self.until.get()[0] if self.until.exists() else 0
        before, refused, ends = until, [], []
        for t, rest in zip(every["t"].tolist(), every["rest"].tolist(), strict=True):
            refused.append(t < until)
            if not refused[-1] and rest > 0:
                until = max(until, t + int(rest))
            ends.append(until if until > t else None)
        if until != before:
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "id": every["id"].to_numpy(), "refused": refused, "until": pd.array(ends, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def rest_ms(code: Column, status: Column, retry_after_ms: Column) -> Column:
    """How long a failed call makes its provider rest."""
    #: fixed values: a used-up quota or a bad key, a rate limit (not that of a single too large call), and their times
    asked = F.when(F.coalesce(retry_after_ms, F.lit(0)) > 0, retry_after_ms).otherwise(15_000)
    limited = (code == "rate_limit") & ~F.coalesce(status == 413, F.lit(False))
    return F.when(code.isin("quota", "invalid_key"), 1_800_000).when(limited, F.greatest(asked, F.lit(8_000))).otherwise(0).cast("long")


def _columns(events: DataFrame, key: str, at: str, id_: str, delay: str, **more: Column) -> DataFrame:
    time = F.col(at).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), time.alias("at"), F.unix_micros(time).alias("t"), F.col(id_).cast("long").alias("id"), *[c.alias(n) for n, c in more.items()])
    return rows.withWatermark("at", delay)


def limited(events: DataFrame, key: str, at: str, id_: str, window_s: int, most: int, delay: str = "0 seconds") -> DataFrame:
    """A stream's events with their number in the key's window, whether they are allowed, and how many seconds to wait."""
    kind = events.schema[key].dataType.simpleString()
    rows = _columns(events, key, at, id_, delay)
    schema = f"key {kind}, id long, n long, allowed boolean, wait_s long"
    return rows.groupBy("key").transformWithStateInPandas(Window(window_s * 1_000_000, most), schema, "Append", "EventTime")


def resting(calls: DataFrame, key: str, at: str, id_: str, rest: Column, delay: str = "0 seconds") -> DataFrame:
    """A stream's calls, refused or not, and until when the key rests after each (microseconds); ``rest``: milliseconds."""
    kind = calls.schema[key].dataType.simpleString()
    rows = _columns(calls, key, at, id_, delay, rest=F.coalesce(rest, F.lit(0)).cast("long") * 1000)
    return rows.groupBy("key").transformWithStateInPandas(Rest(), f"key {kind}, id long, refused boolean, until long", "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """The state store that timers need, while a query starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def run_to_end(stream: DataFrame, label: str):
    """Runs a stream over all that its source holds, into a written table: (table, finished query)."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    with rocks(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start(path)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")
