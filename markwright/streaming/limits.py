"""Stateful behaviour over event streams: rate limits, throttles, idempotent appends; in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(events: DataFrame, key: str, at: str, id_: str, window_s: int, most: int) -> DataFrame:
    """Marks each event allowed or not. A key's window opens at its first event and holds ``window_s`` seconds; the
    next event after that opens another. Events above ``most`` in a window are refused.

    Each window depends on the one before, so a key's events are passed in order, as a stream: a task holds one batch
    and the state of one key, however many events a key has.
    """
    span = window_s * 1_000_000

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, n = object(), 0, 0
        for rows in frames:
            counts = []
            for k, t in zip(rows[key].tolist(), rows["_t"].tolist(), strict=True):
                if k != current or t >= opened + span:
                    current, opened, n = k, t, 0
                n += 1
                counts.append(n)
            yield rows[[id_, key]].assign(n=counts, allowed=[c <= most for c in counts])

    micros = F.unix_micros(F.col(at).cast("timestamp"))
    ordered = events.select(id_, key, micros.alias("_t")).repartition(key).sortWithinPartitions(key, "_t", id_)
    schema = events.select(id_, key).schema.add("n", "integer").add("allowed", "boolean")
    return ordered.mapInPandas(fold, schema)


def throttle(events: DataFrame, key: str, at: str, id_: str, gap_s: int) -> DataFrame:
    """The events that pass a throttle of one in ``gap_s`` seconds for each key."""
    return rate_limit(events, key, at, id_, gap_s, 1).where("allowed").select(id_, key)


def stream_rate_limit(events: DataFrame, key: str, at: str, id_: str, window_s: int, most: int) -> DataFrame:
    """The same rule on a stream: state per key is the window's opening and its count. Events come in order per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        counts = []
        for t in rows["t"]:
            if opened is None or t >= opened + window_s * 1_000_000:
                opened, n = int(t), 0
            n += 1
            counts.append(n)
        state.update((opened, n))
        yield pd.DataFrame({id_: rows["id"].to_numpy(), key: k[0], "n": counts, "allowed": [c <= most for c in counts]})

    rows = events.select(F.col(key), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(id_).alias("id"))
    schema = f"{id_} long, {key} long, n int, allowed boolean"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "opened long, n int", "append", GroupStateTimeout.NoTimeout)


def idempotent_stream(events: DataFrame, id_: str, at: str, delay: str) -> DataFrame:
    """Each id once, as long as its copies come within ``delay``."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_])


def upsert_latest(events: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """The last write of each key; of equal times the larger id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(id_))
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def cool_down(failures: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Until when each key rests: the latest failure's end."""
    return failures.groupBy(key).agg(F.max(F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))).alias("until"))


def is_fresh(age_s, gained, most_age_s: int = 259200, most_gained: int = 8):
    """A cached insight holds while it is young and little has come since."""
    return (age_s < most_age_s) & (gained < most_gained)


def is_enough(n, least: int = 4):
    """Whether there are mistakes enough to look for a pattern in them."""
    return n >= least


def append_once(events: DataFrame, id_: str, at: str, order: str) -> DataFrame:
    """The batch form of ``idempotent_stream``: of rows of one id the first."""
    return events.groupBy(id_).agg(F.min_by(F.struct(*[c for c in events.columns if c != id_]), F.struct(at, order)).alias("_first")).select(id_, "_first.*")


def dual_write(rows: DataFrame, accepted) -> tuple[DataFrame, DataFrame]:
    """What a primary store gets (all), and a secondary one that only takes some and never holds up the first."""
    return rows, rows.where(F.coalesce(accepted, F.lit(False)))
