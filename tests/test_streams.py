"""Streams with timers over several batches, and tables that streams merge into."""

from pyspark.sql import functions as F

from markwright.streaming import limits, sinks, stateful

SCHEMA = "event_id long, user_id long, ts timestamp, rest long"


def _write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, s long, rest long").select("event_id", "user_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "rest").coalesce(1).write.mode("append").parquet(path)


def _run(spark, stream, tmp_path, name):
    with stateful.rocks(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start(str(tmp_path / name))
        query.awaitTermination(300)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())), held


def test_windows_close_by_timers(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [(1, 7, 0, 0), (2, 7, 10, 0), (3, 7, 59, 0), (5, 8, 5, 0)]
    later = [(4, 7, 60, 0), (6, 7, 61, 0), (8, 7, 119, 0), (9, 9, 119, 0)]
    _write(spark, path, first)
    stream = stateful.limited(spark.readStream.schema(SCHEMA).parquet(path), "user_id", "ts", "event_id", 60, 2)
    got, held = _run(spark, stream, tmp_path, "out")
    assert got == [(7, 1, 1, True, None), (7, 2, 2, True, None), (7, 3, 3, False, 1), (8, 5, 1, True, None)]
    _write(spark, path, later)
    got, held = _run(spark, stream, tmp_path, "out")
    assert [r for r in got if r[1] in (4, 6, 8, 9)] == [(7, 4, 1, True, None), (7, 6, 2, True, None), (7, 8, 3, False, 1), (9, 9, 1, True, None)]
    assert held[-1] == 2  # 8's window is over at 119: only 7 and 9 are held
    _write(spark, path, [(10, 1, 100_000, 0), (11, 1, 100_000, 0)])
    got, held = _run(spark, stream, tmp_path, "out")
    assert held[-1] == 1 and len(got) == 10  # all windows but that of the last events are gone
    batch = limits.rate_limit(spark.read.schema(SCHEMA).parquet(path), "user_id", "ts", "event_id", 60, 2)
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == sorted((r["user_id"], r["event_id"], r["n"], r["allowed"]) for r in batch.collect())


def test_a_rest_refuses_and_is_not_prolonged(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda s: (1_700_000_000 + s) * 1_000_000
    _write(spark, path, [(1, 1, 0, 8000), (2, 1, 7, 30_000), (3, 1, 8, 0), (4, 2, 3, 0), (5, 1, 9, 1_800_000)])
    stream = stateful.resting(spark.readStream.schema(SCHEMA).parquet(path), "user_id", "ts", "event_id", F.col("rest"))
    got, held = _run(spark, stream, tmp_path, "out")
    assert got == [(1, 1, False, at(8)), (1, 2, True, at(8)), (1, 3, False, None), (1, 5, False, at(1809)), (2, 4, False, None)]
    assert held[-1] == 1
    _write(spark, path, [(6, 1, 1808, 0), (7, 1, 1809, 0), (8, 3, 1_000_000, 0)])
    got, held = _run(spark, stream, tmp_path, "out")
    assert [r for r in got if r[1] > 5] == [(1, 6, True, at(1809)), (1, 7, False, None), (3, 8, False, None)]
    assert held[-1] == 0


def test_how_long_errors_make_rest(spark):
    cases = [("quota", 429, None, 1_800_000), ("invalid_key", 401, 5, 1_800_000), ("rate_limit", 429, None, 15_000), ("rate_limit", 429, 0, 15_000), ("rate_limit", 429, 500, 8_000), ("rate_limit", 429, 20_000, 20_000), ("rate_limit", 413, 20_000, 0), ("rate_limit", None, 20_000, 20_000), ("invalid_json", 200, None, 0), (None, None, None, 0)]
    rows = spark.createDataFrame(cases, "code string, status int, retry long, want long")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", stateful.rest_ms(F.col("code"), F.col("status"), F.col("retry"))).collect())


def _files(tmp_path, held):
    folder = held.path.removeprefix("file://")
    from pathlib import Path

    return {p.relative_to(folder): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_a_batch_rewrites_its_folders_alone_and_once(spark, tmp_path):
    held = sinks.MergedTable.create(spark.range(2000).select("id", F.lit("old").alias("v")), "t", "id", buckets=16)
    before = _files(tmp_path, held)
    changes = spark.createDataFrame([(5, "b", 2), (5, "a", 1), (7, "c", 1), (9999, "d", 1), (None, "x", 1)], "id long, v string, at int")
    held.upsert(changes, 0, [F.desc("at")])
    after = _files(tmp_path, held)
    (row,) = held.ledger().collect()
    changed = {str(p.parent) for p in set(before) ^ set(after)}
    assert changed == {f"_bucket={b}" for b in row["buckets"]} and 1 <= len(row["buckets"]) <= 3
    got = {r["id"]: r["v"] for r in held.rows().where("v <> 'old'").collect()}
    assert got == {5: "b", 7: "c", 9999: "d"} and held.rows().count() == 2001
    held.upsert(changes.withColumn("v", F.lit("again")), 0, [F.desc("at")])
    assert _files(tmp_path, held) == after and held.ledger().count() == 1
    held.upsert(changes.withColumn("v", F.lit("next")).where("id = 7"), 1, [F.desc("at")])
    assert {r["id"]: r["v"] for r in held.rows().where("v <> 'old'").collect()} == {5: "b", 7: "next", 9999: "d"}


def test_deletes_empty_folders_and_replaced_sets_may_be_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 99)], "owner long, item long")
    held = sinks.MergedTable.create(rows, "s", "owner", buckets=8)
    new = spark.createDataFrame([(1, None, False), (2, 21, True), (2, 22, True), (3, 30, True)], "owner long, item long, here boolean")
    held.replace(new, 0, "here")
    assert sorted(map(tuple, held.rows().where("owner IS NOT NULL").collect())) == [(2, 21), (2, 22), (3, 30)]
    child = sinks.MergedTable.create(held.rows(), "c", "owner", buckets=8)
    for _ in range(2):
        sinks.delete_cascade([child, held], spark.createDataFrame([(2,), (3,), (77,)], "owner long"), 1)
    assert [tuple(r) for r in held.rows().collect()] == [(None, 99)] == [tuple(r) for r in child.rows().collect()]
    assert held.ledger().count() == 2
    held.delete(spark.createDataFrame([], "owner long"), 2)
    assert held.rows().count() == 1


def test_one_timer_for_a_key_and_batch():
    import pandas as pd

    class Handle:
        timers: list[int] = []

        def getValueState(self, *_):
            return self

        def exists(self):
            return hasattr(self, "held")

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

        def registerTimer(self, at):
            self.timers.append(at)

    handle, window = Handle(), stateful.Window(60_000_000, 2)
    window.init(handle)
    frame = lambda *s: pd.DataFrame({"t": [x * 1_000_000 for x in s], "id": range(len(s))})
    (out,) = window.handleInputRows((1,), iter([frame(0, 10, 70, 200)]), None)
    assert out["n"].tolist() == [1, 2, 1, 1] and handle.timers == [260_001]
    (out,) = window.handleInputRows((1,), iter([frame(210)]), None)
    assert out["n"].tolist() == [2] and handle.timers == [260_001]
