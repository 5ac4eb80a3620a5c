"""Registered queries that run a stream or a sink to its end and read back what it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.plans.catalog import query
from markwright.sources.readers import table
from markwright.sources.written import fresh_path
from markwright.streaming import sinks, stateful
from markwright.streaming.stateful import table_stream


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT event_id, user_id, t, k, t AS opened, 1 AS n FROM o WHERE k = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.t, o.k, CASE WHEN o.t >= f.opened + 43200000000 THEN o.t ELSE f.opened END, CASE WHEN o.t >= f.opened + 43200000000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT event_id, user_id, CAST(n AS BIGINT) AS n, n <= 2 AS allowed, CASE WHEN n > 2 THEN CAST(ceil((opened + 43200000000 - t) / 1000000.0) AS BIGINT) ELSE 0 END AS wait_s FROM f
""")
def streamed_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """The rate limit as a stream with state and timers: two events in twelve hours, and how long a refused one has to wait."""
    found, _ = stateful.run_to_end(stateful.limited(table_stream(spark, d, "events"), "user_id", "ts", "event_id", 43200, 2), "limited")
    return found.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "n", "allowed", F.coalesce("wait_s", F.lit(0)).alias("wait_s"))


@query("""
WITH RECURSIVE c AS (SELECT event_id, user_id % 40 AS provider, epoch_us(ts) AS t,
  CASE WHEN event_type = 'error' THEN 1800000 WHEN event_type = 'signup' AND value >= 10 THEN greatest(8000, CASE WHEN CAST(floor(value * 1000) AS BIGINT) > 0 THEN CAST(floor(value * 1000) AS BIGINT) ELSE 15000 END) WHEN event_type = 'purchase' AND value < 50 THEN 1800000 ELSE 0 END AS rest FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY t, event_id) AS k FROM c),
f AS (SELECT event_id, provider, t, k, false AS refused, CASE WHEN rest > 0 THEN t + rest * 1000 ELSE 0 END AS u FROM o WHERE k = 1 UNION ALL
  SELECT o.event_id, o.provider, o.t, o.k, o.t < f.u, CASE WHEN o.t >= f.u AND o.rest > 0 THEN o.t + o.rest * 1000 ELSE f.u END FROM f JOIN o ON o.provider = f.provider AND o.k = f.k + 1)
SELECT event_id, provider, refused, CASE WHEN u > t THEN u ELSE 0 END AS until FROM f
""")
def refused_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls to providers as a stream: failed ones make a provider rest as their error says, and calls meanwhile are refused."""
    kind, value = F.col("event_type"), F.col("value")
    code = F.when(kind == "error", "quota").when(kind == "signup", "rate_limit").when((kind == "purchase") & (value < 50), "invalid_key").when(kind == "view", "invalid_json")
    calls = table_stream(spark, d, "events").withColumn("provider", F.col("user_id") % 40)
    rest = stateful.rest_ms(code, F.when(value < 10, 413).otherwise(429), F.floor(value * 1000))
    found, _ = stateful.run_to_end(stateful.resting(calls, "provider", "ts", "event_id", rest), "resting")
    return found.select(F.col("id").alias("event_id"), F.col("key").alias("provider"), "refused", F.coalesce("until", F.lit(0)).alias("until"))


@query("""
WITH n AS (SELECT o_custkey AS id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY ALL)
SELECT coalesce(c_custkey, id) AS id, coalesce(v, c_acctbal) AS value FROM customer FULL JOIN n ON n.id = c_custkey
""")
def upsert_sink(spark: SparkSession, d: str) -> DataFrame:
    """A table of values that a stream of changes is merged into, and every batch once more."""
    held = sinks.MergedTable.create(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), "upsert-sink", "id")
    changes = table_stream(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")

    def change(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            held.upsert(batch, number, [F.desc("o_orderdate"), F.desc("o_orderkey")])

    sinks.merge_stream(changes, change, fresh_path(spark, "upsert-sink-checkpoint"))
    return held.rows()


@query("""
WITH old AS (SELECT o_custkey AS owner, o_orderkey AS item FROM orders), new AS (SELECT c_custkey AS owner, c_nationkey AS item, c_mktsegment <> 'BUILDING' AS present FROM customer WHERE c_custkey % 3 = 0)
SELECT owner, item FROM old WHERE owner NOT IN (SELECT owner FROM new) UNION ALL SELECT owner, item FROM new WHERE present
""")
def replaced_sink(spark: SparkSession, d: str) -> DataFrame:
    """Sets of items whose owners get new ones from a stream, some of them none at all; every batch once more."""
    held = sinks.MergedTable.create(table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item")), "replaced-sink", "owner")
    changes = table_stream(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").cast("long").alias("item"), (F.col("c_mktsegment") != "BUILDING").alias("present"))

    def change(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            held.replace(batch, number, "present")

    sinks.merge_stream(changes, change, fresh_path(spark, "replaced-sink-checkpoint"))
    return held.rows()


@query("""
WITH g AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (4, 9)),
l AS (SELECT 'customer' AS name, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders UNION ALL SELECT 'events', user_id FROM events)
SELECT name, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM l WHERE id NOT IN (SELECT id FROM g) GROUP BY name
""")
def deleted_sink(spark: SparkSession, d: str) -> DataFrame:
    """Parents that a stream deletes, and their children in other tables with them; every batch once more."""
    sources = [("orders", "o_custkey"), ("events", "user_id"), ("customer", "c_custkey")]
    tables = [sinks.MergedTable.create(table(spark, d, name).select(F.col(key).cast("long").alias("id")), f"deleted-{name}", "id") for name, key in sources]
    gone = table_stream(spark, d, "customer").where("c_nationkey IN (4, 9)").select(F.col("c_custkey").cast("long").alias("id"))

    def change(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            sinks.delete_cascade(tables, batch, number)

    sinks.merge_stream(gone, change, fresh_path(spark, "deleted-checkpoint"))
    counts = [t.rows().agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id").alias("total")) for t, (name, _) in zip(tables, sources, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
