"""The registered queries: each maps given tables to an operator's native columns and calls it; with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwright.functions import exprs as ex
from markwright.functions import text as tx
from markwright.functions import sequences, udfs
from markwright.operators import analytics, corpus, matching, relational, review, vectors
from markwright.sources import readers
from markwright.sources.readers import table
from markwright.sources.written import spread
from markwright.streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def _status():
    return F.when(F.col("o_orderstatus") == "O", "needs_review").when(F.col("o_orderstatus") == "F", "approved").otherwise("ocr_failed")


def _confidence():
    return F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_totalprice") / 500000)


@query("""
WITH m AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'r' WHEN 'F' THEN 'a' ELSE 'x' END AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 500000 END AS c FROM orders),
d AS (SELECT o_custkey FROM m GROUP BY o_custkey HAVING bool_and(s = 'a'))
SELECT count(*) FILTER (s = 'r' AND (c IS NULL OR c < 0.5)) AS low_confidence, count(*) FILTER (s = 'r' AND c >= 0.5) AS ready_bulk,
       count(*) FILTER (s = 'r' AND c < 0.5) AS below_threshold, count(*) FILTER (s = 'x') AS ocr_failed, count(*) FILTER (s = 'a') AS reviewed, count(*) AS total,
       (SELECT count(*) FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM d)) AS reviewed_unreleased FROM m
""")
def action_queue(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "orders").select(F.col("o_custkey").alias("submission_id"), _status().alias("status"), _confidence().alias("confidence"))
    subs = table(spark, d, "customer").select(F.col("c_custkey").alias("submission_id"), F.when(F.col("c_acctbal") < 0, F.lit("released")).alias("released_at"))
    return analytics.action_queue(marks, subs, 0.5)


def _line_marks(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    return line.withColumn("available", F.col("l_quantity")).withColumn("earned", F.col("l_quantity") * (1 - F.col("l_discount")))


@query("""
SELECT p_type AS topic, CAST(CASE WHEN sum(l_quantity) > 0 THEN floor(sum(l_quantity * (1 - l_discount)) / sum(l_quantity) * 100 + 0.5) ELSE 0 END AS BIGINT) AS mastery, count(*) AS n_marks
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
""")
def mastery_by_topic(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("topic"))
    return analytics.mastery(_line_marks(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")))


TOPICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_CELL = ", ".join(f"max(CASE WHEN o_orderpriority = '{t}' THEN c END) AS t{i + 1}" for i, t in enumerate(TOPICS))
_AVG = ", ".join(f"CAST(floor(avg(t{i + 1}) + 0.5) AS BIGINT) AS t{i + 1}" for i in range(5))


@query(f"""
WITH c AS (SELECT c_nationkey, o_orderpriority, CAST(CASE WHEN sum(o_totalprice) > 0 THEN floor(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) * 100 + 0.5) END AS BIGINT) AS c
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT CAST(c_nationkey AS VARCHAR) AS student, {_CELL} FROM c GROUP BY c_nationkey)
SELECT * FROM w UNION ALL SELECT 'average', {_AVG} FROM w
""")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("available"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("earned"))
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("student"))
    return analytics.heatmap(orders.join(people, F.col("o_custkey") == F.col("c_custkey")))


@query("""
SELECT question, CAST(CASE WHEN a > 0 THEN (200 * e + a) // (2 * a) ELSE 0 END AS BIGINT) AS pct, answers
FROM (SELECT l_partkey AS question, sum(CAST(round(l_quantity * (1 - l_discount) * 1000000) AS BIGINT)) AS e, sum(CAST(round(l_quantity * 1000000) AS BIGINT)) AS a, count(*) AS answers FROM lineitem GROUP BY l_partkey)
""")
def difficulty(spark: SparkSession, d: str) -> DataFrame:
    return analytics.difficulty(_line_marks(spark, d).withColumnRenamed("l_partkey", "question"))


@query("""
WITH s AS (SELECT o_orderkey, c_nationkey AS class_id, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'submitted' WHEN o_orderstatus = 'O' THEN 'late' ELSE 'open' END AS st, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT class_id, CAST(floor(avg((o_totalprice / 2) / o_totalprice * (o_orderkey % 7) / 7.0) * 100 + 0.5) AS BIGINT) AS avg_pct FROM s WHERE st <> 'open' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 0 GROUP BY class_id),
t AS (SELECT class_id, p_type AS topic, CAST(floor(sum(l_quantity * (1 - l_discount)) / sum(l_quantity) * 100 + 0.5) AS BIGINT) AS m FROM s JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE st <> 'open' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY m, topic) AS r FROM t)
SELECT class_id, avg_pct, string_agg(topic, '; ' ORDER BY r) FILTER (r <= 3) AS weakest, count(*) AS topics FROM r LEFT JOIN a USING (class_id) GROUP BY class_id, avg_pct
""")
def class_pulse(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("class_id"))
    state = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "late").otherwise("open")
    score = F.col("o_totalprice") / 2 * (F.col("o_orderkey") % 7) / 7.0
    subs = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("submission_id"), "class_id", state.alias("status"), F.col("o_orderdate").alias("submitted_at"), score.alias("total_score"), F.col("o_totalprice").alias("total_marks"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("topic"))
    marks = _line_marks(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("submission_id"), "topic", "earned", "available")
    return analytics.class_pulse(subs, marks, _ntz("1998-01-31 00:00:00"))


@query("""
WITH h AS (SELECT o_custkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT c_custkey AS student, count(DISTINCT CASE WHEN o_orderpriority < '5' THEN o_orderpriority END) AS got, max(o_orderdate) AS last_at FROM customer LEFT JOIN h ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT student, CAST(4 - got AS BIGINT) AS missed, CASE WHEN 4 - got >= 2 THEN 'Missed ' || (4 - got) || ' assignments' ELSE 'No practice in 90+ days' END AS reason
FROM g WHERE 4 - got >= 2 OR last_at IS NULL OR last_at < TIMESTAMP '1998-05-03'
""")
def needs_attention(spark: SparkSession, d: str) -> DataFrame:
    students = table(spark, d, "customer").select(F.col("c_custkey").alias("student"))
    orders = table(spark, d, "orders")
    deadline = F.when(F.col("assignment_id") < "5", _ntz("1998-06-01 00:00:00")).otherwise(_ntz("1999-01-01 00:00:00"))
    assignments = orders.select(F.col("o_orderpriority").alias("assignment_id")).distinct().withColumn("deadline_at", deadline)
    subs = orders.select(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("assignment_id"), F.when(F.col("o_orderstatus") == "F", "submitted").otherwise("open").alias("status"), F.col("o_orderdate").alias("submitted_at"))
    return analytics.needs_attention(students, assignments, subs, _ntz("1998-08-01 00:00:00"), days=90)


BOUNDARIES = [("A", 95), ("B", 94), ("C", 93), ("D", 92), ("E", 90)]


@query("""
WITH b(grade, lim) AS (VALUES ('A', 95), ('B', 94), ('C', 93), ('D', 92), ('E', 90)),
r AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) AS ratio FROM lineitem GROUP BY l_orderkey HAVING sum(l_extendedprice) > 0),
s AS (SELECT o_custkey AS student, count(*) AS done, count(DISTINCT o_orderpriority) AS topics, CAST(floor(avg(ratio) * 100 + 0.5) AS BIGINT) AS rolling FROM orders JOIN r ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING count(*) >= 4 AND count(DISTINCT o_orderpriority) >= 3)
SELECT student, done, topics, rolling, coalesce((SELECT arg_max(grade, lim) FROM b WHERE lim <= rolling), 'E') AS grade, CAST((SELECT min(lim) FROM b WHERE lim > rolling) - rolling AS BIGINT) AS to_next FROM s
""")
def predicted_grade(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ratio.alias("ratio"), F.sum("l_extendedprice").alias("t")).where("t > 0")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("topic"))
    rows = spark.createDataFrame(BOUNDARIES, "grade string, min_percent long")
    return analytics.predicted_grade(orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey")), rows)


@query("""
SELECT c_nationkey AS queue, o_orderkey AS mark_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 500000 END NULLS FIRST, o_orderkey) AS place
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("queue"))
    marks = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("mark_id"), _confidence().alias("confidence"))
    rows = analytics.review_queue(marks.join(people, F.col("o_custkey") == F.col("c_custkey")), "queue")
    return rows.select("queue", "mark_id", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey AS student, o_orderpriority AS assignment_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS submission_id FROM orders GROUP BY ALL")
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    subs = table(spark, d, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("assignment_id"), F.col("o_orderdate").alias("attempt"), F.col("o_orderkey").alias("submission_id"))
    return analytics.latest_attempt(subs, ["student", "assignment_id"]).drop("attempt")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number,
       CASE WHEN row_number() OVER (PARTITION BY l_orderkey || '-' || l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) > 1
            THEN l_orderkey || '-' || l_linenumber || '-part-' || row_number() OVER (PARTITION BY l_orderkey || '-' || l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
            ELSE l_orderkey || '-' || l_linenumber END AS unique_id FROM l
""")
def renumber_groups(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    rows = relational.renumber(line, ["l_orderkey"], order, "id")
    return rows.select("l_orderkey", "l_partkey", "l_extendedprice", F.col("number").cast("long").alias("number"), "unique_id")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN CASE WHEN c_nationkey < 12 THEN 'missed' ELSE 'not_started' END WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'returned'
  WHEN o_orderdate > (CASE WHEN c_nationkey < 12 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1999-01-01' END) THEN 'late' ELSE 'submitted' END AS state FROM customer LEFT JOIN l ON o_custkey = c_custkey AND r = 1) GROUP BY state
""")
def status_board(spark: SparkSession, d: str) -> DataFrame:
    base, longer = _ntz("1998-01-01 00:00:00"), F.when(F.col("c_nationkey") >= 12, _ntz("1999-01-01 00:00:00"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("student"), ex.effective_deadline(base, longer).alias("deadline_at"))
    released = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), F.col("o_orderdate"))
    subs = table(spark, d, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("submission_id"), F.col("o_orderdate").alias("attempt"), F.col("o_orderdate").alias("submitted_at"), released.alias("released_at"))
    return analytics.status_board(people, subs, _ntz("1998-08-01 00:00:00")).groupBy("state").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT l_suppkey AS owner, p_brand AS topic, l_discount < 0.05 AS awarded, p_type AS mistake, l_orderkey * 100 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT owner, topic, mistake, min(seq) AS seq FROM c WHERE NOT awarded GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, topic ORDER BY seq, mistake) AS r FROM f),
m AS (SELECT owner, topic, string_agg(mistake, '; ' ORDER BY r) AS mistakes FROM k WHERE r <= 4 GROUP BY ALL),
n AS (SELECT owner, topic, count(*) FILTER (NOT awarded) AS missed, count(*) AS total, CAST(floor(count(*) FILTER (awarded) / count(*) * 100 + 0.5) AS BIGINT) AS accuracy FROM c GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY missed DESC, topic) AS place FROM n WHERE missed > 0)
SELECT owner, topic, missed, total, accuracy, place, mistakes FROM p JOIN m USING (owner, topic) WHERE place <= 6
""")
def weak_spots(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    rows = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    criteria = rows.select(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("topic"), (F.col("l_discount") < 0.05).alias("awarded"), F.col("p_type").alias("mistake"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return analytics.weak_spots(criteria).withColumn("place", F.col("place").cast("long"))


@query("""
WITH e AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events)
SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND a.e > b.s
""")
def interval_conflicts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("e"))
    return relational.interval_conflicts(events, "user_id", "event_id", "s", "e")


@query("""
SELECT l.event_id, l.user_id, max(r.ts) AS purchase_ts FROM (SELECT * FROM events WHERE event_type = 'error') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND r.ts <= l.ts GROUP BY l.event_id, l.user_id
""")
def asof_page(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("ts").alias("purchase_ts"))
    return relational.as_of(left, right, "user_id", "ts", "at", "purchase_ts").select("event_id", "user_id", "purchase_ts")


@query("""
SELECT id, max(owned) AS owned FROM (SELECT c_custkey AS id, 1 AS owned FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY id
""")
def owned_or_shared(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer")
    own = people.where("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.lit(1).alias("owned"))
    shared = people.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(0).alias("owned"))
    return relational.union_by_id(own, shared, "id")


@query("""
WITH g AS (SELECT s_suppkey AS teacher, CASE s_suppkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [n_name] WHEN 2 THEN [substr(n_name, 2, 3), lower(r_name)] ELSE [p_name] END AS scope, s_acctbal > 0 AS can_view, s_suppkey % 3 = 0 AS can_edit
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = s_suppkey),
c AS (SELECT p_name AS area, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment)
SELECT area, count(*) AS n_grants, bool_or(can_view) AS can_view, bool_or(can_edit) AS can_edit, any_value(n) AS students
FROM c JOIN g ON len(scope) = 0 OR list_contains(list_transform(scope, lambda s: contains(lower(s), lower(area)) OR contains(lower(area), lower(s))), true) GROUP BY area
""")
def accessible_grants(spark: SparkSession, d: str) -> DataFrame:
    """Areas with the grants that cover them: by whole names, by parts of names, and by none, which stands for all."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    k = F.col("s_suppkey") % 4
    own = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("n_name")).when(k == 2, F.array(F.substring("n_name", 2, 3), F.lower("r_name"))).otherwise(F.array("p_name"))
    grants = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"), "left").select(own.alias("scope"), (F.col("s_acctbal") > 0).alias("can_view"), (F.col("s_suppkey") % 3 == 0).alias("can_edit"))
    customers = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    counted = lambda rows, name: rows.groupBy(F.col(name).alias("area")).agg(F.count("*").alias("students"))
    areas = counted(table(spark, d, "part"), "p_name").unionByName(counted(customers, "n_name")).unionByName(counted(customers, "c_mktsegment"))
    return review.granted(areas, grants, "area")


@query("""
WITH q AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem WHERE l_returnflag <> 'N'),
e AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem WHERE l_linestatus = 'F'),
p AS (SELECT coalesce(q.k, e.k) AS k, q.k IS NOT NULL AS l, e.k IS NOT NULL AS rr FROM q FULL JOIN e ON q.k = e.k AND q.n = e.n AND q.r = e.r),
s AS (SELECT k AS paper, count(*) FILTER (l AND rr) AS matched, count(*) FILTER (l) AS n_left, count(*) FILTER (rr) AS n_right FROM p GROUP BY k),
c AS (SELECT *, round(matched / greatest(n_left, 1), 4) AS left_coverage, round(matched / greatest(n_right, 1), 4) AS right_coverage, round(matched / greatest(n_left, n_right, 1), 4) AS balanced FROM s)
SELECT paper, matched, n_left, n_right, left_coverage, right_coverage, balanced, CASE WHEN matched = 0 THEN 'failed' WHEN left_coverage >= 0.9 AND right_coverage >= 0.9 THEN 'accepted' ELSE 'review_required' END AS status,
  coalesce(concat_ws(',', CASE WHEN matched = 0 THEN 'no_pairs' END, CASE WHEN left_coverage < 0.9 THEN 'left_uncovered' END, CASE WHEN right_coverage < 0.9 THEN 'right_uncovered' END), '') AS reasons FROM c
""")
def pairing_quality(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    side = lambda cond, name: line.where(cond).select(F.col("l_orderkey").alias("paper"), "l_linenumber", nth.alias("pos"), F.lit(1).alias(name))
    pairs = relational.pair_once(side("l_returnflag <> 'N'", "q"), side("l_linestatus = 'F'", "e"), ["paper", "l_linenumber"], "pos")
    return relational.pairing_quality(pairs, "paper", "q", "e")


@query("""
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN x < 0.02 THEN '0.00-0.02' WHEN x < 0.05 THEN '0.02-0.05' WHEN x < 0.1 THEN '0.05-0.10' WHEN x < 0.15 THEN '0.10-0.15' ELSE '0.15+' END AS bin FROM (SELECT l_discount + l_tax AS x FROM lineitem)) GROUP BY bin
""")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("x"))
    return analytics.histogram(rows, "x", [0.0, 0.02, 0.05, 0.1, 0.15])


#: the normaliser and its tokens in DuckDB
_N = f"trim(regexp_replace(lower(replace(translate(coalesce({{0}}, ''), '{tx.SUPERSCRIPTS + tx.SUBSCRIPTS + tx.SIGNS}', '{tx.DIGITS * 2 + tx.SIGNS_TO}'), '→', '->')), '[^a-z0-9]+', ' ', 'g'))"
_T = "list_filter(string_split(" + _N + ", ' '), lambda x: x <> '')"
_PAIRS = f"""q AS (SELECT doc_id AS q, t, len(t) AS n_q FROM (SELECT doc_id, list_distinct({_T.format("text")}) AS t FROM documents)),
r AS (SELECT item_id AS r, t, len(t) AS n_r FROM (SELECT item_id, list_distinct({_T.format("text")}) AS t FROM benchmark)),
p AS (SELECT q, r, n_q, n_r, count(*) AS shared FROM (SELECT q, n_q, unnest(t) AS k FROM q) JOIN (SELECT r, n_r, unnest(t) AS k FROM r) USING (k) GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT q AS doc_id, r AS item_id, score FROM (SELECT *, round(shared / (n_q + n_r - shared), 4) AS score, row_number() OVER (PARTITION BY q ORDER BY round(shared / (n_q + n_r - shared), 4) DESC, r) AS k FROM p) WHERE k = 1")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    best = matching.best_jaccard(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "item_id")
    return best.select(F.col("q").alias("doc_id"), F.col("r").alias("item_id"), "score")


@query(f"""WITH {_PAIRS}, s AS (SELECT *, shared / n_q AS o, shared / (n_q + n_r - shared) AS j FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o DESC, r DESC) AS k FROM s),
g AS (SELECT q, r, round(least(1.0, 0.75 * o + 0.20 * j), 4) AS score FROM f WHERE k <= 10), h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r DESC) AS place FROM g)
SELECT q AS doc_id, r AS item_id, score, place FROM h WHERE place <= 4""")
def match_rerank(spark: SparkSession, d: str) -> DataFrame:
    pairs = matching.ranked_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "item_id", 10, "overlap", larger_id=True)
    return matching.two_stage(pairs).select(F.col("q").alias("doc_id"), F.col("r").alias("item_id"), "score", F.col("place").cast("long").alias("place"))


@query(f"""
WITH t AS (SELECT doc_id, sha256(k) AS h FROM (SELECT doc_id, unnest({_T.format("text")}) AS k FROM documents)),
r AS (SELECT doc_id, CAST(CAST(concat('0x', substr(h, 1, 8)) AS UBIGINT) % 384 AS INTEGER) AS slot, sum(CASE WHEN CAST(concat('0x', substr(h, 9, 2)) AS UBIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS raw FROM t GROUP BY ALL HAVING raw <> 0)
SELECT doc_id, slot, round(raw / sqrt(sum(CAST(raw * raw AS DOUBLE)) OVER (PARTITION BY doc_id)), 6) AS value FROM r
""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return matching.hash_embedding(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q, vec_id AS r, round(least(1.0, greatest(0.0, (list_dot_product(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + 1) / 2)), 4) AS score FROM q JOIN embeddings ON vec_id <> q)
SELECT q, r, score, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS place FROM s) WHERE place <= 50
""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return vectors.top_k(asked, rows.select(F.col("vec_id").alias("r"), F.col("embedding").alias("rv")), 50).withColumn("place", F.col("place").cast("long"))


@query(f"""
WITH {_PAIRS}, s AS (SELECT q, r, round(shared / (n_q + n_r - shared), 4) AS score FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, q) AS n FROM s),
w AS (SELECT item_id, {_N.format("text")} AS head FROM benchmark), x AS (SELECT item_id, doc_id FROM w, (SELECT doc_id, ' ' || {_N.format("text")} || ' ' AS body FROM documents) WHERE head <> '' AND contains(body, ' ' || head || ' ')),
v AS (SELECT item_id AS q, doc_id AS r, true AS verified, 1.0 AS score FROM x UNION ALL SELECT k.r, k.q, false, k.score FROM k LEFT JOIN x ON x.item_id = k.r AND x.doc_id = k.q WHERE n <= 8 AND x.doc_id IS NULL),
c AS (SELECT *, count(*) FILTER (verified) OVER (PARTITION BY q) AS nv, row_number() OVER (PARTITION BY q, verified ORDER BY score DESC, r) AS pl FROM v)
SELECT q, r, verified, CAST(score AS DOUBLE) AS score FROM c WHERE verified OR pl <= greatest(0, 8 - nv)
""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs, items = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark")
    near = matching.ranked_docs(docs, items, "item_id", "doc_id", 8)
    return matching.hybrid_search(near, matching.exact_hits(docs, items, "item_id", "doc_id"), 8)


@query(f"""
SELECT sha1('document||' || {_N.format("text")}) AS group_key, count(*) AS n, arg_max(doc_id, (length(text), -doc_id)) AS kept_id, min(doc_id) AS first_id FROM documents GROUP BY 1
""")
def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dedup_groups(table(spark, d, "documents").select("doc_id", "text"))


@query("""
WITH t AS (SELECT doc_id, 'Subject: ' || lang || chr(10) || 'Source: ' || source AS h, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS a, substr(text, CAST(length(text) // 2 + 1 AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, h || chr(10) || 'Question: ' || a || chr(10) || 'Mark Scheme: ' || b AS w, h || chr(10) || 'Question: ' || a AS x, h || chr(10) || 'Mark Scheme: ' || b AS y FROM t),
o AS (SELECT doc_id, doc_id * 2 AS chunk_index, CASE WHEN length(w) <= 1600 THEN w ELSE x END AS content FROM c UNION ALL SELECT doc_id, doc_id * 2 + 1, CASE WHEN length(y) > 1600 THEN substr(y, 1, 1580) || '... [truncated]' ELSE y END FROM c WHERE length(w) > 1600)
SELECT doc_id, chunk_index, CAST(length(content) AS INTEGER) AS n_chars, sha256(content) AS content_hash FROM o
""")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Subject: "), "lang", F.lit("\nSource: "), "source").alias("h"), F.substr("text", F.lit(1), half).alias("a"), F.substr("text", half + 1).alias("b"))
    rows = corpus.chunk_budget(docs, F.col("h"), F.col("a"), F.col("b"), F.col("doc_id"))
    return rows.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), "content_hash")


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
k AS (SELECT doc_id, w, [w[i] FOR i IN range(1, len(w) + 1) IF NOT regexp_full_match(w[i], '(?i)\s*(©\s*ucles\s*\d{4}|\d{4}/\d{2}/[a-z]/[a-z]/\d{2}|\[turn over\]?|please turn over|this document has \d+ pages.*)\s*') AND NOT (i = 1 AND regexp_full_match(w[i], '\s*\d+\s*'))] AS g FROM l)
SELECT doc_id, CAST(len(w) AS BIGINT) AS lines, CAST(len(w) - len(g) AS BIGINT) AS dropped, md5(array_to_string(g, chr(10))) AS kept_md5 FROM k
""")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.noise_lines(table(spark, d, "documents").select("doc_id", "text"))


@query(r"""
SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang,
       TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS INTEGER) AS number, contains(url, '?') AS has_query, contains(url, '#') AS has_fragment, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages
""")
def html_metadata(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+/([a-z]{2})/", 1).alias("lang"),
        F.regexp_extract(url, r"/([0-9]+)(?:[?#].*)?$", 1).try_cast("int").alias("number"), url.contains("?").alias("has_query"), url.contains("#").alias("has_fragment"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


def _coverage_sql(at: str, most: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
    tok = lambda x: f"list_filter(list_distinct({_T.format(x)}), lambda z: NOT list_contains({stop}, z))"
    return f"""
WITH t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS scheme, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
a AS (SELECT conv_id, turn, answer, scheme FROM t WHERE role = 'assistant' AND before = 'user'),
p AS (SELECT *, list_filter(list_transform(string_split_regex(scheme, '[\\n.;:]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 4) AS ps FROM a),
w AS (SELECT conv_id, turn, answer, (CASE WHEN len(ps) > 0 THEN ps WHEN trim(scheme) <> '' THEN [trim(scheme)] ELSE [] END){most} AS ps FROM p),
u AS (SELECT conv_id, turn, {tok("answer")} AS said, unnest(ps) AS pt FROM w), v AS (SELECT conv_id, turn, said, {tok("pt")} AS want FROM u),
x AS (SELECT conv_id, turn, CASE WHEN len(want) = 0 THEN 0.0 ELSE len(list_intersect(want, said)) / len(want) END AS share, len(list_intersect(want, said)) AS shared FROM v),
s AS (SELECT conv_id, turn, count(*) FILTER ({at}) AS hit FROM x GROUP BY ALL), f AS (SELECT conv_id, turn, len(ps) AS points, CASE WHEN len(ps) = 0 THEN 0.0 ELSE round(coalesce(hit, 0) / len(ps), 4) END AS score FROM w LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, turn, CAST(points AS INTEGER) AS points, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'fully_correct' WHEN score >= 0.45 THEN 'partially_correct' ELSE 'weak' END AS label FROM f
"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("scheme", F.lag("text").over(order)).withColumn("before", F.lag("role").over(order))
    return rows.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", F.col("text").alias("answer"), "scheme")


@query(_coverage_sql("share >= 0.4 OR shared >= 2", ""))
def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    return matching.point_coverage(_answers(spark, d), 0.4, 2, None).select("conv_id", "turn", "points", "score", "label")


@query(_coverage_sql("share >= 0.5", "[1:10]"))
def point_coverage_strict(spark: SparkSession, d: str) -> DataFrame:
    return matching.point_coverage(_answers(spark, d), 0.5, None, 10).select("conv_id", "turn", "points", "score", "label")


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, ['Chemistry', 'Mathematics', 'Physics', 'History'][doc_id % 4 + 1] AS subject FROM documents),
s AS (SELECT *, regexp_matches(x, '(?i)\b(?:[A-Z][a-z]?\d+|[A-Z][a-z]?[+-]|\d+(?:cm|mm|km|kg|g|mol|m/s|ms|s|N|J|W|Pa|V|A)\b)') AS sci FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)\b(?:option|choose|which of the following|[ABCD][.)])\b') THEN 'mcq_structured' WHEN sci AND subject IN ('Chemistry', 'Physics') THEN 'science_notation'
  WHEN regexp_matches(x, '(?i)(?:=|\^|\bsqrt\b|\blog\b|\bsin\b|\bcos\b|\btan\b|\bln\b|[+\-*/()])') THEN CASE WHEN sci AND NOT regexp_matches(x, '(?i)log|sqrt|sin|cos|tan') THEN 'science_notation' ELSE 'symbolic' END
  WHEN sci THEN 'science_notation' WHEN len(regexp_extract_all(x, '[A-Za-z]{4,}')) >= 6 OR len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 8 THEN 'prose'
  WHEN regexp_matches(x, '\b[ABCD]\b') THEN 'mcq_structured' ELSE 'prose' END AS kind FROM s)
SELECT doc_id, kind, CASE WHEN kind = 'science_notation' THEN 'science_formula_units' WHEN kind IN ('prose', 'mcq_structured') THEN 'prose_or_structured' WHEN regexp_matches(x, '(?i)(^|[^A-Za-z])(?:log|ln)') THEN 'logarithmic'
  WHEN regexp_matches(x, '(?i)\b(?:f|g|h|fg|gf)\s*\(') THEN 'function_expression' WHEN regexp_matches(x, '[=+\-*/^]') THEN 'generic_equation' WHEN sci THEN 'science_formula_units' WHEN regexp_matches(lower(x), '[xyz]') THEN 'generic_equation' ELSE 'prose_or_structured' END AS family FROM k
""")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    subject = F.element_at(F.array(*map(F.lit, ("Chemistry", "Mathematics", "Physics", "History"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("x"), subject.alias("subject"))
    rows = docs.withColumn("kind", tx.content_type(F.col("x"), None, F.col("subject")))
    return rows.select("doc_id", "kind", tx.question_family(F.col("x"), F.col("kind")).alias("family"))


@query(r"""
WITH t AS (SELECT doc_id, trim(text, chr(10) || chr(9) || ' ') AS w, split_part(text, chr(10), 1) AS q, substr(text, length(split_part(text, chr(10), 1)) + 2) AS a, ['mathematics', 'chemistry', 'physics', 'biology', 'english'][doc_id % 5 + 1] AS subject,
  0.8 + (doc_id % 20) / 100.0 AS ocr, 0.85 + (doc_id % 13) / 100.0 AS split, 0.75 + (doc_id % 11) / 100.0 AS kind FROM documents),
c AS (SELECT *, trim(regexp_replace(lower(q), '\s+', ' ', 'g')) AS cq, trim(regexp_replace(lower(a), '\s+', ' ', 'g')) AS ca FROM t),
m AS (SELECT *, subject = 'mathematics' OR regexp_matches(w || ' ' || q || ' ' || a, '(?i)(log|=|\^|sqrt|sin|cos|tan|integral|fraction|/)') AS math,
  list_distinct(list_transform(regexp_extract_all(q, '(?i)log\s*_\s*([A-Za-z0-9]+)', 1) || regexp_extract_all(q, '(?i)\blog([A-Za-z0-9])[A-Za-z(]', 1) || regexp_extract_all(q, '(?i)\blog([0-9]+)\b', 1), lambda x: lower(x))) AS bq,
  list_distinct(list_transform(regexp_extract_all(a, '(?i)log\s*_\s*([A-Za-z0-9]+)', 1) || regexp_extract_all(a, '(?i)\blog([A-Za-z0-9])[A-Za-z(]', 1) || regexp_extract_all(a, '(?i)\blog([0-9]+)\b', 1), lambda x: lower(x))) AS ba FROM c),
f AS (SELECT doc_id, ocr, split, kind, list_filter([CASE WHEN cq = '' THEN 'missing_question' END, CASE WHEN ca = '' THEN 'missing_answer' END,
  CASE WHEN cq <> '' AND ca <> '' AND (cq = ca OR (length(cq) >= 20 AND contains(ca, cq)) OR (length(ca) >= 20 AND contains(cq, ca))) THEN 'question_answer_overlap' END,
  CASE WHEN ocr < 0.85 THEN 'low_ocr_confidence' END, CASE WHEN split < 0.90 THEN 'low_split_confidence' END, CASE WHEN kind < 0.80 THEN 'low_classification_confidence' END,
  CASE WHEN math AND len(bq) > 0 AND len(ba) > 0 AND len(list_intersect(bq, ba)) = 0 THEN 'potential_log_base_mismatch' END,
  CASE WHEN math AND regexp_matches(w, '\blog[0-9A-Za-z]') THEN 'potential_subscript_loss' END, CASE WHEN math AND regexp_matches(w, '\b[a-zA-Z][0-9]\b') THEN 'potential_superscript_loss' END,
  CASE WHEN math AND (len(regexp_extract_all(w, '\(')) <> len(regexp_extract_all(w, '\)')) OR len(regexp_extract_all(w, '\[')) <> len(regexp_extract_all(w, '\]')) OR len(regexp_extract_all(w, '\{')) <> len(regexp_extract_all(w, '\}'))) THEN 'potential_equation_structure_loss' END,
  CASE WHEN math AND ((contains(w, '0') AND contains(w, 'O')) OR (contains(w, '1') AND regexp_matches(w, '[Il]'))) THEN 'potential_symbol_ambiguity' END,
  CASE WHEN math AND len(list_filter(string_split(a, chr(10)), lambda x: length(trim(x)) >= 24 AND len(regexp_extract_all(x, '=')) >= 2 AND NOT contains(x, '/') AND NOT contains(lower(x), '\frac') AND len(regexp_extract_all(x, '(?i)(?:^|[^\w.])log\s*[(_]|[0-9]log\s*\(|(?:^|[^\w.])ln\s*\(')) >= 3)) > 0 THEN 'potential_fraction_or_chain_ambiguity' END,
  CASE WHEN subject = 'chemistry' AND regexp_matches(w, '\b[A-Z][a-z]?[0O][A-Za-z0-9()]*\b') THEN 'potential_chemistry_formula_ambiguity' END,
  CASE WHEN subject = 'physics' AND regexp_matches(w, '\b\d+\s*(hz|pa|j|v|w|n|c)\b') THEN 'potential_physics_unit_ambiguity' END, CASE WHEN subject = 'biology' AND regexp_matches(w, '\b(dna|rna|atp)\b') THEN 'potential_biology_term_casing' END,
  CASE WHEN subject = 'english' AND (len(regexp_extract_all(w, '"')) % 2 <> 0 OR len(regexp_extract_all(w, chr(39))) % 2 <> 0) THEN 'potential_english_punctuation_loss' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT doc_id, array_to_string(f, ',') AS flags, round(least(ocr, split, kind), 4) AS overall,
  len(list_intersect(f, ['missing_question', 'missing_answer', 'question_answer_overlap'])) > 0 OR ocr < 0.85 OR split < 0.90 OR kind < 0.80 OR len(list_filter(f, lambda x: starts_with(x, 'potential_'))) > 0 AS needs_review FROM f
""")
def validation_flags(spark: SparkSession, d: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    subject = F.element_at(F.array(*map(F.lit, ("mathematics", "chemistry", "physics", "biology", "english"))), (F.col("doc_id") % 5 + 1).cast("int"))
    part = lambda base, n: F.lit(base) + F.col("doc_id") % n / 100.0
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("whole"), first.alias("question"), F.substr("text", F.length(first) + 2).alias("answer"), subject.alias("subject"), part(0.8, 20).alias("ocr"), part(0.85, 13).alias("split"), part(0.75, 11).alias("classification"))
    return corpus.validation_flags(docs).select("doc_id", F.array_join("flags", ",").alias("flags"), F.round("overall", 4).alias("overall"), "needs_review")


@query("""
WITH n AS (SELECT quality, CAST(greatest(1, ceil(count(*) * 0.1)) AS BIGINT) AS quota FROM labels GROUP BY quality),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|7'), doc_id) AS pick FROM labels) SELECT doc_id, quality, pick FROM r JOIN n USING (quality) WHERE pick <= quota
""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.seeded_sample(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.1, 7)
    return rows.select("doc_id", "quality", F.col("pick").cast("long").alias("pick"))


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT event_id, user_id, t, k, t AS opened, 1 AS n FROM o WHERE k = 1 UNION ALL
      SELECT o.event_id, o.user_id, o.t, o.k, CASE WHEN o.t >= f.opened + 86400000000 THEN o.t ELSE f.opened END, CASE WHEN o.t >= f.opened + 86400000000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT event_id, user_id, CAST(n AS INTEGER) AS n, n <= 2 AS allowed FROM f
""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 2)


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def idempotent_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = limits.upsert_latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id")
    return rows.select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_probe(spark: SparkSession, d: str) -> DataFrame:
    props = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(props, "$.missing", "bigint"), F.try_variant_get(props, "$.k", "bigint")).alias("k"))


@query("""
SELECT o_orderkey, concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), '"' || o_orderstatus || '"",' || o_orderpriority || '"') AS line
FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')
""")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where((F.col("o_orderdate") >= _ntz("1995-01-01 00:00:00")) & (F.col("o_orderdate") < _ntz("1997-01-01 00:00:00")))
    rows = rows.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("note", F.concat("o_orderstatus", F.lit('",'), "o_orderpriority"))
    return readers.csv_lines(rows, ["o_orderkey", "o_orderstatus", "o_orderpriority", "day", "note"]).select("o_orderkey", "line")


@query("""
SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, count(DISTINCT n_nationkey) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name
""")
def nested_catalog(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(people, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("r_name").agg(listed("n_name").alias("nations"), F.count_distinct("n_nationkey").alias("n"), listed("c_mktsegment").alias("segments"))


@query("""
SELECT doc_id, CAST(coalesce(m, 0) AS INTEGER) AS number, len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0 AS has_words, array_to_string(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')[1:7], ' ') AS preview, sha1(lower(substr(text, 1, 600)))[1:16] AS cache_key
FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(lower(text), '\\b(?:q(?:uestion)?\\s*)?(\\d{1,3})\\b', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 200)[1] AS m FROM documents)
""")
def text_hints(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.question_number(x), F.lit(0)).alias("number"), (F.size(F.filter(F.split(x, " "), lambda w: w != "")) > 0).alias("has_words"), tx.preview(x).alias("preview"), F.substring(F.sha1(F.lower(F.substring(x, 1, 600))), 1, 16).alias("cache_key"))


@query("""
SELECT o_orderpriority AS grp, CAST(count(*) FILTER (o_orderkey % 9 = 0) AS BIGINT) AS n_withheld, round(coalesce(sum(CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 0), 2) AS earned,
       round(sum(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice ELSE 0 END), 2) AS available, CASE WHEN sum(CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN 1.0 ELSE 0 END) < 0 THEN NULL ELSE 'U' END AS band, CAST(floor(sum(CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice ELSE 0 END) * 100 + 0.5) AS BIGINT) AS pct FROM orders GROUP BY o_orderpriority
""")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 9 == 0).alias("withheld"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("earned"), F.col("o_totalprice").alias("available"))
    return analytics.report_totals(rows, "grp").select("grp", "n_withheld", F.round("earned", 2).alias("earned"), F.round("available", 2).alias("available"), "pct", "band")


@query("""
SELECT o_custkey AS student, o_orderkey AS submission_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, CAST(floor((o_orderkey % 11) / 10.0 * 100 + 0.5) AS BIGINT) AS pct, o_orderpriority = '1-URGENT' AS is_full_paper FROM orders WHERE o_orderstatus <> 'P'
""")
def progress_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("submission_id"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("submitted").alias("status"), F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderkey") % 11).cast("double").alias("total_score"), F.lit(10.0).alias("total_marks"), (F.col("o_orderpriority") == "1-URGENT").alias("is_full_paper"))
    return analytics.progress_points(rows).withColumn("n", F.col("n").cast("long"))


@query("""
WITH t AS (SELECT l_suppkey AS owner, p_brand AS topic, round(sum(l_quantity * (1 - l_discount * 8)) / sum(l_quantity), 4) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY share DESC, topic) AS g, row_number() OVER (PARTITION BY owner ORDER BY share, topic) AS p FROM t)
SELECT owner, 'strong' AS kind, topic, share FROM r WHERE share >= 0.6 AND g <= 2 UNION ALL SELECT owner, 'weak', topic, share FROM r WHERE share < 0.6 AND p <= 2
""")
def strongest_weakest(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("topic"))
    rows = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("owner"), "topic")
    return analytics.strongest_and_weakest(rows.agg(F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount") * 8)) / F.sum("l_quantity"), 4).alias("share")), "owner")


@query("""
WITH g AS (SELECT o_orderkey AS paper, CAST(o_orderkey % 7 AS INTEGER) AS expected FROM orders), s AS (SELECT l_orderkey AS paper, list_sort(list(DISTINCT l_linenumber)) AS got FROM lineitem GROUP BY 1)
SELECT paper, array_to_string(list_filter(range(1, expected + 1), lambda x: NOT list_contains(got, x) AND x <> paper % 4), ',') AS missing, array_to_string(list_filter(got, lambda x: x > expected OR x = paper % 4), ',') AS extra FROM s JOIN g USING (paper)
""")
def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), (F.col("o_orderkey") % 7).cast("int").alias("expected"))
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_linenumber").join(want, "paper")
    discounted = F.array((F.col("paper") % 4).cast("int"))  # questions that were withdrawn
    rows = relational.missing_and_extra(seen, "paper", "l_linenumber", F.col("expected"), discounted)
    return rows.select("paper", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH s AS (SELECT o_custkey AS student, round(o_totalprice / 1000000, 4) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 1000000, 4) DESC) AS r FROM orders)
SELECT student, max(x) FILTER (r = 1) AS best, CASE WHEN count(*) FILTER (r = 2) = 0 THEN 1.0 ELSE round(max(x) FILTER (r = 1) - max(x) FILTER (r = 2), 4) END AS margin FROM s GROUP BY student
""")
def top_two_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("student"), F.round(F.col("o_totalprice") / 1000000, 4).alias("x"))
    return relational.top_two_margin(rows, "student", "x").withColumn("margin", F.round("margin", 4))


@query("""
WITH lines AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
g AS (SELECT doc_id, pos, line, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item FROM lines)
SELECT doc_id, CAST(item AS BIGINT) AS item, md5(string_agg(line, ' ' ORDER BY pos)) AS text_md5 FROM g WHERE item > 0 GROUP BY doc_id, item
""")
def line_items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return corpus.assemble_lines(lines, "doc_id", "at", F.col("line").rlike("^[A-M]")).select("doc_id", "item", F.md5("text").alias("text_md5"))


@query("""
SELECT c_custkey, CASE WHEN trim(c_name) <> '' AND lower(trim(c_name)) <> 'user' AND c_custkey % 3 <> 0 THEN trim(c_name) WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE 'Student' END AS name,
       (c_custkey % 5) = 0 AS valid_key, CASE WHEN lower(c_mktsegment) IN ('machinery') THEN NULL ELSE c_mktsegment END AS segment FROM customer
""")
def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.lit(" User ")).otherwise(F.col("c_name"))
    mail = F.when(key % 2 == 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org")))
    path = F.concat(F.lit("a|b|"), key.cast("string"), F.lit("|d|"), F.when(key % 5 == 0, "e").otherwise(" "))
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" N/A ")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", ex.display_name(name, mail, "Student").alias("name"), ex.is_paper_key(path).alias("valid_key"), ex.placeholder_to_null(segment).alias("segment"))


@query()
def sequence_match(spark: SparkSession, d: str) -> DataFrame:
    """Each asked question's best benchmark item by tokens, how alike the two read in sequence, and what the match is worth.

    Questions are short, so that the comparison in sequence is too; one item is compared for each.
    """
    asked = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    items = table(spark, d, "benchmark")
    best = matching.ranked_items(asked, items, "id", "item_id", 1, "jaccard").select(F.col("q").alias("id"), F.col("r").alias("item_id"), F.round(F.col("shared") / F.col("n_q"), 4).alias("overlap"))
    best = best.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "item_id"))).where("p = 1").drop("p")
    texts = best.join(asked, "id").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    ratio = F.round(sequences.sequence_ratio(tx.normalize(F.col("text")), tx.normalize(F.col("item"))), 4)
    rows = texts.select("id", "item_id", "overlap", ratio.alias("sequence"))
    score = F.round(matching.match_score(F.col("overlap"), F.col("sequence"), F.lit(0.0)), 4)
    return rows.withColumn("score", score).withColumn("status", ex.match_status(score))


@query()
def text_repair(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with compatibility forms composed and wrong decodings undone."""
    return table(spark, d, "documents").select("doc_id", F.md5(udfs.tidy_prose(udfs.repair_mojibake("text"))).alias("tidy_md5"))


# ---------------------------------------------------------------------------------------------------------
# Access, assignments, review actions


@query("""
WITH r AS (SELECT s_nationkey AS class_id, s_suppkey AS teacher, 0 AS rank, true AS g FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_nationkey, s_suppkey, 1, s_suppkey % 2 = 0 FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_nationkey, s_suppkey, 2, false FROM supplier WHERE s_suppkey % 5 = 0)
SELECT class_id, teacher, CASE min(rank) WHEN 0 THEN 'owner' WHEN 1 THEN 'co_teacher' ELSE 'granted' END AS role, arg_min(g, rank) AS can_grade FROM r GROUP BY ALL
""")
def access_roles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("class_id"), F.col("s_suppkey").alias("teacher"), "s_acctbal")
    owners = s.where("teacher % 3 = 0").select("class_id", F.col("teacher").alias("owner"))
    return review.access_roles(owners, s.where("s_acctbal > 0").withColumn("can_grade", F.col("teacher") % 2 == 0), s.where("teacher % 5 = 0"))


@query("""
WITH a AS (SELECT n_nationkey AS assignment_id, n_nationkey AS class_id, n_nationkey % 2 = 0 AS target_all FROM nation),
w AS (SELECT a.assignment_id, c_custkey AS student FROM a JOIN customer ON c_nationkey = class_id WHERE target_all AND c_acctbal >= 0 AND (c_custkey % 7 < 5 OR c_custkey % 11 = 0)),
s AS (SELECT a.assignment_id, c_custkey FROM a JOIN customer ON c_custkey % 25 = a.assignment_id WHERE NOT target_all) SELECT DISTINCT * FROM (SELECT * FROM w UNION ALL SELECT * FROM s)
""")
def targeted_students(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "nation").select(F.col("n_nationkey").alias("assignment_id"), F.col("n_nationkey").alias("class_id"), (F.col("n_nationkey") % 2 == 0).alias("target_all"), F.lit(5).alias("created_at"))
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("class_id"), F.col("c_custkey").alias("student"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("removed").alias("status"), (F.col("c_custkey") % 7 + 1).alias("joined_at"), (F.col("c_custkey") % 11 == 0).alias("started"))
    some = table(spark, d, "customer").select((F.col("c_custkey") % 25).cast("int").alias("assignment_id"), F.col("c_custkey").alias("student"))
    return review.targeted_students(work, people, some)


@query("""
WITH c AS (SELECT o_orderpriority || o_custkey AS k, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS submitted, count(*) FILTER (o_orderstatus = 'O') AS late, count(*) AS total FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS class_id, o_orderpriority || o_custkey AS assignment_id, o_orderpriority < '3' AS whole, max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END) AS dl FROM orders GROUP BY ALL),
n AS (SELECT user_id % 150 AS class_id, count(DISTINCT user_id) AS n_active FROM events GROUP BY ALL)
SELECT class_id, assignment_id, place, submitted, late, CASE WHEN whole THEN coalesce(n_active, 0) ELSE total END AS total FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY dl DESC NULLS LAST, assignment_id) AS place FROM a) JOIN c ON k = assignment_id LEFT JOIN n USING (class_id) WHERE place <= 3
""")
def active_assignments(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("assignment_id", F.concat("o_orderpriority", F.col("o_custkey").cast("string")))
    due = F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")))
    work = orders.groupBy(F.col("o_custkey").alias("class_id"), "assignment_id", (F.col("o_orderpriority") < "3").alias("target_all")).agg(due.alias("deadline_at"))
    subs = orders.select("assignment_id", F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "late").otherwise("open").alias("status"))
    active = table(spark, d, "events").groupBy((F.col("user_id") % 150).alias("class_id")).agg(F.count_distinct("user_id").alias("n_active"))
    return review.active_assignments(work, subs, active, 3).withColumn("place", F.col("place").cast("long"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN o_orderpriority END AS remark FROM orders
""")
def visible_results(spark: SparkSession, d: str) -> DataFrame:
    show = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderkey") % 2 == 0)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("remark"), (F.col("o_orderstatus") != "P").alias("show_score"), show.alias("show_remark"))
    return review.visible_result(rows, {"score": "show_score", "remark": "show_remark"}).select("id", "score", "remark")


@query("""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type || (event_id % 50) ORDER BY ts DESC, event_id DESC) AS k FROM events), r AS (SELECT user_id, event_type || (event_id % 50) AS item, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM u WHERE k = 1)
SELECT user_id, item, event_id, place FROM r WHERE place <= 30
""")
def newest_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", (F.col("event_id") % 50).cast("string")).alias("item"), F.struct("ts", "event_id").alias("at"))
    return review.newest(rows, "user_id", "at", "item", 30).select("user_id", "item", "event_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'kept' WHEN l_returnflag = first_value(l_returnflag) OVER w THEN 'duplicate' ELSE 'conflict' END AS kind FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 1000 + l_suppkey, l_returnflag)) GROUP BY kind
""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.struct((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("a"), "l_returnflag").alias("seq"), "l_returnflag")
    return review.first_wins(line, "key", "seq", "l_returnflag").groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT l_orderkey AS paper, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber END AS n FROM lineitem),
s AS (SELECT paper, count(DISTINCT CASE WHEN n BETWEEN 1 AND 5 THEN n END) AS u, count(*) FILTER (n BETWEEN 1 AND 5) AS i, count(*) FILTER (n IS NULL) AS bad, count(*) FILTER (n NOT BETWEEN 1 AND 5) AS o FROM l GROUP BY paper)
SELECT paper, u AS found, CAST(greatest(0, 5 - u) AS BIGINT) AS missing, CAST(u * 10 - greatest(0, 5 - u) * 10 - (bad + o) * 8 - (i - u) * 6 AS BIGINT) AS score FROM s
""")
def side_scores(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("l_partkey") % 13 == 0, "x").otherwise(F.col("l_linenumber").cast("string"))
    return review.side_score(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), number.alias("number")), "paper", "number", F.lit(5))


@query(r"""
WITH t AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents),
q AS (SELECT *, CAST(least(length(c), 1200) - CASE WHEN c = '' THEN 1000 ELSE 0 END - CASE WHEN regexp_full_match(c, '\d{1,3}') THEN 300 ELSE 0 END - CASE WHEN contains(lower(c), 'page ') AND contains(lower(c), ' of ') THEN 300 ELSE 0 END - CASE WHEN contains(lower(c), 'question answer marks') OR contains(lower(c), 'general points') THEN 250 ELSE 0 END AS INTEGER) AS quality FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS k FROM q) SELECT source, doc_id, quality FROM r WHERE k = 1
""")
def best_of_group(spark: SparkSession, d: str) -> DataFrame:
    return review.best_of_group(table(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text").select("source", "doc_id", F.col("quality").cast("int").alias("quality"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN sum(l_quantity) OVER (PARTITION BY l_orderkey) > 100 THEN l_quantity * (100 / sum(l_quantity) OVER (PARTITION BY l_orderkey)) ELSE l_quantity END, 1) AS scaled FROM lineitem
""")
def reconciled_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = review.reconcile(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.lit(100.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "scaled")


@query("""
WITH f AS (SELECT c_nationkey AS grp, CASE WHEN o_orderpriority < '2' THEN 'ok' WHEN o_orderpriority < '3' THEN 'low_confidence' WHEN o_orderpriority < '4' THEN 'unreadable' WHEN o_orderpriority < '5' THEN 'blank' ELSE 'not_found' END AS flag, o_orderkey % 5 AS marks FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT grp, count(*) FILTER (flag = 'ok') AS ok, count(*) FILTER (flag = 'low_confidence') AS low_confidence, count(*) FILTER (flag = 'unreadable') AS unreadable, count(*) FILTER (flag = 'blank') AS blank, count(*) FILTER (flag = 'not_found') AS not_found, CAST(sum(CASE WHEN flag IN ('unreadable', 'not_found') THEN marks ELSE 0 END) AS BIGINT) AS withheld FROM f GROUP BY grp
""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp"))
    p = F.col("o_orderpriority")
    flag = F.when(p < "2", "ok").when(p < "3", "low_confidence").when(p < "4", "unreadable").when(p < "5", "blank").otherwise("not_found")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("grp", flag.alias("flag"), (F.col("o_orderkey") % 5).alias("marks"))
    return review.flag_counts(rows, "grp")


@query("""
WITH r AS (SELECT o_custkey AS owner, o_orderkey AS k, sha256(o_orderkey || chr(1) || o_orderstatus || chr(1) || o_orderpriority) AS h, 1 AS n FROM orders),
a AS (SELECT owner, k >> 12 AS k, CASE WHEN count(*) > 1 THEN sha256(string_agg(k || ':' || h, ',' ORDER BY k)) ELSE min(h) END AS h, sum(n) AS n FROM r GROUP BY owner, k >> 12),
b AS (SELECT owner, k >> 12 AS k, CASE WHEN count(*) > 1 THEN sha256(string_agg(k || ':' || h, ',' ORDER BY k)) ELSE min(h) END AS h, sum(n) AS n FROM a GROUP BY owner, k >> 12)
SELECT owner, h AS signature, CAST(n AS BIGINT) AS records FROM b
""")
def record_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_orderpriority")
    return review.signature(rows, "owner", "o_orderkey", ["id", "o_orderstatus", "o_orderpriority"])


@query("""
WITH o AS (SELECT c_custkey, c_acctbal, o_totalprice, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS id, round(o_totalprice / 10000, 6) AS before, round(greatest(0.0, least(4.0, c_acctbal / 1000)), 5) AS after FROM o WHERE round(o_totalprice / 10000, 6) <> greatest(0.0, least(4.0, c_acctbal / 1000))
""")
def override_log(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    proposed = F.array(F.struct(F.lit(4.0).alias("marks_available"), F.round(F.col("o_totalprice") / 10000, 6).alias("marks_awarded")))
    logged = rows.select(F.col("o_orderkey").alias("id"), F.explode(review.changes(review.override(proposed, F.array(F.col("c_acctbal") / 1000)))).alias("c"))
    return logged.select("id", F.col("c.before").alias("before"), F.round("c.after", 5).alias("after"))


@query()
def prose_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of prose lines of every document, in words."""
    return table(spark, d, "documents").select("doc_id", review.prose_run(F.split("text", "\n", -1)).alias("words"))


from markwright.plans import marking, papers, records, streams  # noqa: E402, F401  (they register their queries)
