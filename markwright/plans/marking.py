"""Registered queries: answers, scores, labels, criteria, and what students and teachers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwright.functions import exprs as ex
from markwright.functions import formulas
from markwright.functions import pages as pg
from markwright.functions import text as tx
from markwright.operators import analytics, corpus, matching, review
from markwright.plans.catalog import _T, _answers, _ntz, query
from markwright.sources.readers import table
from markwright.sources.written import spread
from markwright.streaming import limits


def pick(key, *texts: str):
    """One of the texts by a whole number."""
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_WORDS = f"list_filter(list_distinct({_T}), lambda z: NOT list_contains({_STOP}, z))"


@query(rf"""
WITH t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS scheme, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
a AS (SELECT conv_id, turn, answer, scheme, conv_id % 4 = 1 AS mcq FROM t WHERE role = 'assistant' AND before = 'user'),
m AS (SELECT conv_id, turn, chr(CAST(65 + conv_id % 3 AS INTEGER)) AS right_option, CASE turn % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS option FROM a WHERE mcq),
p AS (SELECT *, list_filter(list_transform(string_split_regex(scheme, '\n+|[.;:]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 4) AS ps FROM a WHERE NOT mcq),
w AS (SELECT conv_id, turn, answer, CASE WHEN len(ps) > 0 THEN ps WHEN trim(scheme) <> '' THEN [trim(scheme)] ELSE [] END AS ps FROM p),
u AS (SELECT conv_id, turn, {_WORDS.format("answer")} AS said, unnest(ps) AS pt, generate_subscripts(ps, 1) AS i FROM w), v AS (SELECT *, {_WORDS.format("pt")} AS want FROM u),
x AS (SELECT conv_id, turn, i, pt, len(list_intersect(want, said)) >= 2 OR (len(want) > 0 AND len(list_intersect(want, said)) / len(want) >= 0.4) AS hit FROM v),
s AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (hit) AS k, coalesce(string_agg(pt, '|' ORDER BY i) FILTER (NOT hit), '') AS missing FROM x GROUP BY ALL),
r AS (SELECT conv_id, turn, CAST(n AS INTEGER) AS n_points, round(k / n, 4) AS score, NULL AS right_option, NULL AS option, missing FROM s
      UNION ALL SELECT conv_id, turn, CASE WHEN conv_id // 4 % 4 = 1 THEN 1 ELSE 2 END, CASE WHEN option = right_option THEN 1.0 ELSE 0.0 END, right_option, option, CASE WHEN option = right_option THEN '' ELSE 'Select option ' || right_option || '.' END FROM m)
SELECT conv_id, turn, n_points, CAST(score AS DOUBLE) AS score, round(CAST(score AS DOUBLE) * 100, 2) AS percent, CASE WHEN score >= 0.85 THEN 'fully_correct' WHEN score >= 0.45 THEN 'partially_correct' ELSE 'weak' END AS label,
  right_option, option, md5(missing) AS missing_md5 FROM r
""")
def evaluate_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers marked by rule; every fourth conversation is a multiple-choice question."""
    mcq, letter = F.col("conv_id") % 4 == 1, F.chr(F.lit(65) + F.col("conv_id") % 3)
    scheme = F.when(mcq, F.concat(pick(F.floor(F.col("conv_id") / 4), "Correct answer is ", " ", "answer: ", "The correct option: "), letter)).otherwise(F.col("scheme"))
    answer = F.when(mcq, pick(F.col("turn"), "Ans: a", "I think B fits", "none of them")).otherwise(F.col("answer"))
    rows = matching.evaluate(_answers(spark, d).select("conv_id", "turn", answer.alias("answer"), scheme.alias("scheme")))
    return rows.select("conv_id", "turn", "n_points", "score", "percent", "label", "right_option", "option", F.md5(F.array_join("missing", "|")).alias("missing_md5"))


_SOURCE = """{0} AS (SELECT q, arg_max(r, (score, -r)) AS item, max(score) AS score FROM (SELECT q.id AS q, r.item_id AS r, round(len(list_intersect(q.t, r.t)) / (len(q.t) + len(r.t) - len(list_intersect(q.t, r.t))), 4) AS score
  FROM asked q JOIN items r ON r.item_id % 2 = {1} AND len(list_intersect(q.t, r.t)) > 0) GROUP BY q)"""


@query(f"""
WITH asked AS (SELECT conv_id * 1000 + turn AS id, list_distinct({_T.format("text")}) AS t FROM conversations WHERE role = 'user'), items AS (SELECT item_id, list_distinct({_T.format("text")}) AS t FROM benchmark),
{_SOURCE.format("a", 0)}, {_SOURCE.format("b", 1)},
s AS (SELECT id, a.item AS ia, coalesce(a.score, 0) AS sa, b.item AS ib, b.score AS sb, coalesce(a.score, 0) < 0.1 AND b.score IS NOT NULL AS fb FROM asked LEFT JOIN a ON a.q = id LEFT JOIN b ON b.q = id)
SELECT id, CASE WHEN fb THEN ib ELSE ia END AS item_id, fb AS fallback_used, CASE WHEN (CASE WHEN fb THEN sb ELSE sa END) >= 0.15 THEN 'accepted' WHEN (CASE WHEN fb THEN sb ELSE sa END) >= 0.1 THEN 'review_required' ELSE 'failed' END AS status,
  CAST(CASE WHEN fb AND sb < 0.1 THEN greatest(sa, sb) WHEN fb THEN sb ELSE sa END AS DOUBLE) AS confidence FROM s
""")
def matched_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Each question's best item of one source, or of another where the first has none that is good enough."""
    asked = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return _matched(asked, table(spark, d, "benchmark")).select("id", "item_id", "fallback_used", "status", "confidence")


def _matched(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Questions (id, text) in the first half of the items; those that fail there in the other half."""

    def source(rest: int):
        def match(rows: DataFrame) -> DataFrame:
            best = matching.best_jaccard(rows, items.where(F.col("item_id") % 2 == rest), "id", "item_id").select(F.col("q").alias("id"), F.col("r").alias("item_id"), F.col("score").alias("confidence"))
            return best.withColumn("status", ex.bands(F.col("confidence"), [(0.15, "accepted"), (0.1, "review_required")], "failed"))

        return match

    def first(rows: DataFrame) -> DataFrame:
        found = rows.select("id").join(source(0)(rows), "id", "left")
        return found.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "status": F.coalesce("status", F.lit("failed"))})

    return matching.in_turn(asked, first, source(1), "id")


@query(rf"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, text, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
asked AS (SELECT id, answer, list_distinct({_T.format("text")}) AS t FROM t WHERE role = 'user' AND after = 'assistant'), items AS (SELECT item_id, text, list_distinct({_T.format("text")}) AS t FROM benchmark),
{_SOURCE.format("a", 0)}, {_SOURCE.format("b", 1)},
s AS (SELECT id, answer, a.item AS ia, coalesce(a.score, 0) AS sa, b.item AS ib, b.score AS sb, coalesce(a.score, 0) < 0.1 AND b.score IS NOT NULL AS fb FROM asked LEFT JOIN a ON a.q = id LEFT JOIN b ON b.q = id),
m AS (SELECT id, answer, CASE WHEN fb THEN ib ELSE ia END AS item_id, fb, CASE WHEN (CASE WHEN fb THEN sb ELSE sa END) >= 0.15 THEN 'accepted' WHEN (CASE WHEN fb THEN sb ELSE sa END) >= 0.1 THEN 'review_required' ELSE 'failed' END AS status FROM s),
p AS (SELECT id, {_WORDS.format("answer")} AS said, list_filter(list_transform(string_split_regex(text, '\n+|[.;:]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 4) AS ps FROM m JOIN items USING (item_id) WHERE status <> 'failed'),
u AS (SELECT id, said, unnest(ps) AS pt, generate_subscripts(ps, 1) AS i FROM p), v AS (SELECT *, {_WORDS.format("pt")} AS want FROM u),
x AS (SELECT id, i, pt, len(list_intersect(want, said)) >= 2 OR (len(want) > 0 AND len(list_intersect(want, said)) / len(want) >= 0.4) AS hit FROM v),
e AS (SELECT id, count(*) AS n, round(count(*) FILTER (hit) / count(*), 4) AS score, coalesce(list(pt ORDER BY i) FILTER (NOT hit), []) AS missing FROM x GROUP BY id),
f AS (SELECT *, printf('%.1f', round(score * 100, 2)) AS share, CASE WHEN score >= 0.85 THEN 'fully_correct' WHEN score >= 0.45 THEN 'partially_correct' ELSE 'weak' END AS label, array_to_string(missing[1:2], '; ') AS named FROM e)
SELECT id, CASE WHEN status <> 'failed' THEN item_id END AS item_id, fb AS fallback_used, status, CAST(coalesce(n, 0) AS INTEGER) AS n_points, CAST(coalesce(score, 0.0) AS DOUBLE) AS score, coalesce(label, 'not_marked') AS label, md5(CASE WHEN status = 'failed' THEN 'No question of either source is near enough.' WHEN label = 'fully_correct' THEN 'Full marks (' || share || '%): the key points are there.'
  WHEN label = 'partially_correct' THEN 'Partly right (' || share || '%).' || CASE WHEN named <> '' THEN ' Add: ' || named ELSE '' END ELSE 'Few points met (' || share || '%).' || CASE WHEN named <> '' THEN ' Main gaps: ' || named ELSE '' END END) AS feedback_md5
FROM m LEFT JOIN f USING (id)
""")
def answer_chain(spark: SparkSession, d: str) -> DataFrame:
    """From a question and an answer to marks: the item is found, in a second source if need be, the answer is marked by the
    item's scheme, and the student reads what is there and what is missing. One row for each answer."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumns({"answer": F.lead("text").over(order), "after": F.lead("role").over(order)}).where("role = 'user' AND after = 'assistant'")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "answer")
    return review.chained(asked, _matched(asked.select("id", "text"), table(spark, d, "benchmark")), table(spark, d, "benchmark").select("item_id", F.col("text").alias("scheme")))


@query("""
WITH c AS (SELECT c_custkey, ['Chem', ' MATHS ', 'pst', 'Islamic-Studies', 'string', 'Phy.', 'History', ''][c_custkey % 8 + 1] AS raw, c_nationkey, c_mktsegment FROM customer),
s AS (SELECT *, CASE c_custkey % 8 WHEN 0 THEN 'Chemistry 1011' WHEN 1 THEN 'Mathematics 1014' WHEN 2 THEN 'Pakistan Studies 1015' WHEN 3 THEN 'Islamiyat 1013' WHEN 5 THEN 'Physics 1016' WHEN 6 THEN 'History' END AS subject FROM c)
SELECT c_custkey, subject FROM s WHERE subject IN ('Mathematics 1014', 'Physics 1016') AND lower(c_mktsegment) = 'building'
UNION ALL SELECT c_custkey + 1000000000, subject FROM s WHERE c_nationkey = 3
""")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Records by the filters that are given; names of subjects and placeholders are cleaned before."""
    raw = pick(F.col("c_custkey"), "Chem", " MATHS ", "pst", "Islamic-Studies", "string", "Phy.", "History", "")
    rows = table(spark, d, "customer").withColumn("subject", ex.subject_of(ex.placeholder_to_null(raw)))
    some = matching.given_filters(rows, {"subject": ["maths", "phy"], "c_mktsegment": "building", "c_nationkey": None, "c_name": " n/a "}, {"subject": ex.subject_of})
    other = matching.given_filters(rows, {"subject": "none", "c_nationkey": 3}, {"subject": ex.subject_of})
    return some.select("c_custkey", "subject").unionByName(other.select((F.col("c_custkey") + 1000000000).alias("c_custkey"), "subject"))


_FORMULA = """f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 4 AS k, CAST(l_suppkey % 17 + 2 AS VARCHAR) AS b, CAST(l_partkey AS VARCHAR) AS p, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS n,
  CAST(CAST(l_discount * 100 AS BIGINT) + 2 AS VARCHAR) AS e, ['+', '-', '*', '/'][l_linenumber % 4 + 1] AS s, chr(CAST(97 + l_partkey % 3 AS INTEGER)) AS x FROM lineitem)"""


@query(rf"""
WITH {_FORMULA},
g AS (SELECT *, x || '^' || e || ' ' || s || ' ' || n AS plain, CASE k WHEN 0 THEN 'log_' || b || ' (' || p || ' ' || s || ' ' || x || ')' WHEN 1 THEN 'log_' || b || ' ' || x WHEN 2 THEN 'lg ' || p ELSE 'ln (' || p || x || ')' END AS head FROM f),
h AS (SELECT *, head || ' = ' || plain AS display, CASE k WHEN 0 THEN 'log(base=' || b || ',arg=' || p || s || x || ') = ' || plain WHEN 1 THEN 'log(base=' || b || ',arg=' || x || ') = ' || plain END AS canonical FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, display, coalesce(canonical, raw) AS canonical,
  CASE WHEN k = 2 THEN replace(raw, 'lg', 'log base 10') WHEN k = 3 THEN raw WHEN b = '10' THEN 'log base 10 ' || CASE k WHEN 0 THEN p || s || x ELSE x END || ' = ' || plain ELSE canonical END AS matcher,
  CASE WHEN k IN (0, 1) AND length(b) > 1 THEN 'merged_log_base_operand' ELSE '' END AS warnings
FROM (SELECT *, CASE k WHEN 2 THEN 'lg ' || p ELSE 'ln( ' || p || x || ' )' END || '=' || x || translate(e, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' ' || s || n AS raw FROM h)
""")
def math_text(spark: SparkSession, d: str) -> DataFrame:
    """Formulas with raised and lowered digits: as they are shown, in canonical form, as they are matched on, and their doubts."""
    number = lambda c: c.cast("long").cast("string")
    base, p, n = number(F.col("l_suppkey") % 17 + 2), number(F.col("l_partkey")), number(F.col("l_quantity"))
    x, s, power = F.chr(97 + F.col("l_partkey") % 3), pick(F.col("l_linenumber"), "+", "-", "*", "/"), F.translate(number(F.round(F.col("l_discount") * 100) + 2), tx.DIGITS, tx.SUPERSCRIPTS)
    lowered = F.translate(base, tx.DIGITS, tx.SUBSCRIPTS)
    heads = [F.concat(F.lit("log"), lowered, F.lit("( "), p, s, x, F.lit(")")), F.concat(F.lit("log_"), base, x), F.concat(F.lit("lg "), p), F.concat(F.lit("ln( "), p, x, F.lit(" )"))]
    raw = F.concat(F.element_at(F.array(*heads), (F.col("l_partkey") % 4 + 1).cast("int")), F.lit("="), x, power, F.lit(" "), s, n)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", raw.alias("raw"))
    rows = spread(lines).withColumn("f", formulas.math_normalised(F.col("raw")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "f.display", "f.canonical", F.col("f.matched").alias("matcher"), F.array_join("f.warnings", ",").alias("warnings"))


@query(r"""
WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, contains(lower(text), 'log') AS logs FROM documents),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*([=+\-*/()])\s*', ' \1 ', 'g'), '\s+\^', '^', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g') AS shown FROM t),
e AS (SELECT *, trim(regexp_replace(shown, '\s+', ' ', 'g')) AS display FROM d)
SELECT doc_id, md5(display) AS display_md5, md5(CASE WHEN logs THEN trim(regexp_replace(regexp_replace(regexp_replace(display, '\^(\d+)', ' power \1', 'g'), '[^A-Za-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) ELSE flat END) AS matcher_md5,
  CASE WHEN logs THEN 'canonical_math_missing' ELSE '' END AS warnings FROM e
""")
def math_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents read as mathematics; none of them holds raised or lowered digits, few name a logarithm."""
    rows = formulas.with_math_forms(spread(table(spark, d, "documents").select("doc_id", "text")), "text")
    return rows.select("doc_id", F.md5("forms.display").alias("display_md5"), F.md5("forms.matcher").alias("matcher_md5"), F.array_join("forms.warnings", ",").alias("warnings"))


@query("""
SELECT c_nationkey AS queue, count(*) AS total, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'needs_review' AND c < 0.5) AS below_threshold, count(*) FILTER (s = 'needs_review' AND c >= 0.5) AS ready_bulk,
  count(*) FILTER (s = 'ocr_failed') AS ocr_failed, count(*) FILTER (s = 'overridden') AS overridden, count(*) FILTER (s IN ('approved', 'auto_approved')) AS approved, count(*) FILTER (o_orderkey % 7 = 0) AS flagged
FROM (SELECT c_nationkey, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 500000 END AS c, CASE WHEN o_orderstatus = 'O' THEN 'needs_review' WHEN o_orderstatus = 'P' THEN 'ocr_failed' WHEN o_orderkey % 3 = 0 THEN 'overridden' WHEN o_orderkey % 3 = 1 THEN 'approved' ELSE 'auto_approved' END AS s
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY c_nationkey
""")
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("queue"))
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "needs_review").when(F.col("o_orderstatus") == "P", "ocr_failed").otherwise(pick(key, "overridden", "approved", "auto_approved"))
    marks = table(spark, d, "orders").select("o_custkey", status.alias("status"), F.when(key % 10 != 0, F.col("o_totalprice") / 500000).alias("confidence"), (key % 7 == 0).alias("flagged"))
    return analytics.review_counters(marks.join(people, F.col("o_custkey") == F.col("c_custkey")), "queue", 0.5)


@query("""
SELECT c_nationkey AS class_id, c_custkey AS student, missed, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM (
    SELECT c_nationkey, c_custkey, 4 - count(DISTINCT CASE WHEN o_orderpriority < '5' THEN o_orderpriority END) AS missed,
      CASE WHEN 4 - count(DISTINCT CASE WHEN o_orderpriority < '5' THEN o_orderpriority END) >= 2 THEN 'Missed ' || (4 - count(DISTINCT CASE WHEN o_orderpriority < '5' THEN o_orderpriority END)) || ' assignments'
           WHEN max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '1998-07-25' THEN 'No practice in 7+ days' END AS reason
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL) WHERE reason IS NOT NULL) WHERE k <= 5
""")
def attention_first_five(spark: SparkSession, d: str) -> DataFrame:
    students = table(spark, d, "customer").select(F.col("c_custkey").alias("student"), F.col("c_nationkey").alias("class_id"))
    orders = table(spark, d, "orders")
    deadline = F.when(F.col("assignment_id") < "5", _ntz("1998-06-01 00:00:00")).otherwise(_ntz("1999-01-01 00:00:00"))
    work = orders.select(F.col("o_orderpriority").alias("assignment_id")).distinct().withColumn("deadline_at", deadline)
    subs = orders.select(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("assignment_id"), F.when(F.col("o_orderstatus") == "F", "submitted").otherwise("open").alias("status"), F.col("o_orderdate").alias("submitted_at"))
    return analytics.needs_attention(students, work, subs, _ntz("1998-08-01 00:00:00"), days=7, most=5, by="class_id")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS most, round(l_quantity * (1 - l_discount * 9), 4) AS got, l_discount AS conf, CAST(l_quantity * 10 AS INTEGER) AS words FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN got / most >= 0.85 THEN 'Excellent' WHEN got / most >= 0.7 THEN 'Good' WHEN got / most >= 0.5 THEN 'Average' ELSE 'Weak' END AS rating,
  CASE WHEN words BETWEEN round_even(250 * 0.95, 0) AND round_even(250 * 1.05, 0) THEN 'Within +/-5%' WHEN words < round_even(250 * 0.95, 0) THEN 'Too Short' ELSE 'Too Long' END AS length_status,
  CASE WHEN got / most >= 0.82 THEN 'accepted' WHEN got / most >= 0.65 THEN 'review_required' ELSE 'failed' END AS match_status, CASE WHEN got / most >= 0.78 THEN 'accepted' WHEN got / most >= 0.62 THEN 'review_required' ELSE 'failed' END AS search_status,
  CASE WHEN got / most >= 0.75 THEN 'accepted' WHEN got / most >= 0.4 THEN 'review_required' ELSE 'failed' END AS score_status,
  CASE WHEN l_linenumber = 7 THEN 'unanswered' WHEN got / most >= 0.85 THEN 'correct' WHEN got / most >= 0.4 THEN 'partial' ELSE 'weak' END AS verdict,
  CASE WHEN got / most * 100 >= 90 THEN 'A*' WHEN got / most * 100 >= 80 THEN 'A' WHEN got / most * 100 >= 70 THEN 'B' WHEN got / most * 100 >= 60 THEN 'C' WHEN got / most * 100 >= 50 THEN 'D' WHEN got / most * 100 >= 40 THEN 'E' ELSE 'U' END AS band,
  floor(least(1.0, 2 * abs(got / most - 0.5)) * 100 + 0.5) / 100 AS confidence, CASE WHEN conf >= 0.06 THEN most ELSE 0.0 END AS award,
  CAST(greatest(0, least(20, CASE WHEN l_linenumber = 3 THEN 5 ELSE floor(most / 2) END)) AS BIGINT) AS clamped, conf >= 0.02 AND l_linenumber < 3 AND got / most >= 0.85 AND conf / 2 >= 0.02 AS auto_accept,
  round(greatest(0.0, least(1.0, 0.38 * conf + 0.20 * got / most + 0.18 * 0.5 + 0.12 * 0.3 + 0.12 * 0.75 - 0.12 * conf - 0.08 * 0.1)), 6) AS candidate FROM s
""")
def scores_and_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label and score that marks are shown with."""
    most, got, conf = F.col("l_quantity"), F.round(F.col("l_quantity") * (1 - F.col("l_discount") * 9), 4), F.col("l_discount")
    share, line = got / most, F.col("l_linenumber")
    number = F.when(line == 3, "x").otherwise((most / 2).cast("string"))
    auto = (conf >= 0.02) & matching.auto_accept(F.lit(0.92), F.when(line < 3, F.array()).otherwise(F.array(F.lit("w"))), share, conf / 2 + 0.03)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ex.rating(got, most).alias("rating"), ex.length_status(F.lit(300), F.lit(250), (most * 10).cast("int")).alias("length_status"), ex.match_status(share).alias("match_status"),
        ex.search_status(share).alias("search_status"), ex.score_status(share).alias("score_status"), ex.verdict(share, line != 7).alias("verdict"), ex.grade_band(share * 100).alias("band"), ex.heuristic_confidence(share).alias("confidence"),
        ex.award(conf, most, 0.06).alias("award"), ex.clamp_int(number, 0, 20, 5).alias("clamped"), auto.alias("auto_accept"),
        F.round(review.candidate_score(conf, share, F.lit(0.5), F.lit(0.3), F.lit(0.75), conf, F.lit(0.1)), 6).alias("candidate"),
    )


@query("""
SELECT o_orderkey AS id, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) AS earned, sum(CASE WHEN l_tax < 0.06 THEN l_quantity ELSE 0 END) AS available, count(*) AS n_criteria,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 1 THEN 7.5 END, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END)) AS score, string_agg(l_linenumber || ':0:false', ',' ORDER BY l_linenumber, l_quantity, l_discount) AS scaffold
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice
""")
def criteria_totals(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of a mark: their sum, the three-way score, what counts of them, and the empty scaffold a marker starts from."""
    c = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("marks_available"), F.col("l_discount").alias("share"), (F.col("l_tax") >= 0.06).alias("excluded"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(c)).alias("list"))
    rows = rows.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id")
    awarded = F.transform("list", lambda x: F.struct(ex.award(x["share"], x["marks_available"], 0.05).alias("marks_awarded"), x["marks_available"].alias("marks_available")))
    score = ex.earned(F.when(F.col("id") % 3 == 0, F.col("o_totalprice")), F.when(F.col("id") % 3 == 1, F.lit(7.5)), F.col("criteria"))
    rows = rows.withColumn("criteria", awarded)
    shown = F.array_join(F.transform(ex.scaffold(F.transform("list", lambda x: F.struct(x["line"].cast("string").alias("criterion_text"), x["marks_available"].alias("marks_available")))), lambda s: F.concat_ws(":", s["criterion_text"], s["marks_awarded"].cast("int").cast("string"), s["awarded"].cast("string"))), ",")
    return rows.select("id", ex.criteria_sum(F.col("criteria")).alias("earned"), ex.total_marks(F.col("list")).alias("available"), F.size("criteria").cast("long").alias("n_criteria"), score.alias("score"), shown.alias("scaffold"))


@query("SELECT user_id, max(epoch_us(ts)) + 1800000000 AS until FROM events WHERE event_type = 'error' GROUP BY user_id")
def cool_downs(spark: SparkSession, d: str) -> DataFrame:
    rows = limits.cool_down(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", 1800)
    return rows.select("user_id", F.unix_micros(F.col("until").cast("timestamp")).alias("until"))


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT event_id, user_id, t, k, t AS opened, true AS ok FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.t, o.k, CASE WHEN o.t >= f.opened + 3600000000 THEN o.t ELSE f.opened END, o.t >= f.opened + 3600000000 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT event_id, user_id FROM f WHERE ok
""")
def throttled(spark: SparkSession, d: str) -> DataFrame:
    return limits.throttle(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3600)


@query("""
WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS made, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id),
a AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND ts > made) AS gained, any_value(n) AS n, any_value(made) AS made FROM events JOIN l USING (user_id) GROUP BY user_id)
SELECT user_id, coalesce(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(made) < 259200000000 AND gained < 8, false) AS fresh, n >= 4 AS enough FROM a
""")
def insight_freshness(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    made = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("made"))
    error = F.col("event_type") == "error"
    rows = events.join(made, "user_id", "left").groupBy("user_id").agg(F.first("made").alias("made"), F.count_if(error & (F.col("ts") > F.col("made"))).alias("gained"), F.count_if(error).alias("n"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(_ntz("2024-01-30 00:00:00")) - micros(F.col("made"))) / 1_000_000
    return rows.select("user_id", F.coalesce(limits.is_fresh(age, F.col("gained")), F.lit(False)).alias("fresh"), limits.is_enough(F.col("n")).alias("enough"))


@query("""
SELECT o_orderkey AS id, o_orderstatus = 'F' AND TIMESTAMP '1998-08-02 12:00:00' < o_orderdate + INTERVAL 24 HOUR AS blocked, CAST(ceil(epoch(o_orderdate - TIMESTAMP '1998-08-02 12:00:00') / 86400) AS BIGINT) AS days_left,
  strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS parsed, o_orderdate > TIMESTAMP '1998-01-01' AS late FROM orders
""")
def dates(spark: SparkSession, d: str) -> DataFrame:
    """Retry blocks, days left, days as text, lenient parsing and lateness."""
    at, now = F.col("o_orderdate"), _ntz("1998-08-02 12:00:00")
    written = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), pg.retry_blocked(F.when(F.col("o_orderstatus") == "F", at), now).alias("blocked"), ex.days_left(at, now).alias("days_left"), F.date_format(at, "yyyy-MM-dd").alias("day"),
        ex.utc_time(written).alias("parsed"), (at > ex.effective_deadline(_ntz("1998-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"))).alias("late"),
    )


@query("""
WITH s AS (SELECT o_orderkey AS id, c.c_name AS student, t.s_name AS teacher FROM orders JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN supplier t ON t.s_suppkey = o_custkey % 20)
SELECT id, student, coalesce(teacher, 'Teacher') AS teacher FROM s
""")
def meetings_with_names(spark: SparkSession, d: str) -> DataFrame:
    """One table of people joined twice, for each part that they play."""
    people = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person"), F.col("c_name").alias("name"))
    people = people.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("person"), F.col("s_name").alias("name")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("student"), F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")).alias("teacher"))
    return review.with_names(rows, people, {"student": None, "teacher": "Teacher"}).where("student IS NOT NULL")


@query("""
WITH q AS (SELECT conv_id, turn, ['photosynthesis', 'SSL', 'the water cycle'][turn % 3 + 1] AS t, CAST(conv_id % 12 + 1 AS VARCHAR) AS n, ['Biology', 'Computer Science', 'Pakistan Studies'][turn % 3 + 1] AS s FROM conversations),
x AS (SELECT *, conv_id % 3 AS k FROM q)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'paper_lookup' WHEN 1 THEN 'general_qa' ELSE 'paper_lookup' END AS intent, CASE WHEN k = 2 THEN NULL ELSE s END AS subject, CAST(CASE WHEN k = 0 THEN CAST(n AS INTEGER) ELSE 5 END AS INTEGER) AS years,
  2026 - CAST(CASE WHEN k = 0 THEN CAST(n AS INTEGER) ELSE 5 END AS INTEGER) + 1 AS since, CASE WHEN k = 2 THEN 'me ' ELSE '' END || CASE WHEN turn % 3 = 2 THEN 'water cycle' ELSE t END || CASE WHEN k = 1 THEN ' work' ELSE '' END AS topic,
  CASE WHEN turn % 3 = 1 THEN 'SSL' ELSE '' END AS acronyms FROM x
""")
def query_understanding(spark: SparkSession, d: str) -> DataFrame:
    """What a question asks for: the intent, the subject, how many years, the topic itself, and its acronyms."""
    topic, n = pick(F.col("turn"), "photosynthesis", "SSL", "the water cycle"), (F.col("conv_id") % 12 + 1).cast("string")
    subject = pick(F.col("turn"), "Biology", "Computer Science", "Pakistan Studies")
    asked = [F.concat(F.lit("Which years was "), topic, F.lit(" asked in "), subject, F.lit(" in past "), n, F.lit(" years?")), F.concat(F.lit("How does "), topic, F.lit(" work in "), F.lower(subject), F.lit("?")), F.concat(F.lit("Show me questions on "), topic)]
    q = F.element_at(F.array(*asked), (F.col("conv_id") % 3 + 1).cast("int"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.intent(q).alias("intent"), tx.subject_in(q).alias("subject"), tx.years_asked(q).alias("years"), (F.lit(2026) - tx.years_asked(q) + 1).alias("since"),
        tx.core_topic(q, tx.subject_in(q)).alias("topic"), F.array_join(tx.acronyms(q), ",").alias("acronyms"),
    )


_HITS = """h AS (SELECT l_suppkey AS q, l_partkey AS hit, l_linenumber AS number, p_brand AS subject, 2010 + l_orderkey % 17 AS year, CASE WHEN l_returnflag = 'A' THEN 'May_June' ELSE 'Oct_Nov' END AS session, l_quantity > 45 AS verified, l_extendedprice AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.09)"""


@query(f"""
WITH {_HITS}, v AS (SELECT *, bool_or(verified) OVER (PARTITION BY q) AS any_ok FROM h)
SELECT DISTINCT q, subject, year, session, CAST(number AS INTEGER) AS number FROM v WHERE (verified OR NOT any_ok) AND number <> 7 AND year >= 2026 - 5 + 1
""")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """When a topic was asked: verified hits alone if there are any, each question once, in the last five years."""
    return matching.occurrences(_hits(spark, d), ["subject", "year", "session", "number"], as_of_year=2026, years=5).select("q", "subject", "year", "session", "number")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_discount >= 0.09").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("hit"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("number"), F.col("p_brand").alias("subject"), (2010 + F.col("l_orderkey") % 17).alias("year"),
        F.when(F.col("l_returnflag") == "A", "May_June").otherwise("Oct_Nov").alias("session"), (F.col("l_quantity") > 45).alias("verified"), F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_partkey") % 3 == 0, "A one B two C three D four").otherwise("Explain it.").alias("text"),
    )


@query(f"""
WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY q, subject, year, session, number ORDER BY verified DESC, score DESC, hit) AS u FROM h WHERE number <> 7 AND year >= 2022 AND hit % 3 <> 0)
SELECT q, hit, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY verified DESC, score DESC, hit) AS place FROM k WHERE u = 1) WHERE place <= 3
""")
def worked_examples(spark: SparkSession, d: str) -> DataFrame:
    """Three questions to be worked through: none of multiple choice, recent, each once, the most relevant first."""
    rows = _hits(spark, d).where(~pg.mcq_layout(F.col("text")))
    return matching.examples(rows, ["subject", "year", "session", "number"], as_of_year=2026, years=5, most=3).select("q", "hit", F.col("place").cast("long").alias("place"))


@query("""
WITH g AS (SELECT c_mktsegment AS topic, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT topic, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, topic) AS r FROM g) WHERE r <= 8
""")
def topic_frequency(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic"))
    return analytics.most_frequent(table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")), "topic", 8)


@query("""
SELECT l_orderkey AS paper, coalesce(round(avg(CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice / 123457 END), 4), 0.0) AS page_confidence, min(CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice / 123457 END) AS least FROM lineitem GROUP BY l_orderkey
""")
def paper_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice") / 123457).alias("confidence"))
    return rows.groupBy("paper").agg(analytics.mean_confidence(F.col("confidence")).alias("page_confidence"), F.min("confidence").alias("least"))


@query("""
WITH a AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT c_nationkey AS institution, count(DISTINCT c_custkey) FILTER (n IS NOT NULL) AS seats, count(*) AS enrolled FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY c_nationkey
""")
def seat_usage(spark: SparkSession, d: str) -> DataFrame:
    """Distinct active students of an institution, however many classes they are in."""
    orders = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", "active").otherwise("removed").alias("status"))
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("institution"))
    active = analytics.active_students(orders.where("status = 'active'").join(people, F.col("o_custkey") == F.col("c_custkey")), "institution", "c_custkey")
    return people.groupBy("institution").agg(F.count("*").alias("enrolled")).join(active, "institution", "left").select("institution", F.coalesce("seats", F.lit(0)).alias("seats"), "enrolled")


@query("""
WITH j AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey AS id, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) = 0 THEN 'absent' WHEN count(o_orderkey) = 1 THEN 'one' ELSE 'several' END AS outcome, CASE WHEN count(o_orderkey) = 1 THEN max(o_orderkey) END AS found FROM customer LEFT JOIN j ON o_custkey = c_custkey GROUP BY c_custkey
""")
def single_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lookups that expect one row at most: which key has one, none, or too many."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("found"))
    return review.single(asked, rows, "id", "found")


@query(r"""
SELECT doc_id, md5(c) AS c_md5, round(least(1.0, len(regexp_extract_all(c, '[=+\-/*^_()\[\]{}|]')) / greatest(length(c), 1) * 20 + CASE WHEN bal THEN 0.1 ELSE 0 END + 0.35), 6) AS symbols,
  CASE WHEN len(tok) = 0 THEN 0.5 ELSE round(least(1.0, 0.4 + len(tok) / 10.0), 6) END AS math, CAST(CASE WHEN regexp_matches(c, '(?i)(^|\n)\s*(q[.)]|question[:.]?)') AND regexp_matches(c, '(?i)(^|\n)\s*(a[.)]|answer[:.]?)') THEN 1.0 WHEN regexp_matches(c, '(?i)(^|\n)\s*(q[.)]|question[:.]?)') OR regexp_matches(c, '(?i)(^|\n)\s*(a[.)]|answer[:.]?)') THEN 0.75
  WHEN regexp_matches(c, '(?i)solve|find|prove|show that|explain|state') THEN 0.55 ELSE 0.3 END AS DOUBLE) AS anchors, bal AS balanced
FROM (SELECT doc_id, c, list_distinct(list_transform(regexp_extract_all(c, '(log|sqrt|sin|cos|tan|[A-Za-z]\^\d+|[A-Za-z]_\d+|\d+[A-Za-z]|[A-Za-z]+\d+)', 1), lambda x: lower(x))) AS tok,
  len(regexp_extract_all(c, '\(')) = len(regexp_extract_all(c, '\)')) AND len(regexp_extract_all(c, '\[')) = len(regexp_extract_all(c, '\]')) AND len(regexp_extract_all(c, '\{')) = len(regexp_extract_all(c, '\}')) AS bal
  FROM (SELECT doc_id, ['Q. find x^', 'Answer: log(', 'Question', 'Solve: '][doc_id % 4 + 1] || (doc_id % 7) || ' + ' || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'A. sin 30' ELSE '' END AS c FROM documents))
""")
def reading_scores(spark: SparkSession, d: str) -> DataFrame:
    """What a reading of a page preserved: symbols, mathematics, the marks of question and answer."""
    key = F.col("doc_id")
    c = F.concat(pick(key, "Q. find x^", "Answer: log(", "Question", "Solve: "), (key % 7).cast("string"), F.lit(" + "), F.col("text"), F.lit("\n"), F.when(key % 3 == 0, "A. sin 30").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.md5("c").alias("c_md5"), F.round(review.symbol_score(F.col("c")), 6).alias("symbols"), F.round(review.math_score(F.col("c")), 6).alias("math"), review.anchor_score(F.col("c")).alias("anchors"), review.balanced(F.col("c")).alias("balanced"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS pts, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN t > 100 THEN pts * (100 / t) ELSE pts END, 1) AS scaled,
  round(least(100.0, CASE WHEN abs((l_orderkey % 150) - t) <= 0.1 THEN l_orderkey % 150 ELSE t END), 1) AS total FROM s
""")
def reconciled_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = review.reconcile(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.lit(100.0), stated=F.col("l_orderkey") % 150)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "scaled", "total")


@query("""
WITH f AS (SELECT l_orderkey AS question, l_linenumber AS page, ' ' || l_shipdate_text || ' ' AS text, l_discount * 10 AS confidence, l_tax < 0.08 AS legible FROM (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE strftime(l_shipdate, '%Y') END AS l_shipdate_text FROM lineitem)),
g AS (SELECT question, string_agg(trim(text), chr(10) ORDER BY page, text) AS text, min(confidence) AS confidence, bool_and(legible) AS legible FROM f GROUP BY question)
SELECT question, md5(text) AS text_md5, round(confidence, 6) AS confidence, CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN 'blank' WHEN NOT legible OR confidence < 0.3 THEN 'unreadable' WHEN confidence < 0.55 THEN 'low_confidence' ELSE 'ok' END AS flag FROM g
""")
def folded_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of answers in page order, with the flag that the least certain one gives."""
    text = F.concat(F.lit(" "), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy")), F.lit(" "))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.lit("").alias("part"), F.col("l_linenumber").alias("page"), text.alias("text"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") < 0.08).alias("legible"))
    return corpus.fold_fragments(rows).select("question", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "flag")


@query("""
SELECT q.o_orderkey AS question, f.o_orderkey AS fragment FROM (SELECT o_orderkey, o_orderkey % 12 + 1 AS n, o_custkey FROM orders) q
JOIN (SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS VARCHAR) || ['', 'a', ' b', '0', '(c)'][o_orderkey % 5 + 1] AS s, o_custkey FROM orders) f ON f.o_custkey = q.o_custkey
WHERE starts_with(trim(f.s), CAST(q.n AS VARCHAR)) AND regexp_full_match(substr(trim(f.s), length(CAST(q.n AS VARCHAR)) + 1), '[a-z]*')
""")
def fragment_questions(spark: SparkSession, d: str) -> DataFrame:
    """Which question a fragment's number belongs to: 3 and 3a to question 3, 30 and 3(c) not."""
    n = (F.col("o_orderkey") % 12 + 1).cast("string")
    orders = table(spark, d, "orders")
    q = orders.select("o_custkey", F.col("o_orderkey").alias("question"), n.alias("question_number"))
    f = orders.select("o_custkey", F.col("o_orderkey").alias("fragment"), F.concat(n, pick(F.col("o_orderkey"), "", "a", " b", "0", "(c)")).alias("fragment_number"))
    return corpus.fragment_question(f, q, by="o_custkey").select("question", "fragment")
