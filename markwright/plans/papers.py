"""Registered queries: papers, pages, lines, names of files, and how question papers meet their mark schemes."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.functions import exprs as ex
from markwright.functions import pages as pg
from markwright.functions import text as tx
from markwright.functions import udfs
from markwright.operators import corpus, geometry, relational, review
from markwright.plans.catalog import _T, query
from markwright.plans.marking import pick
from markwright.sources import readers
from markwright.sources.readers import table
from markwright.sources.written import dealt, spread

_SIDES = """l AS (SELECT l_orderkey % 400 AS paper, CAST(l_linenumber AS VARCHAR) AS number, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE chr(CAST(97 + l_partkey % 2 AS INTEGER)) END AS sub, l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS pos, l_returnflag AS f FROM lineitem),
q AS (SELECT paper, number, sub, pos, row_number() OVER (PARTITION BY paper, number, sub ORDER BY pos) AS n FROM (SELECT DISTINCT paper, number, sub, pos FROM l WHERE f = 'A')), e AS (SELECT paper, number, sub, pos, row_number() OVER (PARTITION BY paper, number, sub ORDER BY pos) AS n FROM (SELECT DISTINCT paper, number, sub, pos FROM l WHERE f = 'R')),
x AS (SELECT coalesce(q.paper, e.paper) AS paper, coalesce(q.number, e.number) AS number, coalesce(q.sub, e.sub) AS sub, q.pos AS qp, e.pos AS ep FROM q FULL JOIN e ON q.paper = e.paper AND q.number = e.number AND q.sub = e.sub AND q.n = e.n),
r AS (SELECT paper, number, count(*) AS n, min(ep) AS lone FROM x WHERE qp IS NULL GROUP BY ALL),
u AS (SELECT x.*, r.n, r.lone, CASE WHEN sub = '' THEN row_number() OVER (PARTITION BY x.paper, x.number ORDER BY sub <> '', qp) END AS k FROM x LEFT JOIN r ON r.paper = x.paper AND r.number = x.number WHERE ep IS NULL),
m AS (SELECT paper, number, sub, qp, ep, 'exact_key' AS method, false AS ambiguous FROM x WHERE qp IS NOT NULL AND ep IS NOT NULL
      UNION ALL SELECT paper, number, sub, qp, CASE WHEN k = 1 AND n = 1 THEN lone END, CASE WHEN k = 1 AND n = 1 THEN 'same_question_unique_sub_safe' END, coalesce(n > 1, false) FROM u
      UNION ALL SELECT x.paper, x.number, x.sub, NULL, x.ep, NULL, false FROM x LEFT JOIN u ON u.paper = x.paper AND u.number = x.number AND k = 1 AND u.n = 1 WHERE x.qp IS NULL AND u.paper IS NULL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    pos = F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    sub = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.chr(F.lit(97) + F.col("l_partkey") % 2))
    side = lambda flag: line.where(F.col("l_returnflag") == flag).select((F.col("l_orderkey") % 400).alias("paper"), F.col("l_linenumber").cast("string").alias("number"), sub.alias("sub"), pos.alias("pos")).distinct()
    return relational.pair_with_fallback(side("A"), side("R"), "paper")


@query(f"WITH {_SIDES} SELECT paper, number, sub, CAST(qp AS VARCHAR) AS q_pos, CAST(ep AS VARCHAR) AS e_pos, method, ambiguous FROM m")
def pairing_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their marking entries, each entry used once, with the safe fallback."""
    return _pairs(spark, d).withColumns({c: F.col(c).cast("string") for c in ("q_pos", "e_pos")})


_PAPERS = f"""WITH {_SIDES}, p AS (SELECT paper, count(qp) AS n_qp, count(ep) AS n_ms, count(*) FILTER (qp IS NOT NULL AND ep IS NOT NULL) AS matched, count(*) FILTER (qp IS NOT NULL AND ep IS NULL) AS unmatched_qp, count(*) FILTER (qp IS NULL) AS unmatched_ms,
  count(DISTINCT CASE WHEN ambiguous THEN number END) AS issues, paper % 2 = 0 AS mcq, 0.7 + (paper % 10) / 50.0 AS qc, 0.7 + (paper % 8) / 40.0 AS mc, paper % 5 // 4 AS invalid_qp, paper % 7 // 6 AS invalid_ms, paper % 6 // 5 AS duplicate_qp, paper % 9 // 8 AS duplicate_ms, paper % 11 // 10 AS conflicts,
  greatest(0, 6 - count(DISTINCT CASE WHEN qp IS NOT NULL THEN number END)) AS missing_qp, greatest(0, 6 - count(DISTINCT CASE WHEN ep IS NOT NULL THEN number END)) AS missing_ms FROM m GROUP BY paper)"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    q, e, p = F.col("q_pos").isNotNull(), F.col("e_pos").isNotNull(), F.col("paper")
    distinct = lambda cond: F.count_distinct(F.when(cond, F.col("number")))
    rows = _pairs(spark, d).groupBy("paper").agg(
        F.count("q_pos").alias("n_qp"), F.count("e_pos").alias("n_ms"), F.count_if(q & e).alias("matched"), F.count_if(q & ~e).alias("unmatched_qp"), F.count_if(~q).alias("unmatched_ms"), distinct(F.col("ambiguous")).alias("issues"),
        F.greatest(F.lit(0), 6 - distinct(q)).alias("missing_qp"), F.greatest(F.lit(0), 6 - distinct(e)).alias("missing_ms"),
    )
    last = lambda n: (p % n == n - 1).cast("int")
    return rows.withColumns({
        "mcq": p % 2 == 0, "qp_confidence": F.lit(0.7) + p % 10 / 50.0, "ms_confidence": F.lit(0.7) + p % 8 / 40.0, "invalid_qp": last(5), "invalid_ms": last(7), "duplicate_qp": last(6), "duplicate_ms": last(9), "conflicts": last(11),
    })


@query(f"""{_PAPERS},
h AS (SELECT *, list_filter([CASE WHEN matched = 0 THEN 'no_matches' END, CASE WHEN n_ms = 0 THEN 'no_ms_items' END, CASE WHEN n_qp = 0 THEN 'no_qp_items' END], lambda x: x IS NOT NULL) AS hard, matched / greatest(n_qp, n_ms, 1) AS cov FROM p),
s AS (SELECT *, list_sort(list_filter([CASE WHEN qc < 0.75 THEN 'low_qp_confidence' END, CASE WHEN mc < 0.75 THEN 'low_ms_confidence' END, CASE WHEN cov < 0.8 THEN 'low_match_coverage' END, CASE WHEN invalid_qp > 0 THEN 'invalid_qp_ids_detected' END,
  CASE WHEN invalid_ms > 0 THEN 'invalid_ms_ids_detected' END, CASE WHEN duplicate_qp > 0 THEN 'duplicate_qp_ids_detected' END, CASE WHEN duplicate_ms > 0 THEN 'duplicate_ms_ids_detected' END, CASE WHEN conflicts > 0 THEN 'parse_conflicts_detected' END,
  CASE WHEN issues > 0 THEN 'pairing_issues_detected' END, CASE WHEN mcq AND missing_ms > 0 THEN 'missing_expected_ms_questions' END, CASE WHEN mcq AND missing_qp > 0 THEN 'missing_expected_qp_questions' END], lambda x: x IS NOT NULL)) AS soft FROM h)
SELECT paper, CASE WHEN len(hard) > 0 THEN 'failed' WHEN len(soft) > 0 THEN 'review_required' ELSE 'accepted' END AS status, array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons, CASE WHEN len(hard) > 0 THEN 0.0 ELSE round(cov, 4) END AS coverage FROM s
""")
def pair_status(spark: SparkSession, d: str) -> DataFrame:
    return relational.pair_status(_papers(spark, d)).select("paper", "status", F.array_join("reasons", ",").alias("reasons"), "coverage")


@query(f"""{_PAPERS},
rs AS (SELECT *, list_sort(list_filter([CASE WHEN duplicate_qp > 0 THEN 'duplicate_qp_ids' END, CASE WHEN duplicate_ms > 0 THEN 'duplicate_ms_ids' END, CASE WHEN conflicts > 0 THEN 'parser_conflicts' END, CASE WHEN issues > 0 THEN 'pairing_issues' END,
  CASE WHEN unmatched_qp > 0 THEN 'unmatched_qp' END, CASE WHEN unmatched_ms > 0 THEN 'unmatched_ms' END, CASE WHEN mcq AND missing_qp > 0 THEN 'missing_qp_questions' END, CASE WHEN mcq AND missing_ms > 0 THEN 'missing_ms_questions' END,
  CASE WHEN NOT mcq AND invalid_qp > 0 THEN 'invalid_qp_ids' END, CASE WHEN NOT mcq AND invalid_ms > 0 THEN 'invalid_ms_ids' END, CASE WHEN NOT mcq AND matched / greatest(n_qp, n_ms, 1) < 0.8 THEN 'low_coverage_balanced' END], lambda x: x IS NOT NULL)) AS reasons FROM p)
SELECT paper, array_to_string(reasons, ',') AS triggers, CAST(10 * matched - 8 * (missing_qp + missing_ms) - 4 * (unmatched_qp + unmatched_ms) - 6 * (conflicts + issues) - 10 * (invalid_qp + invalid_ms) AS BIGINT) AS score FROM rs
""")
def repair_triggers(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d)
    return papers.select("paper", F.array_join(relational.repair_triggers(papers), ",").alias("triggers"), relational.repair_score().alias("score"))


@query(f"""{_PAPERS},
s AS (SELECT CASE WHEN matched = 0 OR n_qp = 0 OR n_ms = 0 THEN 'failed' WHEN qc < 0.75 OR mc < 0.75 OR matched / greatest(n_qp, n_ms, 1) < 0.8 OR invalid_qp + invalid_ms + duplicate_qp + duplicate_ms + conflicts + issues > 0 OR (mcq AND missing_qp + missing_ms > 0) THEN 'review_required' ELSE 'accepted' END AS status FROM p)
SELECT count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM s
""")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return relational.status_totals(relational.pair_status(_papers(spark, d)))


@query("""
WITH p AS (SELECT l_orderkey AS paper, l_orderkey % 3 = 0 AS mcq, count(*) AS n_items, count(DISTINCT l_linenumber) AS n_keys, sum(l_quantity) AS n_words FROM lineitem GROUP BY ALL)
SELECT paper, CASE WHEN mcq THEN n_keys < greatest(5, floor(7 * 0.9)) ELSE (n_items = 1 AND n_words > 40) OR 1 - n_keys / greatest(n_items, 1) > 0.35 END AS ambiguous FROM p
""")
def ambiguous_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.count("*").alias("n_items"), F.count_distinct("l_linenumber").alias("n_keys"), (F.sum("l_quantity") + 210).alias("n_words"))
    rows = rows.withColumns({"mcq": F.col("paper") % 3 == 0, "n_numbers": F.col("n_keys"), "expected": F.lit(7)})
    return rows.select("paper", relational.is_ambiguous(rows).alias("ambiguous"))


@query("""
WITH s AS (SELECT o_orderkey AS id, coalesce(o_orderpriority, '') || '|' || (1990 + o_orderkey % 30) || '|' || o_orderstatus || '|' || (o_custkey % 4) || '|' || (o_custkey % 3) AS k, o_orderpriority AS subject, 1990 + o_orderkey % 30 AS year, o_orderstatus AS session, o_custkey % 4 AS paper, o_custkey % 3 AS variant FROM orders)
SELECT id, row_number() OVER (PARTITION BY subject ORDER BY year, session, paper, variant, id) AS place FROM s
""")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """The five keys that papers under review are sorted by, as places within a subject."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), (1990 + F.col("o_orderkey") % 30).alias("year"), F.col("o_orderstatus").alias("session"), (F.col("o_custkey") % 4).cast("string").alias("paper"), (F.col("o_custkey") % 3).cast("string").alias("variant"))
    order = relational.paper_order("subject", "year", "session", "paper", "variant")
    return relational.placed(rows, "subject", F.coalesce(F.col("year"), F.lit(0)).cast("int"), *order[1:], F.col("id")).select("id", "place")


@query("""
WITH n AS (SELECT p_partkey AS id, p_partkey % 7 AS k, upper(p_name[1]) || p_name[2:] AS subject, 1990 + p_size AS year, CASE WHEN p_size % 2 = 0 THEN 'May_June' ELSE 'Oct_Nov' END AS session, p_partkey % 6 + 1 AS paper, p_size % 3 + 1 AS variant, ['QP', 'MS', 'IN', 'ER', 'GT'][p_partkey % 5 + 1] AS kind, lower(p_type) || ' and ' || p_brand AS topic FROM part)
SELECT id, CASE WHEN k <= 1 THEN 'exam_paper' WHEN k = 2 THEN 'session_doc' WHEN k = 3 OR k = 5 THEN 'topical' WHEN k = 4 THEN 'syllabus' END AS category, CASE WHEN k = 5 THEN replace(subject, ' ', '_') WHEN k < 5 THEN subject END AS subject, CAST(CASE WHEN k <= 3 THEN year END AS INTEGER) AS year,
  CASE WHEN k <= 2 THEN session END AS session, CAST(CASE WHEN k <= 1 THEN paper END AS INTEGER) AS paper, CAST(CASE WHEN k = 0 THEN variant END AS INTEGER) AS variant, CASE WHEN k <= 2 THEN kind END AS doc_type, CASE WHEN k IN (3, 5) THEN topic END AS topic,
  CASE k WHEN 0 THEN 9 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 8 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 2 END + CASE WHEN k < 5 THEN 1 ELSE 0 END >= 5 AS has_parts FROM n
""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """What papers' file names say, by five patterns, and by their folders where those fail; names are made of the parts' own fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    subject = F.translate(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000)), " ", "_")
    year, session = (1990 + size).cast("string"), F.when(size % 2 == 0, "May_June").otherwise("Oct_Nov")
    paper, variant, kind = (k % 6 + 1).cast("string"), (size % 3 + 1).cast("string"), pick(k, "qp", "MS", "In", "ER", "gt")
    topic = F.concat(F.lower("p_type"), F.lit("_and_"), F.col("p_brand"))
    join = lambda *parts: F.concat_ws("_", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    names = [
        F.concat(join(subject, year, session, "Paper", paper, "Variant", variant, kind), F.lit(".pdf")), F.concat(join(subject, year, session, "Paper", paper, kind, variant), F.lit(".PDF")), F.concat(join(subject, year, session, kind), F.lit(".pdf")),
        F.concat(F.lit("x/"), join(subject, "5070", "Topical", year, topic, "O_Level_2"), F.lit(".pdf")), F.concat(join(subject, "2147", "Syllabus_Reference", year), F.lit(".pdf")), F.concat(subject, F.lit("/Topicals/"), topic, F.lit(".pdf")), F.concat(subject, F.lit(".txt")),
    ]
    rows = table(spark, d, "part").select(k.alias("id"), F.element_at(F.array(*names), (k % 7 + 1).cast("int")).alias("path")).withColumn("f", readers.path_fields(F.col("path")))
    return rows.select("id", "f.*", readers.name_parts(F.col("path")).isNotNull().alias("has_parts"))


@query("""
WITH p AS (SELECT o_orderkey AS id, ['x', '2010', '2019', '2031', 'May_June'][o_orderkey % 5 + 1] AS y, o_orderkey FROM orders),
r AS (SELECT id, CASE WHEN id % 5 = 4 THEN 'depth' WHEN id % 3 = 2 THEN 'session' WHEN y IN ('x', '2031') THEN 'year' WHEN id % 4 = 3 THEN 'kind' END AS malformed, (id // 60) || '/' || y || '/' || (id % 3) AS grp, CASE WHEN id % 4 = 1 THEN 'ms' ELSE 'qp' END AS kind FROM p),
g AS (SELECT grp, bool_or(kind = 'qp') AS q, bool_or(kind = 'ms') AS m FROM r WHERE malformed IS NULL GROUP BY grp), a AS (SELECT CASE WHEN q AND m THEN 'valid' WHEN q THEN 'missing_ms' ELSE 'missing_qp' END AS outcome FROM g UNION ALL SELECT 'malformed_' || malformed FROM r WHERE malformed IS NOT NULL)
SELECT outcome, count(*) AS n FROM a GROUP BY outcome
""")
def paper_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A folder tree against its schema: complete papers, those that lack a side, and what is malformed."""
    k = F.col("o_orderkey")
    path = F.concat_ws("/", F.floor(k / 60).cast("string"), pick(k, "x", "2010", "2019", "2031", "May_June"), pick(k, "May_June", "Oct_Nov", "Winter"), pick(k, "qp", "ms", "qp", "er"), F.when(k % 5 != 4, F.lit("f.pdf")))
    rows = readers.crawl(table(spark, d, "orders").select(path.alias("path")), {"subject": None, "year": None, "session": ["May_June", "Oct_Nov"], "kind": ["qp", "ms"], "file": None}, 2005, 2025, order=["session", "year", "kind"])
    return readers.crawl_outcomes(rows, ["subject", "year", "session"], "kind").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer)
SELECT CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'year_mismatch' WHEN 2 THEN 'subject_mismatch' ELSE 'unreadable_name' END AS reason, count(*) AS n, array_to_string(list_sort(list('p' || id ORDER BY 'p' || id)[1:3]), ',') AS samples FROM f GROUP BY k
""")
def relocation(spark: SparkSession, d: str) -> DataFrame:
    """Files whose folder and name must agree before they move; others are counted by reason, with samples."""
    k = F.col("c_custkey")
    folder = F.concat(F.lit("Physics/2015/May_June/"), F.lit("p"), k.cast("string"))
    name = pick(k, "Physics_2015_May_June_Paper_2_Variant_1_QP.pdf", "Physics_2016_May_June_Paper_2_Variant_1_QP.pdf", "Biology_2015_May_June_Paper_2_Variant_1_QP.pdf", "scan.pdf")
    rows = readers.relocation_reason(table(spark, d, "customer").select(folder.alias("folder"), name.alias("name"), F.concat(F.lit("p"), k.cast("string")).alias("path")))
    return readers.reason_counts(rows, "reason", "path", 3)


@query("""
WITH f AS (SELECT c_custkey AS id, c_nationkey AS folder, c_custkey AS k FROM customer), w AS (SELECT k AS id, folder, ['physics_s15', 'physics_s15_Variant_2', 'chem_w10'][k % 3 + 1] AS stem FROM f WHERE k % 2 = 0)
SELECT id, CASE id % 3 WHEN 2 THEN 'chem_w10.pdf' ELSE 'physics_s15_qp.pdf' END AS name, CASE WHEN id % 3 = 2 THEN 3 WHEN id % 3 = 1 THEN 2 ELSE 0 END AS rank FROM w
""")
def paper_pick(spark: SparkSession, d: str) -> DataFrame:
    """The file that fits a wanted paper best."""
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").where("c_custkey % 2 = 0").select(k.alias("id"), pick(k, "physics_s15", "physics_s15_Variant_2", "chem_w10").alias("stem"), F.lit("qp").alias("kind"))
    files = table(spark, d, "customer").select(pick(k, "physics_s15", "physics_s15", "chem_w10").alias("stem_key"), pick(k, "physics_s15_qp.pdf", "physics_s15_ms.pdf", "chem_w10.pdf").alias("name")).distinct()
    return review.paper_pick(wanted, files).select("id", "name", "rank")


@query("""
WITH f AS (SELECT DISTINCT c_nationkey AS folder, ['eng_2015_qp.pdf', 'eng_2015_insert.pdf', 'eng_2016_source.pdf', 'eng_2015_ms.pdf', 'notes.txt'][c_custkey % 5 + 1] AS name, c_custkey % 5 AS k FROM customer),
s AS (SELECT a.folder, a.name AS file, b.name AS companion, CASE WHEN a.k = 4 THEN 10 ELSE 12 END AS score FROM f a JOIN f b ON a.folder = b.folder AND a.k <> 2 AND b.k = 2)
SELECT folder, file, companion, score, place FROM (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY score DESC, companion) AS place FROM s) WHERE place <= 2
""")
def companions(spark: SparkSession, d: str) -> DataFrame:
    """Inserts and sources that belong to a paper, by the words of their names."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), pick(F.col("c_custkey"), "eng_2015_qp.pdf", "eng_2015_insert.pdf", "eng_2016_source.pdf", "eng_2015_ms.pdf", "notes.txt").alias("name")).distinct()
    return review.companions(rows).withColumn("place", F.col("place").cast("long"))


@query(r"""
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey % 8 AS k, l_quantity AS y, round(l_discount * 100) AS x, l_extendedprice AS w FROM lineitem)
SELECT page, count(*) AS n, count(*) FILTER (y / 50 BETWEEN 0.08 AND 0.92) AS in_band, count(*) FILTER ((x BETWEEN 1 AND 4 AND y BETWEEN 9 AND 31) OR (x BETWEEN 5 AND 9 AND y BETWEEN 39 AND 51)) AS boxed, count(*) FILTER (k IN (2, 3, 4) OR y < 10) AS noise,
  CASE WHEN bool_or(k = 6) THEN 'data_sheet_page' WHEN bool_or(k = 5) THEN 'blank_page' WHEN count(*) >= 8 AND count(*) FILTER (k IN (0, 1)) / count(*) >= 0.85 AND count(*) FILTER (k NOT IN (3, 4)) <= 2 THEN 'footer_heavy_page' END AS excluded FROM l GROUP BY page
""")
def page_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages: how many lie in the main band, in marked boxes or are noise, and whether a page is left out."""
    k, y, x = F.col("l_partkey") % 8, F.col("l_quantity"), F.col("l_discount") * 100
    text = pick(k, "Please turn over", "Cambridge 2015", "a", "(", "12", "BLANK PAGE", "Data Sheet", "Explain why")
    box = lambda a, b, c, e: F.struct(F.lit(a).alias("x0"), F.lit(b).alias("y0"), F.lit(c).alias("x1"), F.lit(e).alias("y1"))
    boxes = F.array(box(2.0, 10.0, 3.0, 30.0), box(6.0, 40.0, 8.0, 50.0))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), text.alias("text"), pg.in_main_band(y, F.lit(50.0)).alias("band"), pg.in_any_box(F.round(x), y, boxes, 1.0).alias("boxed"), pg.ocr_noise(text, F.lit(100.0), y).alias("noise"))
    agg = rows.groupBy("page").agg(F.count("*").alias("n"), F.count_if("band").alias("in_band"), F.count_if("boxed").alias("boxed"), F.count_if("noise").alias("noise"), F.collect_list("text").alias("lines"))
    return agg.select("page", "n", "in_band", "boxed", "noise", pg.page_excluded(F.col("lines")).alias("excluded"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
a AS (SELECT doc_id, pos, (pos % 6) AS k, (pos - 1) % 900 + 1 AS no, regexp_replace(trim(line), '\s+', ' ', 'g') AS body FROM l),
b AS (SELECT *, CASE k WHEN 1 THEN CAST(no AS VARCHAR) WHEN 2 THEN CAST(no AS VARCHAR) END AS own, CASE k WHEN 1 THEN NULL WHEN 2 THEN '(b)' WHEN 4 THEN '(ii)' END AS sub FROM a WHERE body <> ''),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS number FROM b)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS "at", number, sub, CASE WHEN k = 5 THEN 3 WHEN k = 2 THEN 12 END AS marks FROM c WHERE body <> '' AND k IN (1, 2, 4, 5) AND (k IN (1, 2) OR number IS NOT NULL)
""")
def line_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of lines, the number carried on to parts that stand alone, and the marks that lines name."""
    at = F.col("at") + 1
    no = ((at - 1) % 900 + 1).cast("string")  # numbers of questions have three digits at most
    body = tx.one_line(F.col("line"))
    text = F.when(at % 6 == 1, F.concat(no, F.lit(". "), F.lit("q "), body)).when(at % 6 == 2, F.concat(F.lit(" "), no, F.lit(" (b) q [12] "), body)).when(at % 6 == 4, F.concat(F.lit("(ii) q "), body)).when(at % 6 == 5, F.lit("q 3 marks")).otherwise(F.lit("plain q"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    rows = corpus.anchored_lines(lines.select("doc_id", "at", F.when(body != "", text).otherwise("").alias("line")), "doc_id", "at", "line")
    return rows.where("anchored OR (marks IS NOT NULL AND number IS NOT NULL)").select("doc_id", "at", "number", "sub", "marks")


@query(r"""
WITH l AS (SELECT l_orderkey AS paper, l_linenumber AS page, l_partkey AS k, l_extendedprice AS o FROM lineitem),
g AS (SELECT *, sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper ORDER BY page, o, k) AS item FROM l WHERE k % 9 <> 8)
SELECT paper, CAST(item AS BIGINT) AS item, string_agg(CASE k % 4 WHEN 0 THEN 'Why ' || k ELSE 'line ' || k END, ' ' ORDER BY page, o, k) AS text, min(page) AS page, max(CASE WHEN k % 4 = 3 THEN CAST(k % 10 AS INTEGER) END) AS marks FROM g WHERE item > 0 GROUP BY paper, item
""")
def paper_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines of papers as items: anchors open one, noise goes, marks are what its lines name."""
    k = F.col("l_partkey")
    text = F.when(k % 9 == 8, "Turn over").when(k % 4 == 0, F.concat(F.lit("7 Why "), k.cast("string"))).when(k % 4 == 3, F.concat(F.lit("line "), k.cast("string"), F.lit(" ["), (k % 10).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("line "), k.cast("string")))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("page"), F.struct("l_linenumber", "l_extendedprice", "l_partkey").alias("at"), text.alias("line"))
    return corpus.paper_items(lines, "paper", "at", "page", "line").select("paper", "item", "text", "page", "marks")


_SUBJECTS = "[" + ", ".join(f"'{x}'" for x in pg.HEADERS) + "]"


@query(f"""
WITH c AS (SELECT c_custkey AS id, {_SUBJECTS} AS s, c_custkey % 20 AS i, c_nationkey % 20 AS j, c_name, c_mktsegment FROM customer),
h AS (SELECT id, s, 'Paper of ' || c_name || ' ' || coalesce(upper(s[i + 1]), c_mktsegment) || CASE WHEN id % 3 = 0 THEN ' and ' || coalesce(s[(i + 7) % 19 + 1], '') ELSE '' END AS header, CASE WHEN id % 4 = 0 THEN coalesce(s[i + 1], '') ELSE coalesce(s[j + 1], '') END AS chosen FROM c),
p AS (SELECT id, chosen, list_filter(s, lambda x: contains(lower(header), x))[1] AS printed FROM h)
SELECT id, coalesce(chosen <> '' AND NOT contains(printed, chosen) AND NOT contains(chosen, printed), false) AS conflict, coalesce(printed, 'none') AS printed FROM p
""")
def header_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose printed header names another subject than the one chosen; headers name one subject, two or none."""
    subjects, k = F.array(*map(F.lit, pg.HEADERS)), F.col("c_custkey")
    nth = lambda i: F.get(subjects, i.cast("int"))
    other = F.when(k % 3 == 0, F.concat(F.lit(" and "), F.coalesce(nth((k % 20 + 7) % 19), F.lit("")))).otherwise("")
    header = F.concat(F.lit("Paper of "), F.col("c_name"), F.lit(" "), F.coalesce(F.upper(nth(k % 20)), F.col("c_mktsegment")), other)
    chosen = F.initcap(F.coalesce(nth(F.when(k % 4 == 0, k % 20).otherwise(F.col("c_nationkey") % 20)), F.lit("")))
    return table(spark, d, "customer").select(k.alias("id"), pg.header_conflicts(header, chosen).alias("conflict"), F.coalesce(pg.subject_from_header(header), F.lit("none")).alias("printed"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, line % 4 = 1 OR regexp_matches(t, 'log|[\^_/=+-]') AS math FROM l WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> '' AND line % 4 IN (1, 2)
""")
def reading_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two readings of a text that differ, or that differ in mathematics.

    The second reading adds a sign to some lines, reads others twice, and differs in blanks in the rest.
    """
    return _disagreements(spark, d).select(F.col("page").alias("doc_id"), "line", "math")


def _disagreements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    k = F.col("line") % 4
    other = F.when(k == 1, F.concat("text", F.lit(" ="))).when(k == 2, F.concat("text", F.lit(" "), "text")).when(k == 3, F.concat("text", F.lit(" \t "))).otherwise(F.concat(F.lit(" "), F.col("text")))
    return corpus.disagreements(lines, lines.withColumn("text", other))


@query("""
SELECT l_orderkey AS page, md5(string_agg(CASE WHEN l_partkey % 5 = 0 THEN 'fixed ' || l_partkey ELSE 'read ' || l_partkey END, chr(10) ORDER BY l_linenumber, l_extendedprice, l_partkey)) AS text_md5, count(*) FILTER (l_partkey % 5 = 0) AS repaired FROM lineitem GROUP BY l_orderkey
""")
def repaired_pages(spark: SparkSession, d: str) -> DataFrame:
    """Repaired lines over the read ones, and the pages' text rebuilt from both."""
    key = F.struct("l_linenumber", "l_extendedprice", "l_partkey").alias("line")
    base = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), key, F.concat(F.lit("read "), F.col("l_partkey").cast("string")).alias("text"))
    fixed = table(spark, d, "lineitem").where("l_partkey % 5 = 0").select(F.col("l_orderkey").alias("page"), key, F.concat(F.lit("fixed "), F.col("l_partkey").cast("string")).alias("text"))
    over = relational.overlay(base, fixed, ["page", "line"], ["text"])
    return corpus.rebuilt(over, "page", "line").select("page", F.md5("text").alias("text_md5"), F.size(F.filter(F.split("text", "\n"), lambda t: t.startswith("fixed"))).cast("long").alias("repaired"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS before, o_totalprice / 500000 + (o_orderkey % 5 - 2) / 100.0 AS after, o_custkey % 100 / 100.0 AS rival FROM orders)
SELECT id, after >= before AND after >= rival AS accepted, id % 2 = 0 AND (before < 0.75 OR id % 3 = 0) AS escalate FROM s
""")
def repair_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a repaired reading counts, and whether a page is read a second time."""
    k, before = F.col("o_orderkey"), F.col("o_totalprice") / 500000
    flags = F.when(k % 3 == 0, F.array(F.lit("potential_subscript_loss"))).otherwise(F.array(F.lit("missing_answer")))
    after = before + (k % 5 - 2) / 100.0
    return table(spark, d, "orders").select(k.alias("id"), pg.repair_accepted(before, after, F.array(F.col("o_custkey") % 100 / 100.0)).alias("accepted"), pg.escalate(k % 2 == 0, before, flags, ["potential_subscript_loss"]).alias("escalate"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_manifest' WHEN o_orderkey % 7 = 1 THEN 'missing_records' WHEN o_orderkey % 7 = 2 THEN 'missing_embeddings' WHEN o_orderkey % 7 = 3 THEN 'auto_rebuild_disabled' WHEN o_orderkey % 5 = 0 THEN 'source_signature_changed'
  WHEN o_orderkey % 5 = 1 THEN 'record_count_changed' WHEN o_orderkey % 5 = 2 THEN 'index_version_changed' ELSE 'up_to_date' END AS reason FROM orders
""")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    """The first reason to build an index anew, or none."""
    k = F.col("o_orderkey")
    was = {f: F.lit("1") for f in review.INDEX_FIELDS}
    now = was | {"source_signature": F.when(k % 5 == 0, "2").otherwise("1"), "record_count": F.when(k % 5 == 1, "2").otherwise("1"), "index_version": F.when(k % 5 == 2, F.lit(None)).otherwise("1")}
    rows = table(spark, d, "orders").select(k.alias("id"), F.struct(*[v.alias(f) for f, v in was.items()]).alias("m"), F.struct(*[v.alias(f) for f, v in now.items()]).alias("c"), F.struct((k % 7 != 0).alias("manifest"), (k % 7 != 1).alias("records"), (k % 7 != 2).alias("embeddings")).alias("p"), (k % 7 != 3).alias("auto"))
    return rows.select("id", review.rebuild_reason(F.col("m"), F.col("c"), F.col("p"), F.col("auto")).alias("reason"))


@query("""
WITH r AS (SELECT l_orderkey AS paper, l_linenumber AS at, l_linenumber + 1 AS number, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'plain' ELSE 'head' || chr(10) || (l_linenumber + 2) || ' tail ' || l_partkey END AS scheme FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
j AS (SELECT a.paper, a.at AS need_at, a.number AS need, b.at AS from_at, b.scheme, row_number() OVER (PARTITION BY a.paper, a.at ORDER BY b.at) AS k FROM r a JOIN r b ON a.paper = b.paper AND b.at < a.at AND contains(b.scheme, chr(10) || a.number || ' ') WHERE a.scheme IS NULL)
SELECT paper, need_at, need, from_at, substr(scheme, instr(scheme, ' ') + 1) AS tail FROM j WHERE k = 1
""")
def leaked_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Schemes that ran on into the next question's, given back to it."""
    line = table(spark, d, "lineitem")
    first = line.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_partkey", "l_extendedprice")).alias("k"))
    n = F.col("l_linenumber")
    scheme = F.when(F.col("k") % 3 == 1, "plain").when(F.col("k") % 3 == 2, F.concat(F.lit("head\n"), (n + 2).cast("string"), F.lit(" tail "), F.col("k").cast("string")))
    rows = first.select(F.col("l_orderkey").alias("paper"), n.alias("at"), (n + 1).alias("number"), scheme.alias("scheme"))
    return review.reclaim_leaks(rows, "paper", "at")


@query("""
WITH t(pos, name) AS (VALUES (1, 'Furniture'), (2, 'build'), (3, 'auto mobile'), (4, 'Machinery parts'))
SELECT c_custkey AS id, CASE c_mktsegment WHEN 'FURNITURE' THEN 'Furniture' WHEN 'BUILDING' THEN 'build' WHEN 'MACHINERY' THEN 'Machinery parts' END AS name FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING', 'MACHINERY')
""")
def canonical_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics by the names of a list: equal, or one within the other."""
    topics = ["Furniture", "build", "auto mobile", "Machinery parts"]
    return corpus.canonical_topic(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("topic")), topics)


@query("""
SELECT l_orderkey AS paper, len(list_distinct(list(l_linenumber))) = 0 OR len(list_intersect(range(1, 4), list(l_linenumber))) = 0
  OR (len(list_filter(list_distinct(list(l_linenumber)), lambda x: x > 3)) / len(list_distinct(list(l_linenumber))) >= 0.7 AND len(list_intersect(range(1, 4), list(l_linenumber))) / 3 < 0.2) AS other_paper FROM lineitem GROUP BY l_orderkey
""")
def foreign_papers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.collect_list("l_linenumber").alias("seen"))
    return rows.select("paper", pg.foreign_paper(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("seen")).alias("other_paper"))


_BOXES = r"""w AS (SELECT doc_id, i, unnest(ws) AS t, generate_subscripts(ws, 1) - 1 AS j FROM (SELECT doc_id, i, list_filter(string_split_regex(trim(s), '\s+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))),
b AS (SELECT *, 50.0 * j AS x0, 50.0 * j + 40 AS x1, 20.0 * i + j % 3 AS y0, 20.0 * i + 12 + j % 4 AS y1, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')) AS n FROM w), h AS (SELECT doc_id, max(y1) AS h FROM b GROUP BY doc_id),
l AS (SELECT doc_id, i, string_agg(t, ' ' ORDER BY j) AS s, CAST(sum(n) AS BIGINT) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM b GROUP BY doc_id, i),
p AS (SELECT l.*, (y0 + y1) / 2 BETWEEN h * 0.08 AND h * 0.92 AND NOT regexp_matches(lower(s), 'write a precis|suggest a suitable title|suggest title|précis|precis|exercise|question|words|summary') AND (n >= 5 OR (n >= 3 AND regexp_matches(s, '[.,;:]$'))) AS ok FROM l JOIN h USING (doc_id))"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """The words of the documents' lines as boxes, as a scan would place them: not quite even.

    Documents are dealt out whole; their words, many times as large, stay where they are in all that goes by page.
    """
    lines = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    words = lines.select("doc_id", "i", F.posexplode(pg.words(F.col("s"))).alias("j", "text"))
    j, top = F.col("j"), 20.0 * F.col("i")
    return words.select("doc_id", "text", (50.0 * j).alias("x0"), (top + j % 3).alias("y0"), (50.0 * j + 40).alias("x1"), (top + 12 + j % 4).alias("y1"))


_FULL = re.compile(r"[^ \t\n\x0B\f\r]+")


def _placed(batch):
    """``_boxes`` of a batch of documents inside a task: (doc_id, words, their boxes) in turn."""
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        lines = [_FULL.findall(s) for s in (text.as_py() or "").split("\n")]
        sizes = np.array([len(x) for x in lines])
        if not sizes.sum():
            continue
        j = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(float)
        top = 20.0 * np.repeat(np.arange(len(lines)), sizes)
        yield doc, [w for x in lines for w in x], np.array([50.0 * j, top + j % 3, 50.0 * j + 40, top + 12 + j % 4])


@query(rf"""
WITH {_BOXES},
r AS (SELECT b.doc_id, CAST(sum(b.n) AS BIGINT) AS n FROM b WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = b.doc_id AND ok AND (b.x0 + b.x1) / 2 BETWEEN p.x0 - 8 AND p.x1 + 8 AND (b.y0 + b.y1) / 2 BETWEEN p.y0 - 5 AND p.y1 + 5) GROUP BY b.doc_id),
d AS (SELECT b.doc_id, CAST(coalesce(sum(n) FILTER (length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) > 1 AND (y0 + y1) / 2 BETWEEN h * 0.08 AND h * 0.92), 0) AS BIGINT) AS n FROM b JOIN h USING (doc_id) GROUP BY b.doc_id),
t AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS by_lines, CAST(sum(n) AS BIGINT) AS by_text, length(coalesce(string_agg(s, ' ' ORDER BY i) FILTER (ok), string_agg(s, ' ' ORDER BY i))) AS chars FROM p GROUP BY doc_id),
e AS (SELECT doc_id, by_lines, coalesce(r.n, 0) AS in_regions, d.n AS in_band, CAST(round_even(chars / 5.2, 0) AS BIGINT) AS by_length, by_text FROM t JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, list_sort(list_filter([by_lines, by_lines, in_regions, CAST(round_even(in_band * 0.80, 0) AS BIGINT), CAST(round_even(by_length * 0.90, 0) AS BIGINT), CAST(round_even(by_text * 0.75, 0) AS BIGINT)], lambda x: x > 0)) AS g FROM e),
m AS (SELECT *, CASE WHEN len(g) = 0 THEN 0 WHEN len(g) % 2 = 1 THEN g[len(g) // 2 + 1] ELSE CAST(round_even((g[len(g) // 2] + g[len(g) // 2 + 1]) / 2.0, 0) AS BIGINT) END AS k FROM v)
SELECT doc_id, CAST(CASE WHEN k < 80 AND by_length >= 100 THEN greatest(k, round_even(by_length * 0.85, 0)) ELSE k END AS INTEGER) AS words, CAST(by_lines AS INTEGER) AS by_lines, CAST(in_regions AS INTEGER) AS in_regions, CAST(in_band AS INTEGER) AS in_band,
  CAST(by_length AS INTEGER) AS by_length, CAST(by_text AS INTEGER) AS by_text FROM m
""")
def passage_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document's passage by the middle of six estimates, all from the boxes of its words, which are made a
    document at a time: as rows they are many times as large as the text."""
    return geometry.passages_by_page(dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", _placed)


@query(rf"""
WITH {_BOXES}, f AS (SELECT doc_id, x0 + 60 AS x0, y0 + 3 AS y0, x0 + 60 + 40 * (i % 7) AS x1, y0 + 45 AS y1 FROM l WHERE i % 3 = 1)
SELECT b.doc_id, count(*) AS n, CAST(sum(b.n) AS BIGINT) AS words FROM b WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id AND (b.x0 + b.x1) / 2 BETWEEN f.x0 - 2 AND f.x1 + 2 AND (b.y0 + b.y1) / 2 BETWEEN f.y0 - 1 AND f.y1 + 1) GROUP BY b.doc_id
""")
def words_in_figures(spark: SparkSession, d: str) -> DataFrame:
    """How many words of a page lie in marked boxes, each once however many boxes hold it."""
    boxes = _boxes(spark, d)
    lines = geometry.line_boxes(boxes.withColumn("line", F.floor(F.col("y0") / 20)), "doc_id").where("line % 3 = 1")
    figures = lines.select("doc_id", (F.col("x0") + 60).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x0") + 60 + 40 * (F.col("line") % 7)).alias("x1"), (F.col("y0") + 45).alias("y1"))
    points = boxes.select("doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), geometry.word_count(F.col("text")).alias("k"))
    return geometry.points_in_boxes(points, figures, "doc_id", 2.0, 1.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("words"))


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: len(list_filter(string_split_regex(trim(s), '\s+'), lambda w: w <> ''))) AS n FROM documents),
e AS (SELECT doc_id, unnest(n) AS n, generate_subscripts(n, 1) AS i FROM l)
SELECT doc_id, CAST(coalesce(max(n) FILTER (n >= 4), 0) AS INTEGER) AS longest_line, count(*) AS lines FROM e GROUP BY doc_id
""")
def longest_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    counts = F.transform(lines, lambda s: F.size(pg.words(s)))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_max(F.filter(counts, lambda n: n >= 4)), F.lit(0)).alias("longest_line"), F.size(lines).cast("long").alias("lines"))


@query(rf"""
WITH t AS (SELECT doc_id, text, regexp_replace(trim(text), '\s+', ' ', 'g') AS c, {_T.format("text")} AS w FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(replace(lower(trim(source)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, len(w) >= 2 AS anchored, doc_id % 3 = 0 AS on_page, contains(text, '@') AND regexp_full_match(trim(split_part(text, chr(10), 1)), '[^\s@]+@[^\s@]+\.[^\s@]+') AS email,
  CASE doc_id % 4 WHEN 0 THEN doc_id % 9 WHEN 1 THEN doc_id % 20 WHEN 2 THEN NULL ELSE NULL END AS marks, CASE WHEN doc_id % 4 = 0 THEN least(doc_id % 9, doc_id % 5) ELSE 0 END AS low, CASE WHEN doc_id % 4 = 0 THEN greatest(doc_id % 9, doc_id % 5) ELSE 0 END AS high,
  ['q7b', '12', 'a3', '9'][doc_id % 4 + 1] AS number_key, ['What is it', 'The reason', 'X', 'N/A'][doc_id % 4 + 1] AS bare, doc_id % 4 IN (0, 2) AS usable, doc_id % 4 = 1 AS mcq_like, array_to_string([['political-science-rubric', 'political-science'], ['history'], ['a-b'], []][doc_id % 4 + 1], ',') AS variants
FROM t JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
""")
def text_fields(spark: SparkSession, d: str) -> DataFrame:
    """Small fields of texts: slugs, keys, labels, marks, ranges, quotations, and what they look like."""
    k, x = F.col("doc_id"), F.col("text")
    n = lambda m: (k % m).cast("string")
    marked = F.when(k % 4 == 0, F.concat(F.lit("Explain ["), n(9), F.lit("]"))).when(k % 4 == 1, F.concat(F.lit("worth "), n(20), F.lit(" Marks"))).otherwise("none")
    span = F.when(k % 4 == 0, F.concat(n(9), F.lit("–"), n(5))).otherwise("many")
    first = F.substring_index("plain", " ", 3)
    page = F.when(k % 3 == 0, F.concat(F.lit("Page: "), F.lit("The quick, brown fox jumps over the lazy dog again"))).otherwise("nothing here")
    scheme = pick(k, "three from: photosynthesis needs light", "two from: x", "Award 1 for the correct named process", "working space")
    stem = pick(k, "too short", "Which of these is an acid", "12 34 56 78 90", "Turn over")
    # unfolded, so that a text is normalised once
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("*", F.explode(F.array(tx.normalize(x))).alias("plain"))
    return docs.select(
        "doc_id", tx.slug(F.col("source")).alias("slug"), pg.anchored_in(F.col("plain"), first).alias("anchored"), pg.on_page(page, F.lit("the Quick brown fox jumps over the lazy dog")).alias("on_page"),
        ex.is_email(F.trim(F.split_part(x, F.lit("\n"), F.lit(1)))).alias("email"), tx.marks_in(marked).cast("long").alias("marks"), tx.mark_range(span)["low"].cast("long").alias("low"), tx.mark_range(span)["high"].cast("long").alias("high"),
        tx.number_key(pick(k, "Q q7(b)", "Question 12", " a-3", "9.")).alias("number_key"), F.when(k % 4 == 0, tx.without_label(F.lit("Q.  What is  it"), "question")).when(k % 4 == 1, tx.without_label(F.lit("Ans: The reason"), "answer")).when(k % 4 == 2, tx.without_label(F.lit("A. X"), "answer")).otherwise(tx.without_label(F.lit("N/A"), "question")).alias("bare"),
        pg.scheme_usable(scheme).alias("usable"), pg.mcq_stem(stem).alias("mcq_like"), F.array_join(tx.subject_variants(pick(k, "Political Science Rubric", " History ", "A__B!", "?")), ",").alias("variants"),
    )


@query(rf"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
n AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS y, len(list_filter(string_split_regex(trim(t), '\s+'), lambda w: w <> '')) AS k FROM l),
r AS (SELECT *, ['Q. ', 'question ', 'Q', ''][line % 4 + 1] || t AS asked, ['Ans: ', 'answer - ', 'A. ', ''][line % 4 + 1] || t AS told, 'Question ' || line || ' (' || chr(CAST(97 + line % 26 AS INTEGER)) || ')' AS number,
  t || CASE line % 3 WHEN 0 THEN ' [' || k || ']' WHEN 1 THEN ' ' || k || ' Marks' ELSE '' END AS marked, k || CASE line % 3 WHEN 0 THEN '–' WHEN 1 THEN ' to ' ELSE ' and ' END || line AS span FROM n),
m AS (SELECT *, regexp_extract(span, '(\d+)\s*(?:–|to)\s*(\d+)', 1) AS lo, regexp_extract(span, '(\d+)\s*(?:–|to)\s*(\d+)', 2) AS hi FROM r)
SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_replace(regexp_replace(lower(number), '^q(uestion)?\s*', ''), '[^a-z0-9]', '', 'g') AS number_key,
  md5(trim(regexp_replace(trim(regexp_replace(asked, '\s+', ' ', 'g')), '(?i)^\s*(?:q(?:uestion)?\.?\s*)', ''))) AS asked_md5, md5(trim(regexp_replace(trim(regexp_replace(told, '\s+', ' ', 'g')), '(?i)^\s*(?:ans(?:wer)?\.?\s*[:\-]?|a\.?\s*)', ''))) AS told_md5,
  CAST(coalesce(nullif(regexp_extract(marked, '(?i)\[(\d{{1,3}})\]|(\d{{1,3}})\s*marks?', 1), ''), nullif(regexp_extract(marked, '(?i)\[(\d{{1,3}})\]|(\d{{1,3}})\s*marks?', 2), ''), '0') AS INTEGER) AS marks,
  CASE WHEN lo = '' THEN 0 ELSE least(CAST(lo AS INTEGER), CAST(hi AS INTEGER)) END AS low, CASE WHEN lo = '' THEN 0 ELSE greatest(CAST(lo AS INTEGER), CAST(hi AS INTEGER)) END AS high,
  lower(source) || '-rubric,' || lower(source) AS variants, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') <> '' AS on_page, length(regexp_replace(t, '(?i)[^a-z0-9]', '', 'g')) >= 16 AS usable,
  k >= 3 AND regexp_matches(y, '[A-Za-z]') AND (contains(y, '?') OR regexp_matches(lower(y), 'which|what|how|statement|explain|describe') OR k >= 5 OR regexp_matches(y, '^[A-Z]')) AS stem FROM m
""")
def line_fields(spark: SparkSession, d: str) -> DataFrame:
    """Small fields of every line: keys, texts without their labels, marks, ranges, variants of names, where a line stands."""
    lines = table(spark, d, "documents").select("doc_id", "source", pg.bare(F.col("text")).alias("page"), "text").select("doc_id", "source", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    at, t = F.col("line"), F.col("t")
    k = F.size(pg.words(t)).cast("string")
    label = lambda *names: F.concat(pick(at, *names), t)
    marked = F.concat(t, F.when(at % 3 == 0, F.concat(F.lit(" ["), k, F.lit("]"))).when(at % 3 == 1, F.concat(F.lit(" "), k, F.lit(" Marks"))).otherwise(""))
    span = tx.mark_range(F.concat(k, pick(at, "–", " to ", " and "), at.cast("string")))
    number = F.concat(F.lit("Question "), at.cast("string"), F.lit(" ("), F.chr(97 + at % 26), F.lit(")"))
    return lines.select(
        "doc_id", "line", tx.number_key(number).alias("number_key"), F.md5(tx.without_label(label("Q. ", "question ", "Q", ""), "question")).alias("asked_md5"), F.md5(tx.without_label(label("Ans: ", "answer - ", "A. ", ""), "answer")).alias("told_md5"),
        F.coalesce(tx.marks_in(marked), F.lit(0)).alias("marks"), span["low"].alias("low"), span["high"].alias("high"), F.array_join(tx.subject_variants(F.concat("source", F.lit(" Rubric"))), ",").alias("variants"),
        pg.on_bare_page(F.col("page"), t).alias("on_page"), pg.scheme_usable(t).alias("usable"), pg.mcq_stem(t).alias("stem"),
    )


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT doc_id, line, line // 12 AS page, line % 12 AS k, trim(regexp_replace(t, '\s+', ' ', 'g')) AS body FROM l),
f AS (SELECT *, bool_or(k = 11 AND page % 3 = 1) OVER (PARTITION BY doc_id, page) AS blank FROM b),
g AS (SELECT *, sum(CASE WHEN k IN (0, 4, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS item, CASE WHEN k IN (0, 4, 6) THEN page % 200 + 1 END AS own,
  CASE k WHEN 4 THEN '(b)' WHEN 6 THEN '(iv)' END AS sub, CASE k WHEN 7 THEN '999 t ' || body ELSE 't ' || body END AS said FROM f WHERE NOT blank AND k <> 9)
SELECT doc_id, CAST(item AS BIGINT) AS item, CAST(max(own) AS INTEGER) AS number, coalesce(max(sub), '') AS sub, md5(trim(regexp_replace(string_agg(said, ' ' ORDER BY line), '\s+', ' ', 'g'))) AS text_md5, CAST(min(page) AS BIGINT) AS page, coalesce(max(CASE WHEN k = 6 THEN 3 + page % 5 END), 0) AS marks FROM g GROUP BY doc_id, item
""")
def structured_papers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents set as papers of pages: questions, parts, marks, noise, numbers out of range, and blank pages."""
    at = F.col("line")
    page, k = F.floor(at / 12), at % 12
    number = (page % 200 + 1).cast("string")
    body = F.concat(F.lit("t "), tx.one_line(F.col("t")))
    set_ = (
        F.when(k == 0, F.concat(number, F.lit(". "), body)).when(k == 4, F.concat(F.lit("(b)  "), body)).when(k == 6, F.concat(number, F.lit(" (iv) "), body, F.lit(" ["), (3 + page % 5).cast("string"), F.lit("]")))
        .when(k == 7, F.concat(F.lit("999 "), body)).when(k == 9, "Please turn over").when((k == 11) & (page % 3 == 1), "BLANK PAGE").otherwise(body)
    )
    lines = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).select("doc_id", "line", page.alias("page"), set_.alias("t"))
    items = corpus.structured_items(lines, "doc_id", "page", "line", "t")
    return items.select("doc_id", "item", "number", F.coalesce("sub", F.lit("")).alias("sub"), F.md5("text").alias("text_md5"), "page", F.coalesce("marks", F.lit(0)).alias("marks"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
p AS (SELECT doc_id, line // 10 AS page, string_agg(CASE WHEN line % 4 = 1 THEN t || ' (fixed)' ELSE t END, chr(10) ORDER BY line) FILTER (t <> '' OR line % 4 = 1) AS t FROM l GROUP BY doc_id, line // 10)
SELECT doc_id, md5(trim(string_agg(t, chr(10) || chr(10) || '[[PAGE_BREAK]]' || chr(10) || chr(10) ORDER BY page))) AS text_md5, count(*) AS pages FROM p WHERE t IS NOT NULL GROUP BY doc_id
""")
def rebuilt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents rebuilt page by page from read lines and the repairs of some."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("page", F.floor(F.col("line") / 10))
    fixed = lines.where("line % 4 = 1").withColumn("text", F.concat("text", F.lit(" (fixed)")))
    over = relational.overlay(lines, fixed, ["doc_id", "page", "line"], ["text"])
    return corpus.rebuilt_document(over, "doc_id", "page", "line").select("doc_id", F.md5("text").alias("text_md5"), "pages")


@query(r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS page, trim(regexp_replace(t, '\s+', ' ', 'g')) AS q, split_part(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ', 1) AS a FROM l),
m AS (SELECT *, len(list_filter(string_split(q, ' '), lambda w: w <> '')) AS k FROM n)
SELECT doc_id, CAST(line AS INTEGER) AS line, q <> '' AND k >= CASE WHEN k <= 4 THEN 2 ELSE 4 END AND line % 3 = 2 AND regexp_matches(a, '^[A-Za-z0-9_]') AND regexp_matches(a, '[A-Za-z0-9_]$') AS holds FROM m WHERE regexp_full_match(a, '[\x21-\x7E]*')
""")
def checked_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of lines' first words: those that change signs or letter case alone say nothing."""
    lines = table(spark, d, "documents").select("doc_id", pg.flat(F.col("text")).alias("page"), "text").select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    wrong = F.split_part(tx.one_line(F.col("t")), F.lit(" "), F.lit(1))
    right = F.when(F.col("line") % 3 == 0, F.concat(wrong, F.lit(","))).when(F.col("line") % 3 == 1, F.upper(wrong)).otherwise(F.concat(wrong, F.lit("x")))
    return lines.where(wrong.rlike(r"^[\x21-\x7E]*$")).select("doc_id", "line", pg.correction_holds_in(F.col("page"), F.col("t"), wrong, right).alias("holds"))


@query(r"""
WITH t AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, doc_id % 3 = 0 AS tail FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN md5('') ELSE md5(t || CASE WHEN tail THEN ' ' ELSE '  ' END) END AS text_md5, substr(regexp_replace(lower(source), '[^a-z0-9]', '', 'g') || 'zoenanduste', 1, 20) AS slug FROM t
""")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without what publishers and scans leave in them, and short names without accents."""
    x, tail = F.col("text"), F.col("doc_id") % 3 == 0
    left = F.concat(F.lit(" DFD ,, "), x, F.lit(" BLANK PAGE"), F.when(tail, " 12 Copyright Acknowledgements: and all\nthat follows").otherwise(" at www.cambridgeinternational.org after the live examination series."))
    return table(spark, d, "documents").select("doc_id", F.md5(pg.without_boilerplate(left)).alias("text_md5"), pg.name_slug(F.concat("source", F.lit(" Zoë-Ñandú Ște 日"))).alias("slug"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of each turn: as it is, with letters confused, and with a formula; their confidences vary."""
    turns = dealt(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text"), "page")
    confused = F.replace(F.replace("text", F.lit("rn"), F.lit("m")), F.lit("th"), F.lit("tn"))
    texts = F.array(F.col("text"), confused, F.concat("text", F.lit(" (x^2 + y_1) = 3a")))
    rows = turns.select("page", F.posexplode(texts).alias("at", "text"))
    return rows.withColumn("confidence", 0.6 + (F.col("page") + 7 * F.col("at")) % 11 / 40.0)


@query()
def repaired_best_readings(spark: SparkSession, d: str) -> DataFrame:
    """Each page's best reading with a repair that adds or loses something, scored again among the others."""
    rows = _readings(spark, d)
    whole = rows.where("at = 0")
    repairs = whole.select("page", F.when(F.col("page") % 2 == 0, F.concat("text", F.lit(" Answer: log x = [2]"))).otherwise(F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("text"))
    found = review.repaired_readings(rows, repairs, "page")
    return found.select("page", "before", "after", "accepted", F.md5("text").alias("text_md5"))


@query()
def visual_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents next to what a scan may have made of them: which pairs are easily confused."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("at", "word"))
    other = F.when(F.col("at") % 3 == 0, F.regexp_replace("word", "[ae]", "o")).when(F.col("at") % 3 == 1, F.regexp_replace("word", "u", "v")).otherwise(F.concat("word", F.lit("x")))
    return rows.groupBy("doc_id").agg(F.count_if(ex.confusable(F.col("word"), other)).alias("confused"), F.count("*").alias("n"))


@query()
def inline_options(spark: SparkSession, d: str) -> DataFrame:
    """Options A to D at the end of questions that are built from documents' first words."""
    w = lambda i: F.coalesce(F.get(tx.tokens(F.col("text")), F.lit(i)), F.lit("none"))
    q = F.concat(F.lit("Which? A "), w(0), F.lit(" B "), w(1), F.lit(" C "), w(2), F.lit(" D "), w(3))
    rows = table(spark, d, "documents").select("doc_id", udfs.inline_options(q).alias("o"))
    return rows.select("doc_id", F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["label"], x["text"])), ";").alias("options"))
