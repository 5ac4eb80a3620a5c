"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm import ann, collocations, decontaminate, exact_topk, html_extract, langid, line_dedup, mixing, ngram_join, ranked_search, substring_dedup, suffix_dedup, token_output
from markwright.llm.common import held_out_bucket, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, with_text=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs, with_text=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.round_trip(docs, token_output.vocabulary("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_components(docs, size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = held_out_bucket(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, keep=2000, inner_percent=50)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_scores(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_mixing, op2_suffix_dedup, op3_decontamination, op4_substring_dedup, op5_line_dedup, op6_nearest_neighbours, op7_token_output, op8_html_extraction, op9_ngram_join, op10_language_id, op11_ranked_search, op12_collocations, op13_exact_topk]
    return {f.__name__: f for f in named}


SQL: dict[str, str] = {}

SQL["op3_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), patterns AS (
  SELECT item, least(10, len(w)) AS m, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS p
  FROM items, range(1, greatest(len(w) - 9, 1) + 1) t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM patterns),
starts AS (
  SELECT doc_id, i, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS p
  FROM words, lengths, range(1, len(w) + 1) t(i) WHERE i + m - 1 <= len(w)
), found AS (SELECT s.doc_id, s.i, s.m, q.item FROM starts s JOIN patterns q ON s.m = q.m AND s.p = q.p),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, range(i, i + m) u(j) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(words.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

SQL["op4_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, list_aggregate(w[i : i + 34], 'string_agg', ' ') AS k FROM t, range(1, greatest(len(w) - 33, 1)) r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j FROM again, range(i, i + 35) u(j)),
words AS (SELECT doc_id, j, w[j] AS word FROM t, range(1, len(w) + 1) u(j)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

SQL["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
wins AS (SELECT doc_id, i, w[i : i + 2] AS k FROM l, range(1, len(w) - 1) t(i) WHERE len(w) >= 3),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM wins),
gone AS (SELECT DISTINCT doc_id, j FROM ranked, range(i, i + 3) u(j) WHERE rn > 1),
cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.w), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN js IS NULL THEN text ELSE coalesce(list_aggregate([l.w[x] FOR x IN range(1, len(l.w) + 1) IF NOT list_contains(js, x)], 'string_agg', chr(10)), '') END, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


SQL["op9_ngram_join"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(list_aggregate(w[i : i + 3], 'string_agg', ' ')) AS k FROM t, range(1, greatest(len(w) - 2, 2)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.r AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) c USING (doc_id)
"""


SQL["op11_ranked_search"] = r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS d, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
docs AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n FROM cut WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM cut) GROUP BY d, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')) AS t FROM benchmark WHERE text IS NOT NULL),
part AS (SELECT d, t, 1000000000 * tf // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS part FROM tf JOIN docs USING (d), total),
scored AS (SELECT item_id, d, CAST(sum(w * part) AS BIGINT) AS score FROM asked JOIN part USING (t) JOIN weight USING (t) GROUP BY item_id, d),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN docs USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

SQL["op12_collocations"] = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split(replace(x, chr(9), ' '), ' '), lambda y: y <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS x FROM documents)),
words AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, x, lead(x, 1) OVER s AS y, lead(x, 2) OVER s AS z FROM words WINDOW s AS (PARTITION BY p ORDER BY i)),
one AS (SELECT lang, x, CAST(count(*) AS BIGINT) AS a FROM runs GROUP BY lang, x),
two AS (SELECT lang, x, y, CAST(count(*) AS BIGINT) AS a FROM runs WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10),
three AS (SELECT lang, x, y, z, CAST(count(*) AS BIGINT) AS a FROM runs WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.a, 1 AS k, b.a AS l, e.a AS r FROM two t JOIN one b ON b.lang = t.lang AND b.x = t.x JOIN one e ON e.lang = t.lang AND e.x = t.y
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 1, b.a, e.a FROM three t JOIN one b ON b.lang = t.lang AND b.x = t.x JOIN two e ON e.lang = t.lang AND e.x = t.y AND e.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 2, b.a, e.a FROM three t JOIN two b ON b.lang = t.lang AND b.x = t.x AND b.y = t.y JOIN one e ON e.lang = t.lang AND e.x = t.z),
scored AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, x || ' ' || y AS phrase, a FROM three UNION ALL SELECT lang, y || ' ' || z, a FROM three) GROUP BY lang, phrase),
placed AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000
"""

SQL["op13_exact_topk"] = r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
