"""Sources and sinks: nested course files, path and file-name schemas, upserts, CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "struct<question_number:string,sub_question:string,question_text:string,marking_scheme:string,page_number:int>"
COURSE = f"map<string,map<string,map<string,map<string,array<{ENTRY}>>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def course_records(files: DataFrame, source: str = "main", levels: list[str] | None = None) -> DataFrame:
    """``files(path, content)`` of year > session > paper > variant > entries -> one row for each entry.

    ``question_id`` names the source and its ``levels`` (all four if none are given).
    """
    out = files.select("path", F.from_json("content", COURSE).alias("m"))
    for name in ("year", "session", "paper", "variant"):
        out = out.select("*", F.explode("m").alias(name, "_next")).drop("m").withColumnRenamed("_next", "m")
    out = out.select("path", "year", "session", "paper", "variant", F.posexplode("m").alias("position", "e"))
    record = F.concat_ws("|", F.lit(source), *(levels or ["year", "session", "paper", "variant"]), F.concat(F.col("e.question_number"), F.coalesce(F.col("e.sub_question"), F.lit(""))))
    return out.select("path", F.col("year").try_cast("int").alias("year"), "session", "paper", "variant", "position", "e.*", record.alias("question_id"))


def read_course_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return course_records(files)


def accepted_pairs(summaries: DataFrame, questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of papers whose summary is accepted: each question with the first entry of its key."""
    key = ["paper_id", "question_number", "sub"]
    keyed = lambda d: d.withColumn("sub", F.coalesce(F.lower("sub_question"), F.lit("")))
    first = Window.partitionBy(*key).orderBy("position")
    once = keyed(entries).withColumn("r", F.row_number().over(first)).where("r = 1").select(*key, "marking_scheme")
    good = summaries.where(F.col("status") == "accepted").select("paper_id")
    return keyed(questions).join(good, "paper_id", "left_semi").join(once, key, "left").drop("sub")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return parse_lines(spark.read.text(path), schema)


#: fixed values: name patterns, tried in this order; groups are subject, year, session, paper, variant, document type
FILE_NAMES = [
    ("exam_paper", r"(?i)^(.+?)_(\d{4})_(May_June|Oct_Nov)_Paper_(\d+)_Variant_(\d+)_(QP|MS|IN|ER|GT|PDF|SY|IR)(?:_\d+)?\.pdf$", (1, 2, 3, 4, 5, 6)),
    ("exam_paper", r"(?i)^(.+?)_(\d{4})_(May_June|Oct_Nov)_Paper_(\d+)_(QP|MS|IN|ER|GT|PDF|SY|IR)(?:_\d+)?\.pdf$", (1, 2, 3, 4, None, 5)),
    ("session_doc", r"(?i)^(.+?)_(\d{4})_(May_June|Oct_Nov)_(QP|MS|IN|ER|GT|PDF|SY|IR)(?:_\d+)?\.pdf$", (1, 2, 3, None, None, 4)),
    ("topical", r"(?i)^(.+?)_\d+_Topical_(\d{4})_(.+?)_O_Level.*\.pdf$", (1, 2, None, None, None, None, 3)),
    ("syllabus", r"(?i)^(.+?)_\d+_Syllabus_Reference_.*\.pdf$", (1, None, None, None, None, None)),
]


def file_name_fields(name: Column) -> Column:
    """(category, subject, year, session, paper, variant, doc_type, topic) of a paper's file name; null if it fits none."""
    fields = ("subject", "year", "session", "paper", "variant", "doc_type", "topic")
    out = None
    for category, pattern, groups in FILE_NAMES:
        parts = {f: F.lit(None).cast("string") if g is None else F.regexp_extract(name, pattern, g) for f, g in zip(fields, (*groups, None)[:7], strict=True)}
        made = F.struct(
            F.lit(category).alias("category"), F.translate(parts["subject"], "_", " ").alias("subject"), parts["year"].cast("int").alias("year"),
            parts["session"].alias("session"), parts["paper"].cast("int").alias("paper"), parts["variant"].cast("int").alias("variant"), F.upper(parts["doc_type"]).alias("doc_type"), F.translate(parts["topic"], "_", " ").alias("topic"),
        )
        out = F.when(name.rlike(pattern), made) if out is None else out.when(name.rlike(pattern), made)
    return out


def path_fields(path: Column) -> Column:
    """``file_name_fields`` of a path's last part; a file in a folder <Subject>/Topicals is topical whatever its name."""
    parts = F.split(path, "/")
    subject, topic = F.get(parts, F.size(parts) - 3), F.translate(F.regexp_replace(F.element_at(parts, -1), r"(?i)\.pdf$", ""), "_", " ")
    none = F.lit(None)
    folder = F.struct(
        F.lit("topical").alias("category"), subject.alias("subject"), none.cast("int").alias("year"), none.cast("string").alias("session"), none.cast("int").alias("paper"), none.cast("int").alias("variant"),
        none.cast("string").alias("doc_type"), topic.alias("topic"),
    )
    return F.coalesce(file_name_fields(F.element_at(parts, -1)), F.when(F.lower(F.get(parts, F.size(parts) - 2)) == "topicals", folder))


def name_parts(path: Column) -> Column:
    """(subject, year, session, paper, variant) of a name of five parts or more between underscores; null if it has fewer."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.pdf", ""), "_")
    return F.when(F.size(parts) >= 5, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("subject", "year", "session", "paper", "variant"))]))


def crawl(paths: DataFrame, levels: dict[str, list[str] | None], first_year: int, last_year: int, order: list[str] | None = None) -> DataFrame:
    """``paths(path)`` checked against a folder schema: ``levels`` names each part and what it may be (None: anything).

    ``malformed`` is the first level that is wrong, in ``order``.
    """
    parts = F.split("path", "/")
    names = list(levels)
    out = paths.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)})
    reason = F.when(F.size(parts) != len(levels), "depth")
    for name in order or names:
        part = F.get(parts, F.lit(names.index(name)))
        if levels[name] is not None:
            reason = reason.when(~part.isin(levels[name]), name)
        if name == "year":
            reason = reason.when(~F.coalesce(part.try_cast("int").between(first_year, last_year), F.lit(False)), name)
    return out.withColumn("malformed", reason.otherwise(F.lit(None)))


def crawl_outcomes(rows: DataFrame, paper: list[str], kind: str) -> DataFrame:
    """One row for each paper (valid, missing_ms or missing_qp) and for each malformed path, with its ``outcome``."""
    sides = rows.where(F.col("malformed").isNull()).groupBy(*paper).agg(F.bool_or(F.col(kind) == "qp").alias("q"), F.bool_or(F.col(kind) == "ms").alias("m"))
    whole = sides.select(F.when(F.col("q") & F.col("m"), "valid").when(F.col("q"), "missing_ms").otherwise("missing_qp").alias("outcome"), *paper)
    bad = rows.where(F.col("malformed").isNotNull()).select(F.concat(F.lit("malformed_"), F.col("malformed")).alias("outcome"), *paper)
    return whole.unionByName(bad)


def relocation_reason(files: DataFrame) -> DataFrame:
    """``files(folder, name)`` with ``reason``: ok, or the first thing in which a file's name contradicts its folder (subject/year/session)."""
    f, parts = file_name_fields(F.col("name")), F.split("folder", "/")
    at = lambda i: F.get(parts, F.lit(i))
    reason = (
        F.when(f.isNull(), "unreadable_name").when(F.size(parts) < 3, "short_path").when(F.lower(f["subject"]) != F.lower(F.translate(at(0), "_", " ")), "subject_mismatch")
        .when(~f["year"].eqNullSafe(at(1).try_cast("int")), "year_mismatch").when(~F.lower(f["session"]).eqNullSafe(F.lower(at(2))), "session_mismatch").when(~F.coalesce(f["doc_type"].isin("QP", "MS"), F.lit(False)), "other_document").otherwise("ok")
    )
    return files.withColumn("reason", reason)


def reason_counts(rows: DataFrame, reason: str, path: str, samples: int = 20) -> DataFrame:
    """How many rows each reason has, with the first few paths. Only those few are gathered."""
    counts = rows.groupBy(reason).agg(F.count("*").alias("n"))
    few = rows.select(reason, path).withColumn("_r", F.row_number().over(Window.partitionBy(reason).orderBy(path))).where(F.col("_r") <= samples)
    return counts.join(few.groupBy(reason).agg(F.array_join(F.sort_array(F.collect_list(path)), ",").alias("samples")), reason)


def skip_reasons(rows: DataFrame, samples: int = 20) -> DataFrame:
    return reason_counts(rows.where(F.col("malformed").isNotNull()), "malformed", "path", samples)


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Changes replace rows of equal keys; of several changes the first in ``order`` (latest first) counts."""
    newest = keep_latest(changes, keys, order)
    return current.join(newest, keys, "left_anti").unionByName(newest.select(*current.columns))


def replace_set(current: DataFrame, replacement: DataFrame, owner: str) -> DataFrame:
    """All rows of the replaced owners go, the new ones come."""
    return current.join(replacement.select(owner).distinct(), owner, "left_anti").unionByName(replacement)


def insert_new(current: DataFrame, rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content hash is not there yet, each once."""
    hashed = rows.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["content_hash"])
    return hashed.join(current.select("content_hash"), "content_hash", "left_anti")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Parents and children without those that belong to ``gone(key)``."""
    out = {"parent": parents.join(gone.select(key), key, "left_anti")}
    for name, (rows, column) in children.items():
        out[name] = rows.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return out


def csv_cell(x: Column) -> Column:
    """Quoted if it holds a quote, comma or line end; quotes doubled; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("line", F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def backfill_items(documents: DataFrame, owner: str, items: str, id_: str, at: str) -> DataFrame:
    """Items kept in one document for each owner as rows, each id once (its latest)."""
    rows = documents.select(F.col(owner), F.explode(items).alias("_i")).select(owner, "_i.*").where(F.col(id_).isNotNull())
    return keep_latest(rows, [owner, id_], [F.desc(at)])


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (value) of JSON as records; blank ones are skipped."""
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("_r")).select("_r.*")


def document_size(doc: Column) -> Column:
    """Bytes of a document as JSON."""
    return F.octet_length(F.to_json(doc))


def documents(rows: DataFrame, doc: str, most: int = 1_500_000) -> DataFrame:
    """``rows`` with ``doc`` as JSON text; a document above ``most`` bytes fails the write."""
    small = F.when(document_size(F.col(doc)) <= most, F.to_json(doc)).otherwise(F.raise_error(F.lit(f"a document has more than {most} bytes")))
    return rows.withColumn(doc, small)


def read_documents(rows: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """JSON texts as structs; a missing or broken one is null."""
    return rows.withColumn(doc, F.from_json(doc, schema))
