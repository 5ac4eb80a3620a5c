"""Document corpora: dedup groups, chunks, noise lines, validation flags, line assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions import pages as pg
from markwright.functions import text as tx
from markwright.functions import sequences


def dedup_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal normalised texts: size and the member to keep (longest, earliest on ties)."""
    keyed = docs.withColumn("group_key", F.sha1(F.concat_ws("||", F.lit("document"), F.coalesce(tx.normalize(F.col("text")), F.lit("")))))
    best = F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id")))
    return keyed.groupBy("group_key").agg(F.count("*").alias("n"), best.alias("kept_id"), F.min("doc_id").alias("first_id"))


def chunk_budget(rows: DataFrame, header: Column, first: Column, second: Column, idx: Column, most: int = 1600) -> DataFrame:
    """One chunk if all fits in ``most`` characters, else two, the second one cut; indexes 2i and 2i + 1."""
    mark = F.lit("... [truncated]")
    whole = F.concat(header, F.lit("\nQuestion: "), first, F.lit("\nMark Scheme: "), second)
    one, two = F.concat(header, F.lit("\nQuestion: "), first), F.concat(header, F.lit("\nMark Scheme: "), second)
    two = F.when(F.length(two) > most, F.concat(F.substring(two, 1, most - 20), mark)).otherwise(two)
    single = F.array(F.struct((idx * 2).alias("chunk_index"), whole.alias("content")))
    double = F.array(F.struct((idx * 2).alias("chunk_index"), one.alias("content")), F.struct((idx * 2 + 1).alias("chunk_index"), two.alias("content")))
    out = rows.withColumn("c", F.explode(F.when(F.length(whole) <= most, single).otherwise(double)))
    return out.select(*rows.columns, "c.chunk_index", "c.content").withColumn("content_hash", F.sha2("content", 256))


def noise_lines(docs: DataFrame) -> DataFrame:
    kept = tx.kept_lines(F.col("text"))
    n = F.size(F.split("text", "\n", -1))
    return docs.select("doc_id", n.cast("long").alias("lines"), (n - F.size(kept)).cast("long").alias("dropped"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def question_chunks(pages: DataFrame) -> DataFrame:
    """``pages(doc, page, text)`` -> questions: a line that opens with the next expected number opens one.

    The document is one text; a number counts only if it is the one after the last accepted; each chunk ends where the
    next begins and lies on the page of its first character.
    """
    joined = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    # a document is one row from here on: its lines (``ls``), those that carry numbers (``ms``), and what opens (``os``)
    lines = joined.select("doc", F.flatten(F.transform("ps", lambda p: F.transform(F.split(p["text"], "\n", -1), lambda s: F.struct(p["page"].alias("page"), s.alias("line"))))).alias("ls"))
    lines = lines.where(F.size("ls") > 0)
    number = lambda x: F.regexp_extract(x, r"^\s*(\d{1,2})[.)]?\s+(?=[A-Z(])", 1).try_cast("int")
    marks = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("at"), number(x["line"]).alias("number"))), lambda m: m["number"].isNotNull())
    # accept the first line for each number in turn: a fold over the few lines that carry numbers, of two digits at most
    empty = F.array().cast("array<struct<at:int,number:int>>")
    accepted = F.aggregate(marks, F.struct(F.lit(1).alias("want"), empty.alias("got")), lambda a, m: F.when(m["number"] == a["want"], F.struct((a["want"] + 1).alias("want"), F.array_append(a["got"], F.struct(m["at"].alias("at"), m["number"].alias("number"))).alias("got"))).otherwise(a))["got"]
    # what stands before the first question belongs to none
    before = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("number")))
    opens = F.explode(F.array(accepted)).alias("got")
    opened = lines.select("doc", "ls", opens).select("doc", "ls", F.when(F.coalesce(F.get("got", F.lit(0))["at"], F.lit(-1)) == 0, F.col("got")).otherwise(F.concat(before, F.col("got"))).alias("os"))
    chunk = lambda o, i: F.slice("ls", o["at"] + 1, F.coalesce(F.get("os", i + 1)["at"], F.size("ls")) - o["at"])
    chunks = F.transform("os", lambda o, i: F.struct(o["number"].alias("question"), F.get("ls", o["at"])["page"].alias("page"), F.array_join(F.transform(chunk(o, i), lambda x: x["line"]), "\n").alias("chunk")))
    return opened.select("doc", F.inline(chunks))


#: fixed values: when a reading's confidences are low
LOW = {"ocr": 0.85, "split": 0.90, "classification": 0.80}
ERRORS = ["missing_question", "missing_answer", "question_answer_overlap"]


#: fixed value: an edge of a run of ASCII letters, digits and underscores; Java's own takes in other letters, or not, by its version
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _log_bases(x: Column) -> Column:
    found = [F.regexp_extract_all(x, F.lit(p), 1) for p in (r"(?i)log\s*_\s*([A-Za-z0-9]+)", rf"(?i){EDGE}log([A-Za-z0-9])(?=[A-Za-z(])", rf"(?i){EDGE}log([0-9]+){EDGE}")]
    return F.array_distinct(F.transform(F.concat(*found), lambda b: F.lower(b)))


def _long_chain(line: Column) -> Column:
    """A line of equations full of logarithms and without a division: a fraction may have been read as one line."""
    marks = [r"(?i)(?<![\w.])log\s*\(", r"(?i)(?<![\w.])log\s*_\s*", r"(?i)(?<=\d)log\s*\(", r"(?i)(?<![\w.])ln\s*\("]
    logs = sum((F.regexp_count(line, F.lit(p)) for p in marks), F.lit(0))
    return (F.length(F.trim(line)) >= 24) & (F.regexp_count(line, F.lit("=")) >= 2) & (logs >= 3) & ~line.contains("/") & ~F.lower(line).contains("\\frac")


#: fixed values: what makes a text one of mathematics
MATH_SIGNS = r"(?i)(log|=|\^|sqrt|sin|cos|tan|integral|fraction|/)"


def validation_flags(rows: DataFrame) -> DataFrame:
    """``rows(whole, question, answer, subject, ocr, split, classification)`` with ``flags`` in a fixed order, ``overall`` (the
    least of the three confidences) and ``needs_review``.

    What several flags look at is worked out once, in columns of its own, and only where a cheaper condition holds.
    """
    c, given = F.col, rows.columns
    text = lambda n: F.coalesce(n, F.lit(""))
    rows = rows.withColumns({"_whole": text("whole"), "_question": text("question"), "_answer": text("answer"), "_subject": F.lower("subject")})
    whole, subject, math = c("_whole"), c("_subject"), c("_math")
    named = [c(n).rlike(MATH_SIGNS) for n in ("_whole", "_question", "_answer")]
    rows = rows.withColumns({"_q": tx.one_line(F.lower("_question")), "_a": tx.one_line(F.lower("_answer")), "_math": F.coalesce(subject == "mathematics", F.lit(False)) | named[0] | named[1] | named[2]})
    logs = lambda n: F.when(math & F.lower(n).contains("log"), _log_bases(c(n)))
    rows = rows.withColumns({"_bq": logs("_question"), "_ba": logs("_answer"), "_brackets": F.when(math, F.regexp_replace(whole, r"[^()\[\]{}]+", ""))})
    q, a, bq, ba = c("_q"), c("_a"), c("_bq"), c("_ba")
    overlap = (q != "") & (a != "") & ((q == a) | ((F.length(q) >= 20) & a.contains(q)) | ((F.length(a) >= 20) & q.contains(a)))
    uneven = (tx.excess_of_pair(c("_brackets"), "(", ")") > 0) | (tx.excess_of_pair(c("_brackets"), "[", "]") > 0) | (tx.excess_of_pair(c("_brackets"), "{", "}") > 0)
    odd = lambda mark: (F.length(whole) - F.length(F.replace(whole, F.lit(mark), F.lit("")))) % 2 == 1
    chained = F.lower("_answer").rlike("log|ln") & c("_answer").contains("=") & F.exists(F.split("_answer", "\n"), _long_chain)
    flags = F.array_compact(F.array(
        F.when(q == "", "missing_question"), F.when(a == "", "missing_answer"), F.when(overlap, "question_answer_overlap"),
        *[F.when(c(n) < least, f"low_{n}_confidence") for n, least in LOW.items()],
        F.when((F.size(bq) > 0) & (F.size(ba) > 0) & ~F.arrays_overlap(bq, ba), "potential_log_base_mismatch"),
        F.when(math & whole.contains("log") & whole.rlike(rf"{EDGE}log[0-9A-Za-z]"), "potential_subscript_loss"), F.when(math & whole.rlike(rf"{EDGE}[a-zA-Z][0-9]{EDGE}"), "potential_superscript_loss"),
        F.when(math & uneven, "potential_equation_structure_loss"),
        F.when(math & ((whole.contains("0") & whole.contains("O")) | (whole.contains("1") & (whole.contains("I") | whole.contains("l")))), "potential_symbol_ambiguity"),
        F.when(math & chained, "potential_fraction_or_chain_ambiguity"),
        F.when((subject == "chemistry") & whole.rlike(rf"{EDGE}[A-Z][a-z]?[0O][A-Za-z0-9()]*{EDGE}"), "potential_chemistry_formula_ambiguity"),
        F.when((subject == "physics") & whole.rlike(rf"{EDGE}\d+\s*(hz|pa|j|v|w|n|c){EDGE}"), "potential_physics_unit_ambiguity"),
        F.when((subject == "biology") & whole.rlike(rf"{EDGE}(dna|rna|atp){EDGE}"), "potential_biology_term_casing"),
        F.when((subject == "english") & (odd('"') | odd("'")), "potential_english_punctuation_loss"),
    ))
    low = (c("ocr") < LOW["ocr"]) | (c("split") < LOW["split"]) | (c("classification") < LOW["classification"])
    out = rows.withColumn("flags", flags).withColumn("overall", F.least("ocr", "split", "classification"))
    return out.withColumn("needs_review", low | F.exists("flags", lambda f: f.isin(ERRORS) | f.startswith("potential_"))).select(*given, "flags", "overall", "needs_review")


def assemble_lines(lines: DataFrame, by: str, order: str, opens: Column) -> DataFrame:
    """A line that opens an item starts it; those that follow are appended."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = lines.withColumn("item", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("item > 0")
    return numbered.groupBy(by, "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), " ").alias("text"))


def fold_fragments(fragments: DataFrame) -> DataFrame:
    """Handwritten pieces of one answer in page order; confidence is the least certain piece's."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.trim(x["text"])), "\n")
    out = fragments.groupBy("question", "part").agg(text.alias("text"), F.min("confidence").alias("confidence"), F.bool_and("legible").alias("legible"))
    flag = F.when(~F.col("text").rlike(r"\S"), "blank").when(~F.col("legible") | (F.col("confidence") < 0.3), "unreadable").when(F.col("confidence") < 0.55, "low_confidence").otherwise("ok")
    return out.withColumn("flag", flag)


def fragment_question(fragments: DataFrame, questions: DataFrame, by: str | None = None) -> DataFrame:
    """A fragment's number against question numbers: equal, or the number followed by letters only (3a, not 10)."""
    f, q = F.lower(F.trim("fragment_number")), F.lower(F.trim("question_number"))
    rest = F.substr(f, F.length(q) + 1)
    keyed = fragments.withColumn("_n", F.regexp_extract(f, r"^(\d+)", 1))
    # a fragment of number 10 may start with question 1's number too, but never with its whole number
    joined = keyed.join(questions.withColumn("_n", F.regexp_extract(q, r"^(\d+)", 1)), ["_n", *([by] if by else [])])
    return joined.where(f.startswith(q) & ((rest == "") | rest.rlike("^[a-z]+$"))).drop("_n")


def canonical_topic(raw: DataFrame, topics: list[str]) -> DataFrame:
    """``raw(id, topic)`` to the listed topics: an equal one first, else the first that contains the name or is within it."""
    x = tx.normalize(F.col("topic"))
    names = [tx.normalize(F.lit(t)) for t in topics]
    equal = [F.when(x == n, t) for n, t in zip(names, topics, strict=True)]
    near = [F.when(x.contains(n) | n.contains(x), t) for n, t in zip(names, topics, strict=True)]
    return raw.select("id", F.coalesce(*equal, *near).alias("name")).where(F.col("name").isNotNull())


#: fixed values: what makes a difference between readings one of mathematics
MATH_MARKS = r"log|[\^_/=+-]"


def disagreements(left: DataFrame, right: DataFrame, at: float = 0.995) -> DataFrame:
    """Lines of two readings (page, line, text) that differ: alike by less than ``at``, or different in mathematics."""
    l, r = left.withColumnRenamed("text", "left_text"), right.withColumnRenamed("text", "right_text")  # noqa: E741
    a, b = tx.one_line(F.lower("left_text")), tx.one_line(F.lower("right_text"))
    both = l.join(r, ["page", "line"]).where((a != "") & (b != "") & (a != b))
    math = F.col("left_text").rlike(MATH_MARKS) | F.col("right_text").rlike(MATH_MARKS)
    # no ratio is above twice the shorter text as a share of both; what is settled needs no blocks to be kept
    settled = math | (2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) < at)
    rows = both.withColumn("math", math).withColumn("_kept", settled)
    doubt = lambda x: F.when(~F.col("_kept"), x).otherwise("")
    rows = rows.where(F.col("_kept") | (sequences.plain_ratio(doubt(a), doubt(b)) < at))
    return rows.withColumn("similarity", sequences.plain_ratio(a, b)).select(*both.columns, "similarity", "math")


def rebuilt(lines: DataFrame, page: str, line: str) -> DataFrame:
    """Pages' texts from their lines, in order."""
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "text"))), lambda x: x["text"]), "\n").alias("text"))


#: fixed value: what stands between two pages of a rebuilt text
PAGE_BREAK = "\n\n[[PAGE_BREAK]]\n\n"


def rebuilt_document(lines: DataFrame, doc: str, page: str, line: str) -> DataFrame:
    """Documents' texts from the lines of their pages, with a break between two pages; empty lines and pages are left out."""
    inner = lambda c, name: F.transform(F.array_sort(F.collect_list(F.struct(c, name))), lambda x: x[name])
    pages = lines.where(F.col("text") != "").groupBy(doc, page).agg(F.array_join(inner(line, "text"), "\n").alias("text"))
    return pages.groupBy(doc).agg(F.trim(F.array_join(inner(page, "text"), PAGE_BREAK)).alias("text"), F.count("*").alias("pages"))


def anchored_lines(lines: DataFrame, by: str, at: str, text: str) -> DataFrame:
    """Lines with the question and part that they open, and the marks they name.

    1(a) rest, 1. rest or A1 rest open a question, (b) rest a part of the last one; an anchor needs a rest. Other lines
    belong to the last question (``number``), and ``anchored`` is false.
    """
    x = F.trim(text)
    sub, only = r"^\s*(\d{1,3})\s*\(([A-Za-zivxIVX]{1,6})\)\s*(.*)$", r"^\s*(\d{1,3})\s*[).:-]?\s*(.*)$"
    section, part = r"^\s*[A-Da-d]\s*(\d{1,3})\s*[).:-]?\s*(.*)$", r"^\s*\(([A-Za-zivxIVX]{1,6})\)\s*(.*)$"
    fits = lambda pattern, rest: x.rlike(pattern) & (F.trim(F.regexp_extract(x, pattern, rest)) != "")
    number = F.when(fits(sub, 3), F.regexp_extract(x, sub, 1)).when(fits(only, 2), F.regexp_extract(x, only, 1)).when(fits(section, 2), F.regexp_extract(x, section, 1))
    label = F.when(fits(sub, 3), F.regexp_extract(x, sub, 2)).when(number.isNull() & fits(part, 2), F.regexp_extract(x, part, 1))
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"_own": number.try_cast("int").cast("string"), "_sub": F.when(label.isNotNull(), F.concat(F.lit("("), F.lower(label), F.lit(")")))})
    rows = rows.withColumn("number", F.last("_own", ignorenulls=True).over(w))
    opens = F.col("_own").isNotNull() | (F.col("_sub").isNotNull() & F.col("number").isNotNull())
    rows = rows.withColumn("anchored", opens).withColumn("sub", F.when(opens, F.col("_sub"))).withColumn("marks", tx.marks_in(F.col(text)))
    return rows.drop("_own", "_sub")


def paper_items(lines: DataFrame, by: str, at: str, page: str, text: str) -> DataFrame:
    """A paper's items: a line that opens a question starts one, those that follow are appended, noise is left out.

    An item has its first page and the largest of the marks that its lines name; marks go from its text.
    """
    kept = lines.where(~F.col(text).rlike(pg.LINE_NOISE))
    own = F.regexp_extract(text, r"^\s*\d{1,3}\s*[).:-]?\s*(\S.*)$", 1)
    w = Window.partitionBy(by).orderBy(at)
    numbered = kept.withColumn("item", F.sum(F.when(own != "", 1).otherwise(0)).over(w)).where("item > 0")
    bare = F.trim(F.regexp_replace(F.when(own != "", own).otherwise(F.col(text)), r"\[\d{1,3}\]", ""))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), bare.alias("t")))), lambda x: x["t"]), " ")
    return numbered.groupBy(by, "item").agg(texts.alias("text"), F.min(page).alias("page"), F.max(tx.marks_in(F.col(text))).alias("marks"))


def structured_items(lines: DataFrame, paper: str, page: str, order: str, text: str) -> DataFrame:
    """The items of papers from their lines in order: (paper, item, number, sub, text, page, marks).

    Pages that hold no questions are left out. A line that opens a question (its number 1 to 200, with a rest, no noise)
    or a part of the last one starts an item; what else looks like an opening is text, noise is none. An item has its
    first page and the largest of the marks that its lines name.
    """
    held = lines.withColumn("_out", pg.page_left_out(F.col(text), Window.partitionBy(paper, page))).where("NOT _out").drop("_out")
    flat = held.withColumn("_x", tx.one_line(F.col(text))).where("_x <> ''")
    x = F.col("_x")
    both, number, part = r"^(\d{1,3})\s*\(([A-Za-zivxIVX]{1,6})\)\s*(\S.*)$", r"^[A-Da-d]?\s*(\d{1,3})\s*[).:-]?\s*(\S.*)$", r"^\(([A-Za-zivxIVX]{1,6})\)\s*(\S.*)$"
    kind = F.when(x.rlike(both), 1).when(x.rlike(number), 2).when(x.rlike(part), 3)
    got = lambda k, pattern, i: F.when(F.col("_kind") == k, F.regexp_extract(x, pattern, i))
    found = flat.withColumn("_kind", kind).withColumns({
        "_number": F.coalesce(got(1, both, 1), got(2, number, 1)).cast("int"), "_sub": F.lower(F.coalesce(got(1, both, 2), got(3, part, 1))), "_rest": F.coalesce(got(1, both, 3), got(2, number, 2), got(3, part, 2)), "_noise": x.rlike(pg.LINE_NOISE),
    })
    good = F.col("_number").between(1, 200) & ~F.col("_noise")
    w = Window.partitionBy(paper).orderBy(order)
    passed = found.withColumn("number", F.last(F.when(good, F.col("_number")), ignorenulls=True).over(w))
    opens = F.coalesce(good | ((F.col("_kind") == 3) & F.col("number").isNotNull() & ~F.col("_noise")), F.lit(False))
    passed = passed.withColumn("_opens", opens).where(~F.col("_noise") | F.col("_kind").isNotNull())
    passed = passed.withColumn("item", F.sum(F.col("_opens").cast("int")).over(w)).where("item > 0")
    said = F.when(F.col("_opens"), F.col("_rest")).otherwise(x)
    bare = F.trim(F.regexp_replace(said, r"\[\d{1,3}\]", ""))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), bare.alias("t")))), lambda y: y["t"]), " ")
    first = F.min_by(F.when(F.col("_sub").isNotNull(), F.concat(F.lit("("), F.col("_sub"), F.lit(")"))), F.col(order))
    return passed.groupBy(paper, "item").agg(F.min_by("number", order).alias("number"), first.alias("sub"), tx.one_line(texts).alias("text"), F.min(page).alias("page"), F.max(tx.marks_in(said)).alias("marks")).where("text <> ''")


def dedup_records(rows: DataFrame) -> DataFrame:
    """``rows(id, type, text, options)``: groups of equal type, normalised text and options, their size and the one to keep."""
    options = F.array_join(F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o: tx.normalize(o)), "|")
    keyed = rows.withColumn("group_key", F.sha1(F.concat_ws("||", F.lower("type"), tx.normalize(F.col("text")), options)))
    best = F.max_by("id", F.struct(F.length("text"), -F.col("id")))
    return keyed.groupBy("group_key").agg(F.count("*").alias("n"), best.alias("kept_id"), F.min("id").alias("first_id"))
