"""Access, assignments, review actions, reading candidates and index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions import sequences
from markwright.functions import text as tx
from markwright.functions.exprs import clamp, ratio
from markwright.operators import matching
from markwright.sources.written import written


def access_roles(classes: DataFrame, co_teachers: DataFrame, grants: DataFrame) -> DataFrame:
    """``classes(class_id, owner)``, ``co_teachers(class_id, teacher, can_grade)``, ``grants(class_id, teacher)`` -> the
    strongest role of each (class, teacher): owner, then co-teacher, then grant."""
    rows = classes.select("class_id", F.col("owner").alias("teacher"), F.lit(0).alias("rank"), F.lit(True).alias("can_grade"))
    rows = rows.unionByName(co_teachers.select("class_id", "teacher", F.lit(1).alias("rank"), F.coalesce("can_grade", F.lit(False)).alias("can_grade")))
    rows = rows.unionByName(grants.select("class_id", "teacher", F.lit(2).alias("rank"), F.lit(False).alias("can_grade")))
    best = rows.groupBy("class_id", "teacher").agg(F.min_by(F.struct("rank", "can_grade"), F.struct("rank", ~F.col("can_grade"))).alias("b"))
    role = F.when(F.col("b.rank") == 0, "owner").when(F.col("b.rank") == 1, "co_teacher").otherwise("granted")
    return best.select("class_id", "teacher", role.alias("role"), F.col("b.can_grade").alias("can_grade"))


def _parts(names: DataFrame, name: str, lengths: list[int], part: str) -> DataFrame:
    """(name, part): the substrings of each name that have one of these lengths."""
    none = F.array().cast("array<string>")
    cut = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(F.col(name), i, F.lit(n)))).otherwise(none)
    every = F.array_distinct(F.concat(none, *[cut(n) for n in lengths]))
    return names.select(name, F.explode(every).alias(part))


def granted(areas: DataFrame, grants: DataFrame, name: str) -> DataFrame:
    """``areas`` that some grant covers, with how many do and what they allow together.

    An empty scope covers all; else some entry contains the area's name or is contained in it, whatever their case. The
    shorter of the two is a substring of the longer: names meet by equality, in the substrings of each side that are as
    long as a name of the other (``_parts``). Grants are grouped by what they cover first.
    """
    none = F.array().cast("array<string>")
    scope = F.array_sort(F.transform(F.coalesce("scope", none), lambda x: F.lower(x)))
    kinds = written(grants.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"), F.bool_or("can_view").alias("v"), F.bool_or("can_edit").alias("e")), "grants")
    covers_all = (F.size("scope") == 0) | F.exists("scope", lambda x: F.coalesce(x == "", F.lit(False)))
    named = F.exists("scope", lambda x: x.isNotNull())
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or("v"), F.lit(False)).alias("v"), F.coalesce(F.bool_or("e"), F.lit(False)).alias("e")]
    whole, blank = (kinds.where(c).agg(*sums).first() for c in (covers_all, covers_all | named))  # for any area; for one without a name
    entries = kinds.where(~covers_all).select(F.explode("scope").alias("entry"), "scope").where("entry IS NOT NULL")
    places = areas.select(F.lower(name).alias("area")).where("area <> ''").distinct()
    lengths = lambda rows, c: sorted(r[0] for r in rows.select(F.length(c)).distinct().collect())  # noqa: E731  (as many as there are lengths)
    of_area = _parts(places, "area", lengths(entries, "entry"), "entry")
    of_entry = _parts(entries.select("entry").distinct(), "entry", lengths(places, "area"), "area")
    pairs = of_area.unionByName(of_entry.join(places, "area", "left_semi")).join(entries, "entry").select("area", "scope").distinct()
    found = pairs.join(kinds, "scope").groupBy(F.col("area").alias("_area")).agg(F.sum("n").alias("_n"), F.bool_or("v").alias("_v"), F.bool_or("e").alias("_e"))
    rows = areas.join(found, F.lower(name) == F.col("_area"), "left")
    plus = lambda c, k: F.when(F.col(name) == "", F.lit(blank[k])).otherwise(c)
    n = plus(F.coalesce("_n", F.lit(0)) + F.lit(whole["n"]), "n")
    allow = lambda c, k: plus(F.coalesce(c, F.lit(False)) | F.lit(whole[k]), k)
    return rows.select(*areas.columns, n.cast("long").alias("n_grants"), allow("_v", "v").alias("can_view"), allow("_e", "e").alias("can_edit")).where("n_grants > 0")


def targeted_students(assignments: DataFrame, enrollments: DataFrame, recipients: DataFrame) -> DataFrame:
    """Whole-class work goes to active students who had joined before it, or have started it; other work to its recipients."""
    whole = assignments.where("target_all").join(enrollments.where("status = 'active'"), "class_id").where((F.col("joined_at") <= F.col("created_at")) | F.coalesce("started", F.lit(False)))
    some = assignments.where("NOT target_all").join(recipients, "assignment_id")
    return whole.select("assignment_id", "student").unionByName(some.select("assignment_id", "student")).distinct()


def visible_result(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Columns whose flag is false are null; a missing flag shows them."""
    return rows.withColumns({c: F.when(F.coalesce(F.col(f), F.lit(True)), F.col(c)) for c, f in flags.items()})


def active_assignments(assignments: DataFrame, submissions: DataFrame, active: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` assignments of latest deadline (without one last) per class, with their counts.

    ``total``: of whole-class work the class's active students (``active(class_id, n_active)``), else its submissions.
    """
    counts = submissions.groupBy("assignment_id").agg(F.count_if(F.col("status").isin("submitted", "late")).alias("submitted"), F.count_if(F.col("status") == "late").alias("late"), F.count("*").alias("n"))
    order = Window.partitionBy("class_id").orderBy(F.desc_nulls_last("deadline_at"), "assignment_id")
    top = assignments.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = top.join(counts, "assignment_id", "left").join(active, "class_id", "left")
    zero = F.lit(0).cast("long")
    total = F.when(F.col("target_all"), F.col("n_active")).otherwise(F.col("n"))
    return rows.select("class_id", "assignment_id", "place", F.coalesce("submitted", zero).alias("submitted"), F.coalesce("late", zero).alias("late"), F.coalesce(total, zero).alias("total"))


def fully_reviewed(marks: DataFrame, reviewed: list[str]) -> DataFrame:
    """Submissions with marks, all of them reviewed."""
    return marks.groupBy("submission_id").agg(F.bool_and(F.col("status").isin(reviewed)).alias("ok")).where("ok").select("submission_id")


def override(proposed: Column, awarded: Column) -> Column:
    """Awarded marks by criterion, kept between 0 and what is available, with what was proposed before.

    ``proposed``: array of (marks_available, marks_awarded); ``awarded``: array of doubles.
    """
    return F.zip_with(proposed, awarded, lambda p, a: F.struct(p["marks_awarded"].alias("before"), F.greatest(F.lit(0.0), F.least(p["marks_available"], a)).alias("after")))


def changes(overridden: Column) -> Column:
    """(index, before, after) of the criteria whose marks changed."""
    numbered = F.transform(overridden, lambda c, i: F.struct(i.alias("index"), c["before"].alias("before"), c["after"].alias("after")))
    return F.filter(numbered, lambda c: ~c["before"].eqNullSafe(c["after"]))


def comment_upsert(comments: Column, index: Column, text: Column) -> Column:
    """The comment of an index is replaced, or added at the end."""
    fresh = F.struct(index.alias("index"), text.alias("text"))
    swapped = F.transform(comments, lambda c: F.when(c["index"] == index, fresh).otherwise(c))
    return F.when(F.exists(comments, lambda c: c["index"] == index), swapped).otherwise(F.array_append(comments, fresh))


def newest(rows: DataFrame, by: str, at: str, id_: str, most: int, by_time: bool = False) -> DataFrame:
    """Each id once (its newest row), and of each owner the newest ``most``; of equal times the larger id (or all by time alone)."""
    once = rows.withColumn("_u", F.row_number().over(Window.partitionBy(by, id_).orderBy(F.desc(at)))).where("_u = 1").drop("_u")
    order = Window.partitionBy(by).orderBy(F.desc(at), *([] if by_time else [F.desc(id_)]))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def paper_pick(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted(id, stem, kind)`` among ``files(stem_key, name)``, joined on the lower-case stem without its variant: the exact
    name first, then the kind with the stem, then the kind, then any; ties by name."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"_variant_\d+$", "")
    joined = wanted.withColumn("stem_key", plain(F.col("stem"))).join(files, "stem_key")
    name, stem = F.lower(F.regexp_replace("name", r"(?i)\.pdf$", "")), F.lower("stem")
    kind = F.lower("name").rlike(r"_qp\b") & (F.col("kind") == "qp") | F.lower("name").rlike(r"_ms\b") & (F.col("kind") == "ms")
    rank = F.when(name == F.concat_ws("_", stem, "kind"), 0).when(kind & name.contains(stem), 1).when(kind, 2).otherwise(3)
    order = Window.partitionBy("id").orderBy("rank", "name")
    return joined.withColumn("rank", rank).withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "name", "rank")


def first_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The first row of a key stands; later ones are duplicates of it or conflicts with it."""
    w = Window.partitionBy(key).orderBy(order)
    kind = F.when(F.row_number().over(w) == 1, "kept").when(F.col(value).eqNullSafe(F.first(value).over(w)), "duplicate").otherwise("conflict")
    return rows.withColumn("kind", kind)


def side_score(numbers: DataFrame, by: str, number: str, expected: Column) -> DataFrame:
    """10 for each number of 1..expected, less 10 for each missing, 8 for each unreadable or out of range, 6 for each
    repeat. ``number`` is text."""
    n = F.col(number).try_cast("int")
    inside = n.between(1, F.col("expected"))
    sums = numbers.withColumn("expected", expected).groupBy(by).agg(
        F.count_distinct(F.when(inside, n)).alias("u"), F.count_if(inside).alias("i"), F.count_if(n.isNull()).alias("bad"), F.count_if(~inside).alias("out"), F.max("expected").alias("e")
    )
    missing = F.greatest(F.lit(0), F.col("e") - F.col("u"))
    score = F.col("u") * 10 - missing * 10 - (F.col("bad") + F.col("out")) * 8 - (F.col("i") - F.col("u")) * 6
    return sums.select(by, F.col("u").alias("found"), missing.cast("long").alias("missing"), score.cast("long").alias("score"))


def item_quality(text: Column) -> Column:
    """Length up to 1200, less for empty texts, bare numbers and printed furniture."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.lower(clean)
    less = lambda hit, n: F.when(hit, n).otherwise(0)
    return (
        F.least(F.length(clean), F.lit(1200)) - less(clean == "", 1000) - less(clean.rlike(r"^\d{1,3}$"), 300)
        - less(low.contains("page ") & low.contains(" of "), 300) - less(low.contains("question answer marks") | low.contains("general points"), 250)
    )


def best_of_group(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Of each key the row of best quality (its ``order`` and quality), the earliest of equal ones; texts stay where they are."""
    rated = rows.select(key, order, item_quality(F.col(text)).alias("quality"))
    best = rated.groupBy(key).agg(F.min_by(F.struct(order, "quality"), F.struct(-F.col("quality"), F.col(order))).alias("_b"))
    return best.select(key, "_b.*")


#: fixed values: what shows that symbols and mathematics of a page were read
SYMBOL = r"[=+\-/*^_()\[\]{}|]"
MATH_TOKEN = r"(log|sqrt|sin|cos|tan|[A-Za-z]\^\d+|[A-Za-z]_\d+|\d+[A-Za-z]|[A-Za-z]+\d+)"


def balanced(x: Column) -> Column:
    even = lambda a, b: tx.excess_of_pair(x, a, b) == 0
    return even("(", ")") & even("[", "]") & even("{", "}")


def symbol_score(x: Column) -> Column:
    share = F.regexp_count(x, F.lit(SYMBOL)) / F.greatest(F.length(x), F.lit(1))
    return F.when(F.trim(x) == "", 0.0).otherwise(F.least(F.lit(1.0), share * 20 + F.when(balanced(x), 0.1).otherwise(0.0) + 0.35))


def math_score(x: Column) -> Column:
    distinct = F.size(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(MATH_TOKEN), 1), lambda t: F.lower(t))))
    return F.when(F.trim(x) == "", 0.0).when(distinct == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.4 + distinct / 10.0))


def anchor_score(x: Column) -> Column:
    """How well a page's question and answer are marked off."""
    q, a = x.rlike(r"(?i)(^|\n)\s*(q[.)]|question[:.]?)"), x.rlike(r"(?i)(^|\n)\s*(a[.)]|answer[:.]?)")
    return F.when(q & a, 1.0).when(q | a, 0.75).when(x.rlike(r"(?i)solve|find|prove|show that|explain|state"), 0.55).otherwise(0.3)


def candidate_score(confidence: Column, symbols: Column, math: Column, anchors: Column, agreement: Column, uncertain: Column, fragments: Column) -> Column:
    """A reading's score from its certainty, what it preserves, and how it agrees with others."""
    return clamp(0.38 * confidence + 0.20 * symbols + 0.18 * math + 0.12 * anchors + 0.12 * agreement - 0.12 * uncertain - 0.08 * fragments)


def prose_run(lines: Column) -> Column:
    """Words of the longest run of prose lines (four words or more); one short line within a run is forgiven."""
    count = lambda s: F.size(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""))
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("cur"), F.lit(False).alias("gap"))

    def step(a, s):
        n = count(s)
        grown = F.struct(F.greatest(a["best"], a["cur"] + n).alias("best"), (a["cur"] + n).alias("cur"), F.lit(False).alias("gap"))
        bridged = F.struct(F.greatest(a["best"], a["cur"] + n).alias("best"), (a["cur"] + n).alias("cur"), F.lit(True).alias("gap"))
        ended = F.struct(a["best"].alias("best"), F.lit(0).alias("cur"), F.lit(False).alias("gap"))
        return F.when(n >= 4, grown).when((a["cur"] > 0) & ~a["gap"] & n.between(1, 2), bridged).otherwise(ended)

    return F.aggregate(lines, start, step)["best"]


def scored_readings(rows: DataFrame, by: str) -> DataFrame:
    """``rows(by, at, text, confidence)``, the readings of a page, with the ``score`` of each among them, four places, and
    its ``rank``: by score, then confidence, then place. A page has a handful of readings."""
    pages = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "text", "confidence"))).alias("_r"))
    pages = pages.withColumn("_a", sequences.agreements(F.transform("_r", lambda r: r["text"])))
    each = pages.select(by, F.posexplode(F.arrays_zip("_r", "_a")).alias("_i", "_x")).select(by, "_x._r.*", F.col("_x._a").alias("_agree"))
    x, none = F.col("text"), F.lit(0.0)
    score = F.round(candidate_score(F.col("confidence"), symbol_score(x), math_score(x), anchor_score(x), F.col("_agree"), none, none), 4)
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("confidence"), "at")
    return each.withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("_agree")


def _scores(readings: Column, agree: Column) -> Column:
    """(score, confidence, -at) of each of a page's readings (at, text, confidence): the largest is the best."""
    none = F.lit(0.0)

    def one(r: Column, a: Column) -> Column:
        x = r["text"]
        score = F.round(candidate_score(r["confidence"], symbol_score(x), math_score(x), anchor_score(x), a, none, none), 4)
        return F.struct(score.alias("score"), r["confidence"].alias("confidence"), (-r["at"]).alias("before"))

    return F.zip_with(readings, agree, one)


def repaired_readings(rows: DataFrame, repairs: DataFrame, by: str) -> DataFrame:
    """``repairs(by, text)`` of each page's best reading, scored again among its peers: (by, before, after, accepted, text).

    A repair counts if the repaired reading is still the best and its score hasn't fallen; else the reading stays as it is.
    A page's readings are one row throughout, so that they meet, and are compared, once before the repair and once after.
    """
    texts = lambda c: F.transform(c, lambda r: r["text"])
    pages = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "text", "confidence"))).alias("_r"))
    pages = pages.join(repairs.select(by, F.col("text").alias("_new")), by)
    pages = pages.withColumn("_agree", sequences.agreements(texts("_r")))
    # unfolded, so that what is used several times isn't worked out as often
    pages = pages.select("*", F.explode(F.array(F.array_max(_scores(F.col("_r"), F.col("_agree"))))).alias("_best")).withColumn("_at", -F.col("_best.before"))
    old = F.get(F.filter("_r", lambda r: r["at"] == F.col("_at")), F.lit(0))["text"]
    # of equal readings the repaired one comes first
    again = F.transform("_r", lambda r: F.struct(F.when(r["at"] == F.col("_at"), -1).otherwise(r["at"]).alias("at"), F.when(r["at"] == F.col("_at"), F.col("_new")).otherwise(r["text"]).alias("text"), r["confidence"].alias("confidence")))
    pages = pages.select(by, F.col("_best.score").alias("before"), old.alias("_old"), "_new", again.alias("_r"))
    pages = pages.withColumn("_agree", sequences.agreements(texts("_r"))).withColumn("_scores", _scores(F.col("_r"), F.col("_agree")))
    after = F.get(F.filter("_scores", lambda s: s["before"] == 1), F.lit(0))["score"]
    pages = pages.select(by, "before", after.alias("after"), "_old", "_new", (F.array_max("_scores")["before"] == 1).alias("_first"))
    counts = F.col("_first") & (F.col("after") >= F.col("before"))
    return pages.select(by, "before", "after", counts.alias("accepted"), F.when(counts, F.col("_new")).otherwise(F.col("_old")).alias("text"))


def feedback_text(label: Column, percent_: Column, missing: Column, option: Column | None = None) -> Column:
    """A sentence for a result; at most two missing points are named."""
    named = F.array_join(F.slice(missing, 1, 2), "; ")
    share = F.format_string("%.1f", percent_)
    points = (
        F.when(label == "fully_correct", F.concat(F.lit("Full marks ("), share, F.lit("%): the key points are there.")))
        .when(label == "partially_correct", F.concat(F.lit("Partly right ("), share, F.lit("%)."), F.when(F.size(missing) > 0, F.concat(F.lit(" Add: "), named)).otherwise(F.lit(""))))
        .otherwise(F.concat(F.lit("Few points met ("), share, F.lit("%)."), F.when(F.size(missing) > 0, F.concat(F.lit(" Main gaps: "), named)).otherwise(F.lit(""))))
    )
    if option is None:
        return points
    chosen = F.when(label == "fully_correct", F.lit("The chosen option is right.")).otherwise(F.concat(F.lit("The right option is "), option, F.lit(".")))
    return F.when(option.isNotNull(), chosen).otherwise(points)


def chained(asked: DataFrame, matched: DataFrame, schemes: DataFrame) -> DataFrame:
    """``asked(id, answer)`` with the item that each question was matched to, the answer's marks by its scheme, and feedback.

    A question that no source has near enough has no item and no marks; its feedback says so.
    """
    found = asked.select("id", "answer").join(matched.select("id", F.when(F.col("status") != "failed", F.col("item_id")).alias("item_id"), "fallback_used", "status"), "id")
    marked = matching.evaluate(found.join(schemes, "item_id").select("id", "answer", "scheme"))
    text = feedback_text(F.col("label"), F.col("percent"), F.col("missing"), F.col("right_option"))
    rows = found.join(marked.select("id", "n_points", "score", "label", text.alias("feedback")), "id", "left")
    told = F.coalesce("feedback", F.lit("No question of either source is near enough."))
    return rows.select("id", "item_id", "fallback_used", "status", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit("not_marked")).alias("label"), F.md5(told).alias("feedback_md5"))


#: fixed values: what an index's manifest is compared on, in this order
INDEX_FIELDS = ["source_signature", "record_count", "record_signature", "source_priority", "embed_model_requested", "embed_model_resolved", "embedding_backend", "matcher_revision", "index_version"]


def rebuild_reason(manifest: Column, current: Column, present: Column, auto: Column) -> Column:
    """The first reason to rebuild an index. ``present``: struct of booleans manifest, records, embeddings."""
    out = F.when(~present["manifest"], "missing_manifest").when(~present["records"], "missing_records").when(~present["embeddings"], "missing_embeddings").when(~auto, "auto_rebuild_disabled")
    for f in INDEX_FIELDS:
        out = out.when(~manifest[f].eqNullSafe(current[f]), f"{f}_changed")
    return out.otherwise("up_to_date")


TREE_BITS = 12  # children of a node of the tree: 4096 at most


def signature(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """A hash of all rows of a group by a whole-numbered ``order``, and how many they are.

    A Merkle tree: rows whose order agrees but for its last ``TREE_BITS`` bits are a node, whose hash is that of its
    children's places and hashes; nodes meet in the same way until a group is one. A node with one child has its hash, so
    that the signature doesn't depend on the height. No row ever holds more than a node's children, however large a group.
    """
    node = rows.select(by, F.col(order).cast("long").alias("_at"), F.sha2(F.concat_ws("\u0001", *columns), 256).alias("_h"), F.lit(1).cast("long").alias("_n"))
    children = F.array_sort(F.collect_list(F.struct("_at", "_h")))
    joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["_at"], c["_h"])), ",")
    total = F.sum("_n").alias("_n")
    for _ in range(-(-64 // TREE_BITS)):
        up = node.groupBy(by, F.shiftright("_at", TREE_BITS).alias("_up")).agg(F.when(F.count("*") > 1, F.sha2(joined, 256)).otherwise(F.min("_h")).alias("_h"), total)
        node = written(up.select(by, F.col("_up").alias("_at"), "_h", "_n"), "signature")
        if not node.where("_at NOT IN (0, -1)").limit(1).count():
            break
    top = node.groupBy(by).agg(F.when(F.count("*") > 1, F.sha2(joined, 256)).otherwise(F.min("_h")).alias("signature"), F.sum("_n").alias("records"))
    return top


def companions(files: DataFrame, most: int = 2) -> DataFrame:
    """``files(name, folder)``: for each file the best companions of its folder.

    Inserts and sources score 10, question papers lose 4 and mark schemes 10; each word of two letters or more that the
    names share adds 1, as often as the file has it. Ten points are needed. Files that are no inserts are never paired.
    """
    low = F.lower("name")
    words = F.regexp_extract_all(low, F.lit(r"([a-z]+|\d+)"), 1)
    rows = files.select("folder", low.alias("name"), words.alias("t"))
    points = lambda c: F.when(c.rlike("insert|source|passage|reading|text|resource"), 10).otherwise(0) + F.when(c.rlike("qp|question"), -4).otherwise(0) + F.when(c.rlike("ms|mark|scheme|er|examiner"), -10).otherwise(0)
    other = rows.where(F.col("name").endswith(".pdf")).select("folder", F.col("name").alias("companion"), F.col("t").alias("tc"), points(F.col("name")).alias("base"))
    own = rows.select("folder", F.col("name").alias("file"), F.filter("t", lambda w: F.length(w) >= 2).alias("tf"))
    scored = own.join(other.where("base >= 0"), "folder").where("file <> companion").withColumn("score", F.col("base") + F.size(F.filter("tf", lambda w: F.array_contains("tc", w)))).where("score >= 10")
    order = Window.partitionBy("folder", "file").orderBy(F.desc("score"), "companion")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("folder", "file", "companion", "score", "place")


def reconcile(criteria: DataFrame, by: str, awarded: str, cap: Column, stated: Column | None = None, tolerance: float = 0.1) -> DataFrame:
    """Criteria scaled in proportion so that their sum keeps to the cap, one decimal; with a stated total, also ``total``: the
    stated one if the criteria bear it out within the tolerance, else their sum, neither above the cap."""
    total = F.sum(awarded).over(Window.partitionBy(by))
    out = criteria.withColumn("scaled", F.round(F.when(total > cap, F.col(awarded) * ratio(cap, total, 0.0)).otherwise(F.col(awarded)), 1))
    if stated is None:
        return out
    return out.withColumn("total", F.round(F.least(cap, F.when(F.abs(stated - total) <= tolerance, stated).otherwise(total)), 1))


def flag_counts(rows: DataFrame, by: str) -> DataFrame:
    """Extraction flags and the marks withheld for those that can't be judged."""
    lost = F.col("flag").isin("unreadable", "not_found")
    return rows.groupBy(by).agg(*[F.count_if(F.col("flag") == f).alias(f) for f in ("ok", "low_confidence", "unreadable", "blank", "not_found")], F.sum(F.when(lost, F.col("marks")).otherwise(0)).alias("withheld"))


def reclaim_leaks(rows: DataFrame, paper: str, order: str) -> DataFrame:
    """A later question without a scheme takes the tail of the nearest earlier scheme that names its number at a line start."""
    late = rows.where(F.trim(F.coalesce("scheme", F.lit(""))) == "").select(paper, F.col(order).alias("need_at"), F.col("number").alias("need"))
    early = rows.where(F.trim(F.coalesce("scheme", F.lit(""))) != "").select(paper, F.col(order).alias("from_at"), "scheme")
    marker = F.concat(F.lit("\n"), F.col("need").cast("string"), F.lit(" "))
    found = late.join(early, paper).where((F.col("from_at") < F.col("need_at")) & F.col("scheme").contains(marker))
    first = Window.partitionBy(paper, "need_at").orderBy("from_at")
    picked = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("tail", F.substr("scheme", F.position(marker, F.col("scheme")) + 1))
    return picked.select(paper, "need_at", "need", "from_at", F.trim(F.regexp_replace("tail", r"^\d+ ", "")).alias("tail"))


def with_names(rows: DataFrame, people: DataFrame, parts: dict[str, str | None]) -> DataFrame:
    """``rows`` with people's names in place of their keys, ``people(person, name)`` joined once for each part that they play."""
    for part, unknown in parts.items():
        known = people.select(F.col("person").alias(f"_{part}"), F.col("name").alias("_name"))
        named = F.col("_name") if unknown is None else F.coalesce("_name", F.lit(unknown))
        rows = rows.join(known, F.col(part) == F.col(f"_{part}"), "left").withColumn(part, named).drop(f"_{part}", "_name")
    return rows


def single(asked: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key how many rows it has, its one row's value, and whether it is one, absent or several."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(value).alias(value))
    n = F.coalesce("n", F.lit(0)).cast("long")
    outcome = F.when(n == 0, "absent").when(n == 1, "one").otherwise("several")
    return asked.join(got, key, "left").select(key, n.alias("n"), outcome.alias("outcome"), F.when(n == 1, F.col(value)).alias(value))
