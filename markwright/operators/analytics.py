"""Class and student analytics over submissions and marks.

Native columns: marks(submission_id, student, topic, question, earned, available, status, confidence),
submissions(submission_id, student, assignment_id, class_id, status, submitted_at, total_score, total_marks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions.exprs import GRADE, bands, half_up, percent
from markwright.operators.relational import placed

REVIEWED = ["auto_approved", "approved", "overridden"]
HANDED_IN = ["submitted", "late"]


def topic_or_general(topic: Column) -> Column:
    return F.coalesce(F.when(topic != "", topic), F.lit("General"))


def action_queue(marks: DataFrame, submissions: DataFrame, threshold: float) -> DataFrame:
    """One row of counters. Unknown confidence counts as low here, and not as below the threshold."""
    review, sure = F.col("status") == "needs_review", F.col("confidence") >= threshold
    counts = marks.agg(
        F.count_if(review & (F.col("confidence").isNull() | ~sure)).alias("low_confidence"),
        F.count_if(review & sure).alias("ready_bulk"),
        F.count_if(review & (F.col("confidence") < threshold)).alias("below_threshold"),
        F.count_if(F.col("status") == "ocr_failed").alias("ocr_failed"),
        F.count_if(F.col("status").isin(REVIEWED)).alias("reviewed"),
        F.count("*").alias("total"),
    )
    done = marks.groupBy("submission_id").agg(F.bool_and(F.col("status").isin(REVIEWED)).alias("all_done")).where("all_done")
    open_ = submissions.where(F.col("released_at").isNull()).join(done, "submission_id", "left_semi")
    return counts.crossJoin(open_.agg(F.count("*").alias("reviewed_unreleased")))  # one row each


def mastery(marks: DataFrame, *by: str) -> DataFrame:
    """Ratio of sums by topic, 0 where nothing is available."""
    sums = marks.withColumn("topic", topic_or_general(F.col("topic"))).groupBy(*by, "topic").agg(F.sum("earned").alias("e"), F.sum("available").alias("a"), F.count("*").alias("n_marks"))
    return sums.select(*by, "topic", percent(F.col("e"), F.col("a"), 0).alias("mastery"), "n_marks")


MOST_COLUMNS = 2000


def heatmap(marks: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Students by topics in their order, null where nothing is available, and a row ``average`` of the rounded cells.

    The topics are the table's own, a column each (t1, t2, ...), unless they are given; more than ``MOST_COLUMNS`` are an
    error, not cut.
    """
    if topics is None:
        topics = sorted(r[0] for r in marks.select("topic").where("topic IS NOT NULL").distinct().limit(MOST_COLUMNS + 1).collect())
    if len(topics) > MOST_COLUMNS:
        raise ValueError(f"a heatmap of more than {MOST_COLUMNS} topics")
    cells = marks.groupBy("student", "topic").agg(percent(F.sum("earned"), F.sum("available")).alias("cell"))
    names = [f"t{i + 1}" for i in range(len(topics))]
    wide = cells.groupBy("student").pivot("topic", topics).agg(F.first("cell"))
    wide = wide.select(F.col("student").cast("string").alias("student"), *[F.col(f"`{t}`").alias(n) for t, n in zip(topics, names, strict=True)])
    average = wide.agg(*[half_up(F.avg(n)).cast("long").alias(n) for n in names]).select(F.lit("average").alias("student"), *names)
    return wide.unionByName(average)


def difficulty(marks: DataFrame) -> DataFrame:
    """Percent earned by question; the hardest come first when sorted by (pct, question).

    Marks count in millionths, as whole numbers: a sum comes to the same in any order, and halves are halves.
    """
    millionths = lambda c: F.sum(F.round(F.col(c) * 1_000_000).cast("decimal(18,0)"))
    sums = marks.groupBy("question").agg(millionths("earned").alias("_e"), millionths("available").alias("_a"), F.count("*").alias("answers"))
    pct = F.expr("((_e * 200 + _a) - pmod(_e * 200 + _a, _a * 2)) div (_a * 2)")
    return sums.select("question", F.when(F.col("_a") > 0, pct).otherwise(F.lit(0)).cast("long").alias("pct"), "answers")


def class_pulse(submissions: DataFrame, marks: DataFrame, as_of: Column, days: int = 30, weakest: int = 3) -> DataFrame:
    """By class: mean of the recent ratios, the weakest topics (lowest first, ties by name), topics attempted."""
    handed = submissions.where(F.col("status").isin(HANDED_IN))
    recent = handed.where((F.col("submitted_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("total_marks") > 0))
    average = recent.groupBy("class_id").agg(half_up(F.avg(F.col("total_score") / F.col("total_marks")) * 100).cast("long").alias("avg_pct"))
    topics = mastery(marks.join(handed.select("submission_id", "class_id"), "submission_id"), "class_id")
    ranked = topics.where("topic <> 'General'").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("mastery", "topic"))).where(F.col("r") <= weakest)
    low = ranked.groupBy("class_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "topic"))), lambda x: x["topic"]), "; ").alias("weakest"))
    seen = topics.groupBy("class_id").agg(F.count("*").alias("topics"))
    return seen.join(average, "class_id", "left").join(low, "class_id", "left").select("class_id", "avg_pct", "weakest", "topics")


def needs_attention(students: DataFrame, assignments: DataFrame, submissions: DataFrame, as_of: Column, days: int = 7, missed_from: int = 2, most: int | None = None, by: str | None = None) -> DataFrame:
    """Students who missed closed assignments, or else have not handed in for ``days``.

    ``most``: only so many of each class (``by``), in the order of the students.
    """
    closed = assignments.where(F.col("deadline_at") <= as_of)
    handed = submissions.where(F.col("status").isin(HANDED_IN))
    expected = closed.agg(F.count("*").alias("expected"))
    got = handed.join(closed, "assignment_id", "left_semi").groupBy("student").agg(F.count_distinct("assignment_id").alias("got"))
    last = handed.groupBy("student").agg(F.max("submitted_at").alias("last_at"))
    rows = students.join(got, "student", "left").join(last, "student", "left").crossJoin(F.broadcast(expected))  # one row
    missed = (F.col("expected") - F.coalesce("got", F.lit(0))).cast("long")
    reason = F.when(missed >= missed_from, F.concat(F.lit("Missed "), missed.cast("string"), F.lit(" assignments"))).when(F.col("last_at").isNull() | (F.col("last_at") < as_of - F.make_dt_interval(F.lit(days))), F.lit(f"No practice in {days}+ days"))
    found = rows.select(*([by] if by else []), "student", missed.alias("missed"), reason.alias("reason")).where(F.col("reason").isNotNull())
    if most is None:
        return found
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(*([by] if by else [])).orderBy("student"))).where(F.col("_r") <= most).drop("_r")


def predicted_grade(results: DataFrame, boundaries: DataFrame, least_done: int = 4, least_topics: int = 3) -> DataFrame:
    """``results(student, topic, ratio)`` against ``boundaries(grade, min_percent)``, a small table.

    The highest boundary reached counts, else the lowest grade; what is missing to the next one is added.
    """
    rolled = results.groupBy("student").agg(F.count("*").alias("done"), F.count_distinct("topic").alias("topics"), half_up(F.avg("ratio") * 100).cast("long").alias("rolling"))
    rolled = rolled.where((F.col("done") >= least_done) & (F.col("topics") >= least_topics))
    steps = boundaries.agg(F.array_sort(F.collect_list(F.struct(F.col("min_percent").alias("at"), "grade"))).alias("steps"))  # a grade table: one short row
    rows = rolled.crossJoin(F.broadcast(steps))
    reached = F.filter("steps", lambda s: s["at"] <= F.col("rolling"))
    ahead = F.get(F.filter("steps", lambda s: s["at"] > F.col("rolling")), F.lit(0))["at"]
    grade = F.when(F.size(reached) > 0, F.element_at(reached, -1)["grade"]).otherwise(F.get("steps", F.lit(0))["grade"])
    return rows.select("student", "done", "topics", "rolling", grade.alias("grade"), (ahead - F.col("rolling")).alias("to_next"))


def review_queue(marks: DataFrame, by: str) -> DataFrame:
    """Place of each mark in its queue: unknown confidence first, then the least certain."""
    bucket = F.coalesce(F.least(F.greatest(F.floor(F.col("confidence") * 1000), F.lit(0)), F.lit(1000)), F.lit(-1)).cast("int")
    return placed(marks, by, bucket, F.col("confidence").asc_nulls_first(), F.col("mark_id"))


def review_counters(marks: DataFrame, by: str, threshold: float) -> DataFrame:
    """The eight counters of each queue. Unknown confidence is neither below the threshold nor ready here."""
    waits, c = F.col("status") == "needs_review", F.col("confidence")
    return marks.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(waits).alias("needs_review"), F.count_if(waits & (c < threshold)).alias("below_threshold"), F.count_if(waits & (c >= threshold)).alias("ready_bulk"),
        F.count_if(F.col("status") == "ocr_failed").alias("ocr_failed"), F.count_if(F.col("status") == "overridden").alias("overridden"),
        F.count_if(F.col("status").isin("approved", "auto_approved")).alias("approved"), F.count_if("flagged").alias("flagged"),
    )


def latest_attempt(submissions: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("attempt"), F.desc("submission_id"))
    return submissions.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def status_board(targets: DataFrame, submissions: DataFrame, as_of: Column) -> DataFrame:
    """Each targeted student's state, from the latest attempt; past the deadline without one it is missed."""
    joined = targets.join(latest_attempt(submissions, ["student"]), "student", "left")
    state = (
        F.when(F.col("submission_id").isNull(), F.when(F.col("deadline_at") < as_of, "missed").otherwise("not_started"))
        .when(F.col("released_at").isNotNull(), "returned")
        .when(F.col("submitted_at") > F.col("deadline_at"), "late")
        .when(F.col("submitted_at").isNotNull(), "submitted")
        .otherwise("in_progress")
    )
    return joined.withColumn("state", state)


def weak_spots(criteria: DataFrame, most_topics: int = 6, most_mistakes: int = 4) -> DataFrame:
    """``criteria(owner, topic, awarded, mistake, seq)``: per owner the topics with most misses, and their first mistakes.

    Mistakes are ordered by ``seq``; only distinct ones count.
    """
    missed = ~F.col("awarded")
    firsts = criteria.where(missed).groupBy("owner", "topic", "mistake").agg(F.min("seq").alias("seq"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("owner", "topic").orderBy("seq", "mistake"))).where(F.col("r") <= most_mistakes)
    listed = ranked.groupBy("owner", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "mistake"))), lambda x: x["mistake"]), "; ").alias("mistakes"))
    counted = criteria.groupBy("owner", "topic").agg(F.count_if(missed).alias("missed"), F.count("*").alias("total"), percent(F.count_if(F.col("awarded")), F.count("*"), 0).alias("accuracy"))
    order = Window.partitionBy("owner").orderBy(F.desc("missed"), "topic")
    top = counted.where("missed > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_topics)
    return top.join(listed, ["owner", "topic"])


def strongest_and_weakest(topics: DataFrame, by: str, at: float = 0.6, most: int = 2) -> DataFrame:
    """Of ``topics(by, topic, share)`` the best at or above ``at`` and the worst below."""
    good = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("share"), "topic"))
    poor = F.row_number().over(Window.partitionBy(by).orderBy("share", "topic"))
    ranked = topics.withColumn("g", good).withColumn("p", poor)
    best = ranked.where((F.col("share") >= at) & (F.col("g") <= most)).select(by, F.lit("strong").alias("kind"), "topic", "share")
    worst = ranked.where((F.col("share") < at) & (F.col("p") <= most)).select(by, F.lit("weak").alias("kind"), "topic", "share")
    return best.unionByName(worst)


def report_totals(rows: DataFrame, by: str) -> DataFrame:
    """Totals without withheld rows, their percent and band, and how much is withheld."""
    held = F.col("withheld")
    totals = rows.groupBy(by).agg(
        F.sum(F.when(~held, F.col("earned")).otherwise(0.0)).alias("earned"),
        F.sum(F.when(~held, F.col("available")).otherwise(0.0)).alias("available"),
        F.count_if(held).alias("n_withheld"),
        percent(F.sum(F.when(~held, F.col("earned")).otherwise(0.0)), F.sum(F.when(~held, F.col("available")).otherwise(0.0)), 0).alias("pct"),
    )
    return totals.withColumn("band", bands(F.col("pct"), GRADE, "U"))


def progress_points(submissions: DataFrame) -> DataFrame:
    """Handed-in results in the order of time within a student."""
    rows = submissions.where(F.col("status").isin(HANDED_IN) & F.col("submitted_at").isNotNull() & (F.col("total_marks") > 0))
    order = Window.partitionBy("student").orderBy("submitted_at", "submission_id")
    return rows.select("student", "submission_id", F.row_number().over(order).alias("n"), percent(F.col("total_score"), F.col("total_marks"), 0).alias("pct"), "is_full_paper")


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts in bins [edge, next edge); the last bin is open."""
    x, label = F.col(column), None
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        hit = (x >= lo) if hi is None else (x >= lo) & (x < hi)
        name = f"{lo:.2f}+" if hi is None else f"{lo:.2f}-{hi:.2f}"
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return values.withColumn("bin", label).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The values that come most often, the first by name of equal ones."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def mean_confidence(confidence: Column) -> Column:
    """The mean of those that are known, 0 if none is."""
    return F.coalesce(F.round(F.avg(confidence), 4), F.lit(0.0))


def active_students(enrollments: DataFrame, by: str, student: str) -> DataFrame:
    return enrollments.groupBy(by).agg(F.count_distinct(student).alias("seats"))
