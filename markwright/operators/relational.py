"""Joins, set operations and samples with the semantics that the analytics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_conflicts(rows: DataFrame, key: str, id_: str, start: str, end: str, bucket_s: int = 3600) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals overlap, each pair once (smaller id first).

    Intervals are dealt to the time buckets that they touch, so the join has an equi-key of bounded time; a pair counts
    in the first bucket that both touch.
    """
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_s)
    last = F.floor((F.unix_timestamp(F.col(end).cast("timestamp")) - 1) / bucket_s)
    dealt = rows.select(F.col(key).alias("k"), F.col(id_).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), at(start).alias("first"), F.explode(F.sequence(at(start), F.greatest(at(start), last))).alias("bucket"))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id"))
    meet = (F.col("a.s") < F.col("b.e")) & (F.col("a.e") > F.col("b.s")) & (F.col("a.bucket") == F.greatest("a.first", "b.first"))
    return a.join(b, same & meet).select(F.col("a.k").alias(key), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the latest right row of its key at or before it; one pass over a sorted union."""
    l = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value))  # noqa: E741
    r = right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), value)
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_side = 1").drop("_at", "_side")


def union_by_id(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """Rows of both, each id once; those of ``a`` win."""
    return a.unionByName(b.join(a.select(id_), id_, "left_anti")).dropDuplicates([id_])


def overlay(base: DataFrame, repaired: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer by keys; repaired values win where there are any."""
    r = repaired.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(r, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def seeded_order(id_: Column, seed: int) -> Column:
    """A reproducible random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", id_.cast("string"), F.lit(str(seed))))


def placed(rows: DataFrame, by: str, bucket: Column, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``: the rank within ``by``, in the order of ``bucket`` (a whole number) and then of ``order``.

    Ranks are worked out within buckets, to which the sizes of those before are added, so that a group of any size is
    many tasks' work. The table of buckets is small: one row for each group and bucket.
    """
    known = rows.withColumn("_b", bucket)
    sizes = known.groupBy(F.col(by).alias("_g"), F.col("_b").alias("_k")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))
    ranked = known.withColumn("_r", inner).join(sizes.withColumn("_before", before), F.col(by).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_k")))
    return ranked.withColumn("place", (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_g", "_k", "_n", "_before", "_r")


def seeded_sample(rows: DataFrame, id_: str, stratum: str, rate: float, seed: int) -> DataFrame:
    """From each stratum max(1, ceil(n * rate)) rows without replacement; the rate is kept between 0.01 and 1.

    Rows are ranked by a hash of their id, within buckets of its first three digits.
    """
    rate = min(1.0, max(0.01, rate))
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(rate))).cast("long").alias("_quota"))
    h = seeded_order(F.col(id_), seed)
    ranked = placed(rows, stratum, F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), h, F.col(id_))
    return ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("place") <= F.col("_quota")).withColumnRenamed("place", "pick").drop("_s", "_quota")


def renumber(rows: DataFrame, groups: list[str], order: list[Column], id_: str) -> DataFrame:
    """Numbers within groups, and ids whose second and later uses get a suffix."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    use = F.row_number().over(Window.partitionBy(id_).orderBy(*order))
    unique = F.when(use > 1, F.concat(F.col(id_).cast("string"), F.lit("-part-"), use.cast("string"))).otherwise(F.col(id_).cast("string"))
    return rows.withColumn("number", n).withColumn("unique_id", unique)


def top_two_margin(scored: DataFrame, by: str, score: str) -> DataFrame:
    """Best score and its lead over the second; the lead is 1 if there is no second, and 0 if there is no score at all."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(score))
    ranked = scored.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    first, second = F.max(F.when(F.col("_r") == 1, F.col(score))), F.max(F.when(F.col("_r") == 2, F.col(score)))
    return ranked.groupBy(by).agg(first.alias("best"), F.when(first.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), first - second)).alias("margin"))


def pair_once(questions: DataFrame, entries: DataFrame, key: list[str], order: str) -> DataFrame:
    """Exact pairing in which each right row is used once: the n-th left with the n-th right row of a key."""
    nth = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return nth(questions).join(nth(entries).drop(order), [*key, "_n"], "full")


def pair_with_fallback(questions: DataFrame, entries: DataFrame, paper: str) -> DataFrame:
    """``questions(paper, number, sub, pos)`` with ``entries(paper, number, sub, pos)``, each entry used once.

    First the n-th question of a key with its n-th entry (``exact_key``). A question without a part that is left over takes
    the only entry left of its number, if it is the only such question (``same_question_unique_sub_safe``). Several entries
    left over are an issue (``ambiguous``). The result holds every row of both sides once: q_pos, e_pos, method, ambiguous.
    """
    nth = lambda d, name: d.select(paper, "number", "sub", F.col("pos").alias(name), F.row_number().over(Window.partitionBy(paper, "number", "sub").orderBy("pos")).alias("_n"))
    exact = nth(questions, "q_pos").join(nth(entries, "e_pos"), [paper, "number", "sub", "_n"], "full").drop("_n")
    whole = exact.where("q_pos IS NOT NULL AND e_pos IS NOT NULL").withColumn("method", F.lit("exact_key")).withColumn("ambiguous", F.lit(False))
    left = exact.where("e_pos IS NULL").withColumn("turn", F.when(F.col("sub") == "", F.row_number().over(Window.partitionBy(paper, "number").orderBy(F.col("sub") != "", "q_pos"))))
    right = exact.where("q_pos IS NULL").select(paper, "number", F.col("sub").alias("e_sub"), "e_pos")
    rest = right.groupBy(paper, "number").agg(F.count("*").alias("n"), F.min("e_pos").alias("only"))
    tried = left.drop("e_pos").join(rest, [paper, "number"], "left")
    safe = (F.col("turn") == 1) & (F.col("n") == 1)
    tried = tried.withColumn("e_pos", F.when(safe, F.col("only"))).withColumn("method", F.when(safe, "same_question_unique_sub_safe")).withColumn("ambiguous", F.coalesce(F.col("n") > 1, F.lit(False)))
    used = tried.where("e_pos IS NOT NULL").select(paper, "number", "e_pos")
    unused = right.join(used, [paper, "number", "e_pos"], "left_anti").select(paper, "number", F.col("e_sub").alias("sub"), F.lit(None).cast("long").alias("q_pos"), "e_pos", F.lit(None).cast("string").alias("method"), F.lit(False).alias("ambiguous"))
    columns = [paper, "number", "sub", "q_pos", "e_pos", "method", "ambiguous"]
    return whole.select(*columns).unionByName(tried.select(*columns)).unionByName(unused.select(*columns))


#: counts of a paper that speak against its structure, and the reason that each gives
STRUCTURE = {
    "invalid_qp": "invalid_qp_ids_detected", "invalid_ms": "invalid_ms_ids_detected", "duplicate_qp": "duplicate_qp_ids_detected", "duplicate_ms": "duplicate_ms_ids_detected",
    "conflicts": "parse_conflicts_detected", "issues": "pairing_issues_detected",
}


def pair_status(papers: DataFrame, confidence: float = 0.75, coverage: float = 0.80) -> DataFrame:
    """``papers`` with status and its reasons in alphabetical order.

    Columns: n_qp, n_ms, matched, qp_confidence, ms_confidence, mcq, missing_qp, missing_ms and those of ``STRUCTURE``.
    """
    c, zero = F.col, F.lit(0)
    balanced = c("matched") / F.greatest(c("n_qp"), c("n_ms"), F.lit(1))
    hard = F.array_compact(F.array(F.when(c("n_qp") == 0, "no_qp_items"), F.when(c("n_ms") == 0, "no_ms_items"), F.when(c("matched") == 0, "no_matches")))
    soft = F.array_compact(F.array(
        F.when(c("qp_confidence") < confidence, "low_qp_confidence"), F.when(c("ms_confidence") < confidence, "low_ms_confidence"), F.when(balanced < coverage, "low_match_coverage"),
        *[F.when(c(n) > zero, reason) for n, reason in STRUCTURE.items()],
        F.when(c("mcq") & (c("missing_ms") > zero), "missing_expected_ms_questions"), F.when(c("mcq") & (c("missing_qp") > zero), "missing_expected_qp_questions"),
    ))
    failed = F.size(hard) > 0
    status = F.when(failed, "failed").when(F.size(soft) > 0, "review_required").otherwise("accepted")
    return papers.withColumn("reasons", F.array_sort(F.when(failed, hard).otherwise(soft))).withColumn("status", status).withColumn("coverage", F.when(failed, 0.0).otherwise(F.round(balanced, 4)))


def repair_triggers(papers: DataFrame) -> Column:
    """Why a paper is worth a repair, in alphabetical order; other reasons for multiple choice than for structured papers."""
    c = F.col
    both = {"duplicate_qp": "duplicate_qp_ids", "duplicate_ms": "duplicate_ms_ids", "conflicts": "parser_conflicts", "issues": "pairing_issues", "unmatched_qp": "unmatched_qp", "unmatched_ms": "unmatched_ms"}
    mcq = {"missing_qp": "missing_qp_questions", "missing_ms": "missing_ms_questions"}
    structured = {"invalid_qp": "invalid_qp_ids", "invalid_ms": "invalid_ms_ids"}
    low = ~c("mcq") & (c("matched") / F.greatest(c("n_qp"), c("n_ms"), F.lit(1)) < 0.8)
    reasons = [F.when(c(n) > 0, r) for n, r in both.items()] + [F.when(c("mcq") & (c(n) > 0), r) for n, r in mcq.items()] + [F.when(~c("mcq") & (c(n) > 0), r) for n, r in structured.items()]
    return F.array_sort(F.array_compact(F.array(*reasons, F.when(low, "low_coverage_balanced"))))


def repair_score() -> Column:
    """What a repaired pairing is worth: 10 for each match, less for all that is missing, left over, in conflict or invalid."""
    weights = {"matched": 10, "missing_qp": -8, "missing_ms": -8, "unmatched_qp": -4, "unmatched_ms": -4, "conflicts": -6, "issues": -6, "invalid_qp": -10, "invalid_ms": -10}
    return sum((F.col(n) * w for n, w in weights.items()), F.lit(0)).cast("long")


def is_ambiguous(papers: DataFrame) -> Column:
    """Whether a reading has to be looked at again: n_items, n_words, n_keys (distinct), mcq, n_numbers, expected."""
    c = F.col
    few = c("n_numbers") < F.greatest(F.lit(5), F.floor(c("expected") * 0.9))
    return (c("n_items") == 0) | F.when(c("mcq"), few).otherwise(((c("n_items") == 1) & (c("n_words") > 250)) | (1 - c("n_keys") / F.greatest(c("n_items"), F.lit(1)) > 0.35))


def status_totals(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many are accepted, review_required and failed, and their total."""
    kinds = ("accepted", "review_required", "failed")
    return rows.agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds], F.count_if(F.col(status).isin(*kinds)).alias("total"))


def pairing_quality(pairs: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """Coverage of both sides, the balanced one, and the status with its reasons in order."""
    m = F.count_if(F.col(left).isNotNull() & F.col(right).isNotNull())
    q, e = F.count_if(F.col(left).isNotNull()), F.count_if(F.col(right).isNotNull())
    one = F.lit(1)
    out = pairs.groupBy(by).agg(m.alias("matched"), q.alias("n_left"), e.alias("n_right"))
    share = lambda of: F.round(F.col("matched") / F.greatest(of, one), 4)
    out = out.withColumn("left_coverage", share(F.col("n_left"))).withColumn("right_coverage", share(F.col("n_right"))).withColumn("balanced", share(F.greatest("n_left", "n_right")))
    reasons = F.array_compact(F.array(
        F.when(F.col("matched") == 0, "no_pairs"), F.when(F.col("left_coverage") < 0.9, "left_uncovered"), F.when(F.col("right_coverage") < 0.9, "right_uncovered")
    ))
    status = F.when(F.col("matched") == 0, "failed").when(F.size(reasons) == 0, "accepted").otherwise("review_required")
    return out.withColumn("status", status).withColumn("reasons", F.array_join(reasons, ","))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(seen: DataFrame, by: str, number: str, expected: Column, discounted: Column | None = None) -> DataFrame:
    """Numbers of 1..expected that are absent, and those beyond. Discounted ones are not expected."""
    got = seen.groupBy(by).agg(F.sort_array(F.collect_set(number)).alias("got"), F.max(expected).alias("expected"), F.first(F.array().cast("array<int>") if discounted is None else discounted).alias("off"))
    want = F.when(F.col("expected") >= 1, F.array_except(F.sequence(F.lit(1), F.col("expected").cast("int")), "off")).otherwise(F.array().cast("array<int>"))
    return got.select(by, F.array_except(want, F.col("got")).alias("missing"), F.array_except(F.col("got"), want).alias("extra"))


def ordered(by: str, *order: Column | str):
    return Window.partitionBy(by).orderBy(*order)


def stratified_packs(rows: DataFrame, by: str, id_: str, flag: str, wanted: int, total: int, seed: int) -> DataFrame:
    """For each ``by`` a pack of ``total`` rows, ``wanted`` of them with the flag; where one kind falls short the other fills up."""
    order = [seeded_order(F.col(id_), seed), F.col(id_)]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, flag).orderBy(*order)))
    due = F.when(F.col(flag), F.col("_r") <= wanted).otherwise(F.col("_r") <= total - wanted)
    # no more than ``total`` of a kind can be picked
    return ranked.where(F.col("_r") <= total).withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(due.desc(), *order))).where(F.col("_p") <= total).drop("_r", "_p")


def regroup(rows: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """Items in two levels: for each outer value an array of (inner value, sorted items)."""
    lists = rows.groupBy(outer, inner).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return lists.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, "items"))).alias("groups"))


def nested(rows: DataFrame, top: list[str], levels: list[str], item: str) -> DataFrame:
    """Items in levels below ``top``: the innermost are sorted sets, each level above an array in its order (names in plural)."""
    out, column = rows.groupBy(*top, *levels).agg(F.sort_array(F.collect_set(item)).alias(f"{item}s")), f"{item}s"
    for k in range(len(levels) - 1, -1, -1):
        out = out.groupBy(*top, *levels[:k]).agg(F.array_sort(F.collect_list(F.struct(levels[k], column))).alias(f"{levels[k]}s"))
        column = f"{levels[k]}s"
    return out


def folder_order(name: str, kind: str) -> list[Column]:
    """Folders before papers before other files, then by name without regard to case."""
    rank = F.when(F.col(kind) == "folder", 0).when(F.col(kind) == "paper", 1).otherwise(2)
    return [rank, F.lower(F.col(name)), F.col(name)]


def paper_order(subject: str, year: str, session: str, paper: str, variant: str) -> list[Column]:
    """The five keys that papers are sorted by; what is missing comes first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [text(subject), F.coalesce(F.col(year), F.lit(0)), text(session), text(paper), text(variant)]


def pairs_by_class(rows: DataFrame, by: list[str], id_: str, first: Column) -> DataFrame:
    """Pairs of rows of one class (``by``), one with ``first`` and one of a larger id, without making them: for each row
    (id, class_id, links) with the smallest id of its class and the number of pairs that it is in.

    Rows are ranked within buckets of their class by ranges of the id, to which the sums of the buckets before are added.
    """
    #: fixed value: rows in a bucket, about
    size = 1 << 16
    counted = rows.where(F.concat(*[F.col(c).cast("string") for c in by]).isNotNull()).groupBy(*by, id_).agg(F.count("*").alias("_c"), F.count_if(first).alias("_f")).withColumn("_b", F.floor(F.col(id_) / size))
    buckets = counted.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"), F.sum("_f").alias("_bf"), F.min(id_).alias("_least"))
    before, whole = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = buckets.select(*by, "_b", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_pc"), F.coalesce(F.sum("_bf").over(before), F.lit(0)).alias("_pf"), F.sum("_bc").over(whole).alias("_all"), F.min("_least").over(whole).alias("class_id"))
    upto = Window.partitionBy(*by, "_b").orderBy(id_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"_rc": F.sum("_c").over(upto), "_rf": F.sum("_f").over(upto)}).join(sums, [*by, "_b"])
    later, earlier = F.col("_all") - F.col("_pc") - F.col("_rc"), F.col("_pf") + F.col("_rf") - F.col("_f")
    return ranked.select(F.col(id_).alias("id"), "class_id", (F.col("_f") * later + F.col("_c") * earlier).alias("links"))


def pairs_within(rows: DataFrame, by: list[str], id_: str, first: Column, block: int = 2048) -> DataFrame:
    """Pairs of rows of one class (``by``), one with ``first`` and one of a larger id: (a, b, n) with their ids and of how
    many pairs of rows they are, over all classes. Every pair is a row, and they grow with the square of a class.

    A class is cut into blocks of some ``block`` ids by hash, and each two blocks meet in a group of their own; a task holds
    one block at a time, and the number of tasks grows with the pairs. Copies of an id are one row with a count. Two ids
    can only share several classes if both are in several: only those pairs are added up by a shuffle.
    """
    c = [f"_k{i}" for i in range(len(by))]
    counted = rows.where(F.concat(*[F.col(k).cast("string") for k in by]).isNotNull() & F.col(id_).isNotNull()).groupBy(F.col(id_).alias("_id"), *[F.col(k).alias(n) for k, n in zip(by, c, strict=True)]).agg(F.count("*").alias("_c"), F.count_if(first).alias("_f"))
    counted = counted.withColumn("_many", F.count("*").over(Window.partitionBy("_id")) > 1)
    sizes = counted.groupBy(*c).agg(F.ceil(F.count("*") / block).alias("_s"))
    #: fixed value: groups in a part, about, and parts at most
    groups, most = 4, 1 << 16
    met = sizes.agg(F.sum(F.col("_s") * F.col("_s"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, met // groups))
    placed = counted.join(sizes, c).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_s"))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    left = placed.where("_f > 0").select(*c, F.col("_own").alias("_l"), F.col("_other").alias("_r"), F.col("_id").alias("a"), "_f", F.col("_many").alias("_am"))
    right = placed.select(*c, F.col("_other").alias("_l"), F.col("_own").alias("_r"), F.col("_id").alias("b"), "_c", F.col("_many").alias("_bm"))
    keys = [*c, "_l", "_r"]
    meet = lambda x, y: x.repartition(parts, *keys).join(y.repartition(parts, *keys), keys).where("a < b")
    n = (F.col("_f") * F.col("_c")).alias("n")
    once = meet(left, right).where("NOT (_am AND _bm)").select("a", "b", n)
    return once.unionByName(meet(left.where("_am"), right.where("_bm")).groupBy("a", "b").agg(F.sum(n).alias("n")))
