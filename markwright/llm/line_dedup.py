"""Line dedup over overlapping windows of three lines, with DataFrame functions only.

A text is cut at each ``\\n``. Every three consecutive lines of a text are a window; texts of fewer lines have none. Of
the windows with equal lines over all documents the first stays (smallest doc_id, then text hash, then line); the
lines of each later one are removed, so that covered positions of overlapping windows merge. Windows are judged on
the input. Kept lines are joined by ``\\n`` again.

A window is known by two independent 64-bit hashes of its lines. The first occurrence of each is found by an
aggregation that combines before the shuffle; only windows that occur again are joined to it, in a join that adaptive
execution may split, so that a window which many documents share is not one task's work.

Results: null and empty text: null counts as no line, an empty text as one empty line; both stay. Rows with equal
doc_id and equal text are one document and get equal results. Null doc_ids come first. Other columns pass through;
columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import free

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, at, h1, h2): the windows of each distinct document; ``at`` counts lines from 0."""
    lines = F.split("text", "\n", -1)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), lines.alias("lines"))

    def hashes(i):
        cells = [F.element_at("lines", i + k) for k in range(1, size + 1)]
        return F.struct(i.cast("int").alias("at"), F.xxhash64(F.lit(1), *cells).alias("h1"), F.xxhash64(F.lit(2), *[F.concat(c, F.lit("\n")) for c in cells]).alias("h2"))

    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size)).otherwise(F.array().cast("array<int>"))
    return found.select("doc_id", "key", F.explode(F.transform(starts, hashes)).alias("w")).select("doc_id", "key", "w.*")


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with n_lines, n_removed, kept_text and kept_sha256 added."""
    every = windows(docs, size)
    place = F.struct("doc_id", "key", "at")
    again = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = every.join(again.select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first"))
    named = docs.drop("n_lines", "n_removed", "kept_text", "kept_sha256")
    d, k, starts, gone = (free(n, named.columns) for n in ("_doc", "_key", "_starts", "_gone"))
    covered = later.groupBy(F.col("doc_id").alias(d), F.col("key").alias(k)).agg(F.sort_array(F.collect_set("at")).alias(starts))
    joined = named.join(covered, named["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(named["text"]) == F.col(k)), "left")
    lines = F.split("text", "\n", -1)
    # stay and go in turn: what lies before a window's start and after the one before it, then what the window adds
    past = lambda j: F.when(j == 0, 0).otherwise(F.get(starts, j - 1) + size)
    turn = lambda j: F.concat(F.array_repeat(F.lit(True), F.get(starts, j) - past(j)), F.array_repeat(F.lit(False), F.get(starts, j) + size - F.greatest(past(j), F.get(starts, j))))
    stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 1), turn))
    tail = F.array_repeat(F.lit(True), F.size(lines) - F.element_at(starts, -1) - size)
    marked = joined.withColumn(gone, F.when(F.col(starts).isNotNull(), F.concat(stays, tail)))
    shown = F.transform(F.filter(F.arrays_zip(lines.alias("line"), F.col(gone).alias("stays")), lambda z: z["stays"]), lambda z: z["line"])
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(shown, "\n"))
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(gone, lambda x: ~x)))
    out = marked.withColumn("kept_text", kept).withColumn("n_removed", n_removed.cast("long")).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)).drop(d, k, starts, gone)
