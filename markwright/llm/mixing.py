"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes in words; each source's documents get a fixed random order (a hash of the id), and the source is the endless
   stream of its documents in that order, pass after pass.
2. Targets: the sources' weights share the words of all documents. A target stops at ``most`` times its source's
   words; the excess goes to the others by weight until none is above.
3. A source's stream up to its target is cut into blocks of ``block_words`` (longer ones where the mix would have over
   ``MOST_BLOCKS``, so that every draw is within the exact sampler's range); their number is its exact quota. A document
   belongs, whole, to the block in which it starts; only the last document before a target may be cut.
4. The splitting tree hands the quotas to the output shards: the root holds all quotas, and every node splits its
   vector of quotas between its halves by a draw from the multivariate hypergeometric distribution, so that all
   shards get equally many blocks and each source's quota is used up exactly. One task draws the upper levels, the
   subtrees below go on in parallel.
5. A shard's slots name blocks of a source's list by a keyed permutation, disjointly from the other shards'. What is
   drawn is what the slots name; ``mixed`` returns these documents, and each shard shuffles its own by a hashed place.

All randomness is hashed or seeded, so reruns agree. Sums over a source run in hash buckets of bounded size, so that a
source with a third of all rows is not one task's work.

Results: null source is a source of its own, the last; null text and texts without words have size 0 and are not
mixed; sources without words have target 0. Rows that repeat an id are separate documents. An empty table gives an
empty mix. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.common import Scratch, free, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 8192
BUCKET_ROWS = 4096
MOST = 3.0
SHARD_BLOCKS = 64
MOST_BLOCKS = 1 << 29  # the library draws from up to 10**9
SUBTREES = 4096
ROUNDS = 48  # of the permutation


def _numbered(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources in code-point order, null last, with their number and weight. One row for each source goes in."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    return sources.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("number") % len(weights)))


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with number, weight and target. Each round caps the sources that are above."""
    table = scratch.save(_numbered(sources, weights).withColumn("capped", F.col("source_size") == 0), "sources0")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    limit, rounds = F.col("source_size") * most, 0
    while True:
        fixed, free = table.agg(F.sum(F.when(F.col("capped"), limit).otherwise(0.0)), F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0))).first()
        unit = (total - (fixed or 0.0)) / free if free else 0.0
        above = ~F.col("capped") & (F.col("weight") * unit > limit)
        if not table.where(above).limit(1).count():
            break
        rounds += 1
        table = scratch.save(table.withColumn("capped", F.col("capped") | above), f"sources{rounds}")
    return table.withColumn("target", F.when(F.col("capped"), limit).otherwise(F.col("weight") * F.lit(float(unit)))).drop("capped")


def _split_task(seed: int, until: int):
    """Splits a node (rows of one low and high) down to nodes of ``until`` shards at most."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("number")
        done: list[pd.DataFrame] = []
        stack = [(int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0]), pdf["number"].to_numpy(), pdf["quota"].to_numpy(np.int64), pdf["before"].to_numpy(np.int64))]
        while stack:
            low, high, numbers, quotas, before = stack.pop()
            some = quotas > 0
            numbers, quotas, before = numbers[some], quotas[some], before[some]
            if high - low <= until or not len(quotas):
                done.append(pd.DataFrame({"number": numbers, "low": low, "high": high, "quota": quotas, "before": before}))
                continue
            # shards get equally many blocks, the first ones the odd ones: the node's blocks are shared in the ratio of shards
            middle, rest = (low + high) // 2, int(quotas.sum())
            left = -(-rest * (middle - low) // (high - low))
            drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quotas, left, method="marginals")
            stack += [(low, middle, numbers, drawn, before), (middle, high, numbers, quotas - drawn, before + drawn)]
        return pd.concat(done)[["number", "low", "high", "quota", "before"]]

    return run


def splitting_tree(quotas: DataFrame, shards: int, scratch: Scratch, seed: int = 5, subtrees: int = SUBTREES) -> DataFrame:
    """``quotas(number, quota)`` -> (number, shard, quota, before): a source's blocks for a shard, and for earlier ones."""
    nodes = quotas.where("quota > 0").select("number", F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("quota").cast("long").alias("quota"), F.lit(0).cast("long").alias("before"))
    for until in sorted({max(1, -(-shards // subtrees)), 1}, reverse=True):
        nodes = scratch.save(nodes.groupBy("low", "high").applyInPandas(_split_task(seed, until), nodes.schema), f"tree{until}")
    return nodes.select("number", F.col("low").alias("shard"), "quota", "before")


def permuted(place: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..size-1, of any size: swap-or-not rounds. Each pairs the places x and k - x, and swaps
    a pair or leaves it by a hashed bit that both share."""

    def turn(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), size) - x, size)
        return F.when(F.xxhash64(key, F.lit("bit"), i, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), turn)


def positions(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 3) -> DataFrame:
    """(doc_id, source, size, number, source_size, target, pos): where each document starts in its source's order."""
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, most)
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    known = sources.select(F.col("source").alias("s2"), "number", "source_size", "target")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s2")))
    out = placed.select("doc_id", "source", "size", "number", "source_size", "target", (F.col("offset") + F.col("inner")).cast("long").alias("pos"))
    out = scratch.save(out, "positions")
    scratch.drop("sized")
    return out


def mix(docs: DataFrame, shards: int | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_words: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it draws from.

    Mix: (shard, place, doc_id, number, pos, pass, words), a row for each drawn document: ``place`` is its random place
    in the shard; ``words`` is how many of its words are taken, from its start. Documents: as ``positions`` returns.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    placed = positions(docs, scratch, weights, most)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    goals = placed.groupBy("number").agg(F.max(goal).alias("goal"))
    if block_words is None:
        block_words = max(BLOCK_WORDS, -(-(goals.agg(F.sum("goal")).first()[0] or 0) // MOST_BLOCKS))
    quotas = scratch.save(goals.select("number", F.ceil(F.col("goal") / block_words).cast("long").alias("quota")), "quotas")
    if shards is None:
        shards = max(1, (quotas.agg(F.sum("quota")).first()[0] or 0) // SHARD_BLOCKS)
    tree = splitting_tree(quotas, shards, scratch, seed)
    slots = tree.select("number", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1)).alias("slot"))
    slots = slots.join(quotas, "number").select(F.col("number").alias("n2"), "shard", permuted(F.col("slot"), F.col("quota"), F.xxhash64(F.lit(seed), "number")).alias("b2"))
    slots = scratch.save(slots, "slots")
    scratch.drop("tree1")
    size, whole, turn = F.col("size"), F.col("source_size"), F.col("pass")
    drawn = placed.where("size > 0").withColumn("goal", goal)
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most))))).withColumn("start", turn * whole + F.col("pos")).where(F.col("start") < F.col("goal"))
    drawn = drawn.withColumn("words", F.least(size, F.col("goal") - F.col("start"))).withColumn("block", F.floor(F.col("start") / block_words))
    units = drawn.join(slots, (F.col("number") == F.col("n2")) & (F.col("block") == F.col("b2")))
    place = F.xxhash64(F.lit(seed + 2), "shard", "number", "pos", "pass")
    return units.select("shard", place.alias("place"), "doc_id", "number", "pos", "pass", "words"), placed


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` themselves, with ``shard`` and ``place`` (columns of those names are replaced).

    A row comes once for each time it is drawn; the last one before a target keeps its first words only. A shard's rows
    stand in one partition in the order of their place, so that written files are shuffled shards.
    """
    docs = docs.drop("shard", "place")
    drawn, placed = mix(docs, **options)
    # mix() knows rows by number and pos; of equal id, source and size, the n-th place is the n-th row's
    size, nth, words = (free(n, docs.columns) for n in ("_size", "_nth", "_words"))
    of = ["u_doc_id", "u_source", "u_size"]
    places = placed.where("size > 0").select(*[F.col(c).alias(f"u_{c}") for c in ("doc_id", "source", "size", "number", "pos")])
    places = places.withColumn("u_nth", F.row_number().over(Window.partitionBy(*of).orderBy("u_pos")))
    units = drawn.select("shard", "place", "number", "pos", F.col("words").alias(words)).join(places, (F.col("number") == F.col("u_number")) & (F.col("pos") == F.col("u_pos")))
    sized = docs.withColumn(size, word_count(F.col("text"))).where(F.col(size) > 0)
    if placed.where("size > 0").groupBy("doc_id", "source", "size").count().where("count > 1").limit(1).count():
        rest = F.xxhash64(*[f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])
        sized = sized.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(rest)))
    else:
        sized = sized.withColumn(nth, F.lit(1))
    same = (F.col(size) == F.col("u_size")) & (F.col(nth) == F.col("u_nth")) & F.col("doc_id").eqNullSafe(F.col("u_doc_id")) & F.col("source").eqNullSafe(F.col("u_source"))
    out = sized.join(units.select("shard", "place", words, *of, "u_nth"), same)
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col(words) < F.col(size), F.array_join(F.slice(parts, 1, F.col(words).cast("int")), "")).otherwise(F.col("text"))
    out = out.withColumn("text", text).select(*docs.columns, "shard", "place")
    return out.repartition("shard").sortWithinPartitions("shard", "place")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The mix as a folder for each shard, its documents in their shuffled order."""
    mixed(docs, **options).write.mode("overwrite").partitionBy("shard").parquet(path)


def taken(docs: DataFrame, **options) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, taken, copies."""
    drawn, placed = mix(docs, **options)
    sums = drawn.groupBy(F.col("number").alias("n"), F.col("pos").alias("p"), F.col("doc_id").alias("d")).agg(F.sum("words").alias("w"), F.count("*").alias("c"))
    found = placed.join(sums, (F.col("size") > 0) & (F.col("number") == F.col("n")) & (F.col("pos") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("w", F.lit(0)).cast("long").alias("taken"), F.coalesce("c", F.lit(0)).cast("long").alias("copies"))
