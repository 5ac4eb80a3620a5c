"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct shingles of ``size`` words (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is one). Two documents link when
``den * intersection >= num * union``. Equal sets are one node of the join.

1. Tokens get one order for all: a sketch of counters over every document tells frequent tokens, which come last. Of
   each set only its first tokens travel: those that ``LEVEL`` of which any partner must share (with
   ``t = ceil(num/den * n)`` tokens to share, of the first ``n - t + LEVEL`` at least ``min(LEVEL, t)`` are common).
2. Groups of similar documents: each document is tried against the leaders (the smallest ids) of the tokens that it
   shares most, and what proves to be linked is one group. This repeats while groups still merge.
3. The token-group matrix: for each token the groups whose union of tokens holds it. Documents of whose tokens too
   few are held by other groups at all are set aside: no partner can reach what a link needs. Of the others, a document's overlap with any
   member of a group is bounded by how many of its first tokens the group's union holds, and by how many tokens
   follow the first of them; only groups whose bounds reach what a link needs are opened.
4. Opened groups: the document against each member of fitting size, on the whole sets. Nothing is capped.

Pairs inside a group are never listed, so copies in thousands cost as much as their number; links between groups are
all found, so the components are exact.

Results: null, empty and blank texts have no shingles and link with nothing. Each row is a document of its own: rows
that repeat an id have each its own links, and its component is the smallest id that they reach. A row with a null id
links nothing: it has its own size and a null component.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.common import ROW, Scratch, as_bytes, chunks, hash_words, mix64, row_ids, tidy
from markwright.llm.components import components

LEVEL = 3
ROUNDS = 3
BUCKET_BYTES = 12 << 20
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SLICES = 64
LANES = 64  # sums of counters meet in two steps


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def combined(h: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(h) - k + 1), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * step + h[j : j + len(out)]
        return mix64(out)

    for lo, hi in chunks(texts):
        hashes, counts = hash_words(texts[lo:hi], LOWER)
        rolled, at = combined(hashes, size), 0
        for n in counts.tolist():
            own = rolled[at : at + n - size + 1] if n >= size else combined(hashes[at : at + n], n) if n else hashes[:0]
            at += n
            own = np.sort(own)
            if len(own) > 1:
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            yield own


def _sketch_task(size: int, bits: int):
    """Counters (up to 255) of all tokens, by their lowest bits, in slices."""

    def run(batches: Iterator):
        import pyarrow as pa
        import zstandard

        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for tokens in shingle_sets(as_bytes(batch.column(0)), size):
                at = (tokens & np.uint64((1 << bits) - 1)).astype(np.int64)
                counts[at] += counts[at] < 255
        rows = [zstandard.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    return run


def _sum_task(kind: str, limit: int | None):
    """Rows sorted by (slice, lane): one row of sums for each, or with a limit one bit for each counter above it.

    A task holds one sum and one row at a time.
    """

    def run(batches: Iterator):
        import pyarrow as pa
        import zstandard

        key, total = None, None

        def row():
            body = zstandard.compress(total.tobytes(), 1) if limit is None else np.packbits(total > limit).tobytes()
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "lane", "counts"])

        for batch in batches:
            for piece, lane, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(zstandard.decompress(data), kind).astype(np.uint32)
                if key != (piece, lane):
                    if key is not None:
                        yield row()
                    key, total = (piece, lane), x
                else:
                    total = np.minimum(total + x, 1 << 31)
        if key is not None:
            yield row()

    return run


def heavy_tokens(docs: DataFrame, size: int, bits: int, limit: int) -> bytes:
    """One bit for each counter, on if more than ``limit`` documents count there. 2**bits bits, whatever the input."""
    slices = docs.select("text").mapInArrow(tidy(_sketch_task(size, bits)), "slice int, counts binary")
    kind = "slice int, lane int, counts binary"
    lanes = slices.select("slice", F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"), "counts")
    sums = lanes.repartition("slice", "lane").sortWithinPartitions("slice", "lane").mapInArrow(_sum_task("u1", None), kind)
    ends = sums.select("slice", F.lit(0).alias("lane"), "counts").repartition("slice").sortWithinPartitions("slice").mapInArrow(_sum_task("<u4", limit), kind)
    found = {r["slice"]: r["counts"] for r in ends.collect()}
    return b"".join(found.get(i, bytes((1 << bits) // SLICES // 8)) for i in range(SLICES))


def needed(n: int, num: int, den: int) -> int:
    """Tokens that any partner of a set of ``n`` shares at least."""
    return -(-num * n // den)


def _sets_task(size: int, num: int, den: int, heavy, bits: int):
    def run(batches: Iterator):
        import pyarrow as pa
        import xxhash

        flags = np.unpackbits(np.frombuffer(heavy.value, np.uint8))
        for batch in batches:
            n, sig1, sig2, prefix = [], [], [], []
            for tokens in shingle_sets(as_bytes(batch.column(1)), size):
                raw = tokens.tobytes()
                n.append(len(tokens))
                sig1.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                sig2.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                keep = min(len(tokens), len(tokens) - needed(len(tokens), num, den) + LEVEL) if len(tokens) else 0
                late = flags[(tokens & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint64)
                order = np.sort((late << np.uint64(63)) | (tokens >> np.uint64(1)))
                prefix.append(order[:keep].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "s1", "s2", "prefix"])

    return run


POSTING = np.dtype([("t", "<u8"), ("id", "<i8"), ("group", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _postings_task(buckets: int):
    """In: id, n, prefix, group. Out: batches of postings by bucket of the token."""

    def run(batches: Iterator):
        import pyarrow as pa
        import zstandard

        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal size
            rows: tuple[list, list] = ([], [])
            if held:
                p = np.concatenate(held)
                bucket = mix64(p["t"]) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    mine = p[order[edges[b] : edges[b + 1]]]
                    if len(mine):
                        body = b"".join(np.ascontiguousarray(mine[f]).tobytes() for f in POSTING.names)
                        rows[0].append(b)
                        rows[1].append(struct.pack("<I", len(mine)) + zstandard.compress(body, 1))
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["bucket", "body"])

        for batch in batches:
            for i, n, prefix, group in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                t = np.frombuffer(prefix, "<u8")
                p = np.empty(len(t), POSTING)
                p["t"], p["id"], p["group"], p["n"], p["at"] = t, i, group, n, np.arange(len(t))
                held.append(p)
                size += len(t)
                if size > 1_500_000:
                    yield flush()
        yield flush()

    return run


def _unpack(bodies: list[bytes]) -> np.ndarray:
    import zstandard

    out = []
    for data in bodies:
        (n,) = struct.unpack_from("<I", data)
        raw, p, at = zstandard.decompress(data[4:]), np.empty(n, POSTING), 0
        for f in POSTING.names:
            kind = POSTING[f]
            p[f] = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize
        out.append(p)
    return np.concatenate(out)


def _buckets(batches: Iterator, work) -> Iterator:
    """Rows come sorted by bucket; ``work`` gets all postings of one bucket."""
    bucket, bodies = None, []
    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bodies and b != bucket:
                yield from work(_unpack(bodies))
                bodies = []
            bucket = b
            bodies.append(body)
    if bodies:
        yield from work(_unpack(bodies))


def _counted(a: np.ndarray, b: np.ndarray, bound: np.ndarray, least: np.ndarray, most: np.ndarray, names: tuple[str, str]):
    """A batch of the distinct pairs: how often each occurs, its largest bound, and the range of the partners' sizes."""
    import pyarrow as pa

    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    if len(at):
        bound, least, most = np.maximum.reduceat(bound[order], at), np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)
    columns = [a[at], b[at], np.diff(np.append(at, len(a))), bound, least, most]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names, "shared", "bound", "least", "most"])


def may_link(n: Column, num: int, den: int) -> Column:
    """Whether a set of ``n`` can link with a partner of least..most tokens, by ``shared`` and ``bound``.

    Tokens to share with a partner of m: t(m) = num * (n + m) / (num + den). All common tokens follow the first common
    one, so ``bound`` must reach t(least). The common tokens beyond the ones that travelled are fewer than
    max(needed(n), needed(m)) - LEVEL + 1, so ``shared`` must reach t(m) less that, for the least or the most m.
    """
    alone = lambda m: F.ceil(m * num / den)
    low, high = F.greatest(F.col("least"), alone(n)), F.least(F.col("most"), F.floor(n * den / num))
    together = lambda m: F.ceil((n + m) * num / (num + den) - 1e-9)
    rest = lambda m: F.greatest(alone(n), alone(m)) - LEVEL
    enough = F.least(together(low) - rest(low), together(high) - rest(high)) - F.when(low < high, 1).otherwise(0)  # rounding in between
    return (low <= high) & (F.col("bound") >= together(low)) & (F.col("shared") >= F.least(F.greatest(enough, F.lit(1)), alone(n)))


def _lists(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings sorted by (token, group, id), and for each the begin and end of its token's list."""
    p = p[np.lexsort((p["id"], p["group"], p["t"]))]
    new = np.ones(len(p), bool)
    new[1:] = p["t"][1:] != p["t"][:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(p)))
    return p, np.repeat(at, size), np.repeat(at + size, size)


def _star_work(turn: int):
    """Each document with one leader of each list: the first of the first group, or in later turns of another one."""

    def work(p: np.ndarray):
        p, begin, end = _lists(p)
        many = p["group"][begin] != p["group"][end - 1]
        p, begin, end = p[many], begin[many], end[many]
        full = np.zeros(0, np.int64)
        if len(p):
            # places refer to the filtered postings again
            new = np.ones(len(p), bool)
            new[1:] = p["t"][1:] != p["t"][:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(p)))
            full = np.repeat(at + (0 if turn == 0 else (p["t"][at] >> np.uint64(7 * turn)).astype(np.int64) % size), size)
        leader = p["id"][full]
        use = p["group"] != p["group"][full]
        a, b = leader[use], p["id"][use]
        n_a, n_b = p["n"][full][use].astype(np.int64), p["n"][use].astype(np.int64)
        bound = np.minimum(n_a - p["at"][full][use], n_b - p["at"][use])
        yield _counted(b, a, bound, n_a, n_a, ("q", "g"))

    return work


def _live_work(p: np.ndarray):
    """Documents with how many of their tokens other groups hold too, and the sizes that those lists reach."""
    p, begin, end = _lists(p)
    p = p[p["group"][begin] != p["group"][end - 1]]
    if not len(p):
        return
    new = np.ones(len(p), bool)
    new[1:] = p["t"][1:] != p["t"][:-1]
    at, token = np.flatnonzero(new), np.cumsum(new) - 1
    n, room = p["n"].astype(np.int64), p["n"].astype(np.int64) - p["at"]
    least, most, reach = np.minimum.reduceat(n, at)[token], np.maximum.reduceat(n, at)[token], np.maximum.reduceat(room, at)[token]
    yield _counted(p["id"], np.zeros(len(p), np.int64), np.minimum(room, reach), least, most, ("q", "g"))


def _matrix_work(p: np.ndarray):
    """Documents with each later group in their tokens' lists: (document, group, how many tokens)."""
    p, begin, end = _lists(p)
    keep = p["group"][begin] != p["group"][end - 1]
    p = p[keep]
    if not len(p):
        return
    head = np.ones(len(p), bool)  # the first posting of a (token, group)
    head[1:] = (p["t"][1:] != p["t"][:-1]) | (p["group"][1:] != p["group"][:-1])
    heads = np.flatnonzero(head)
    token_end = np.searchsorted(p["t"][heads], p["t"], side="right")  # in heads
    own = np.cumsum(head) - 1
    later = token_end - own - 1
    n, room = p["n"].astype(np.int64), p["n"].astype(np.int64) - p["at"]
    least, most, reach = (np.minimum.reduceat(n, heads), np.maximum.reduceat(n, heads), np.maximum.reduceat(room, heads))
    for lo, hi in _ranges(later, 4_000_000):
        count = later[lo:hi]
        query = np.repeat(np.arange(lo, hi), count)
        target = np.repeat(own[lo:hi] + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield _counted(p["id"][query], p["group"][heads[target]], np.minimum(room[query], reach[target]), least[target], most[target], ("q", "g"))


def _ranges(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    total, out, lo = np.cumsum(sizes), [], 0
    while lo < len(sizes):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def _verify_task(size: int, num: int, den: int):
    """Rows sorted by (a, salt, lead desc): each text against its group's lead."""

    def run(batches: Iterator):
        import pyarrow as pa

        lead, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: tuple[list, list] = ([], [])
            sets = shingle_sets(as_bytes(batch.column(3)), size)
            for a, salt, doc, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                if (a, salt) != lead:
                    lead, own = (a, salt), tokens
                    continue
                low, high = sorted((len(own), len(tokens)))
                if den * low < num * high:
                    continue
                at = np.searchsorted(own, tokens)
                at[at == len(own)] = 0
                both = int(np.count_nonzero(own[at] == tokens)) if len(own) else 0
                if den * both >= num * (low + high - both):
                    out[0].append(a)
                    out[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def verify(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``, on whole sets. Ids with many partners are split over salts."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    salted = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / 128)).alias("salt"), "b")
    asked = salted.select("a", "salt", F.col("b").alias("doc"), F.lit(1).alias("follows"))
    asked = asked.unionByName(salted.select("a", "salt", F.col("a").alias("doc"), F.lit(0).alias("follows")).distinct())
    # by a sort-merge join at every size, so that the plan of a small run is that of a large one
    texts = asked.join(docs.select(F.col("doc_id").alias("doc"), "text").hint("merge"), "doc")
    dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "follows")
    return dealt.select("a", "salt", "doc", "text").mapInArrow(tidy(_verify_task(size, num, den)), "a long, b long")


def ngram_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row; n_links: proven links of its node that the join kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return _components(docs, size, num, den, rounds)
    known = row_ids(docs.where(F.col("doc_id").isNotNull()))
    known = Scratch(docs.sparkSession, "repeats").save(known, "rows")
    found = _components(known.select(F.col(ROW).alias("doc_id"), "text"), size, num, den, rounds)
    named = known.select("doc_id", F.col(ROW).alias("r")).join(found.withColumnRenamed("doc_id", "r"), "r")
    least = named.groupBy(F.col("component_id").alias("c")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, F.col("component_id") == F.col("c")).select("doc_id", "n_shingles", F.col("least").alias("component_id"), "n_links")
    nameless = _components(docs.where(F.col("doc_id").isNull()), size, num, den, 0)
    return out.unionByName(nameless)


def _components(docs: DataFrame, size: int, num: int, den: int, rounds: int) -> DataFrame:
    """The same where no id comes twice."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + int(total // BUCKET_BYTES)
    bits = int(min(26, max(16, np.ceil(np.log2(1 + total / 48)))))  # about eight tokens a counter, up to 2**26 counters
    heavy = spark.sparkContext.broadcast(heavy_tokens(named, size, bits, limit=24 + 2 * int(total / 6 / (1 << bits))))
    sets = scratch.save(named.mapInArrow(tidy(_sets_task(size, num, den, heavy, bits)), "doc_id long, n long, s1 long, s2 long, prefix binary"), "sets")
    nodes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    nodes = scratch.save(nodes, "nodes")
    bare = nodes.select("id", "n")
    texts = named.where(F.col("doc_id").isNotNull())

    def postings(groups: DataFrame | None, work, nodes: DataFrame = nodes):
        rows = nodes.select("id", "n", "prefix", F.col("id").alias("group")) if groups is None else nodes.join(groups, "id", "left").select("id", "n", "prefix", F.coalesce("component", "id").alias("group"))
        dealt = rows.mapInArrow(tidy(_postings_task(buckets)), "bucket int, body binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        rows = dealt.mapInArrow(tidy(lambda batches: _buckets(batches, work)), "q long, g long, shared long, bound long, least long, most long")
        sums = rows.groupBy("q", "g").agg(F.sum("shared").alias("shared"), F.max("bound").alias("bound"), F.min("least").alias("least"), F.max("most").alias("most"))
        return sums.join(bare.select(F.col("id").alias("q"), F.col("n").alias("q_n")), "q").where(may_link(F.col("q_n"), num, den))

    links, groups = None, None
    for turn in range(rounds):
        best = Window.partitionBy("q").orderBy(F.desc("shared"), "g")
        stars = postings(groups, _star_work(turn)).withColumn("r", F.row_number().over(best)).where("r <= 2")
        tried = scratch.save(stars.select(F.col("g").alias("a"), F.col("q").alias("b")), f"tried{turn}")
        scratch.release()
        proven = scratch.save(verify(texts, tried, size, num, den), f"proven{turn}")
        scratch.release()
        new = proven.count()
        links = proven if links is None else links.unionByName(proven)
        if new:
            groups = components(links, scratch, f"groups{turn}_")
        few = new * 20 < tried.count()
        scratch.drop(f"tried{turn}")
        if few:
            break
    # a document whose own tokens are too rarely shared can link with nothing outside its group
    live = scratch.save(postings(groups, _live_work).select(F.col("q").alias("id")), "live")
    scratch.release()
    opened = scratch.save(postings(groups, _matrix_work, nodes.join(live, "id", "left_semi")).select("q", "g", "q_n"), "opened")
    scratch.release()
    members = bare.select("id", "n", F.col("id").alias("group")) if groups is None else bare.join(groups, "id", "left").select("id", "n", F.coalesce("component", "id").alias("group"))
    fits = F.col("n").between(F.ceil(F.col("q_n") * num / den), F.floor(F.col("q_n") * den / num))
    pairs = scratch.save(opened.join(members, opened["g"] == members["group"]).where(fits).select(F.col("q").alias("a"), F.col("id").alias("b")), "pairs")
    across = scratch.save(verify(texts, pairs, size, num, den), "across")
    scratch.drop("live", "opened", "pairs")
    scratch.release()
    links = across if links is None else links.unionByName(across)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    final = components(links, scratch, "final")
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    labels = bare.join(final, "id", "left").join(degree, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = nodes.join(labels, "id").select("s1", "s2", F.col("n").alias("m"), "component", "n_links")
    rows = sets.select("doc_id", "n", "s1", "s2")
    joined = rows.join(known, (rows["s1"] == known["s1"]) & (rows["s2"] == known["s2"]) & (rows["n"] == known["m"]) & rows["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
