"""Synchronised anchors: the frame that both dedup operators on repeated passages stand on.

Every window of ``length`` symbols (bytes or words) picks an anchor: the place of its smallest hashed ``gram``, the
leftmost of equal ones. Equal windows pick the same place, so all windows that could be equal meet at the anchor's
hash, and only one anchor for some thirty windows is shuffled. The windows of a document that share an anchor are a
run of consecutive starts; the symbols that they span are the anchor's context.

1. ``scan``: anchors with the hash of their gram and of their context. Anchors with equal contexts are one class. Of
   its members in a task only the first and the last are shuffled, so copies cost two entries for each task at most.
2. ``meet``: by gram hash. A class with several members needs the contexts of its first and its last; a gram with several
   classes needs those of each, as their windows may be equal in part.
3. ``gather``: those contexts are cut from the texts and dealt to shards by gram hash, where an index over them (the
   operator's own: suffix sorting, or an FM-index) finds the windows that occur again.
4. The index decides each class: it has to find all windows of the last member in the first. What lies between the two
   follows them. Should it refute a class (unequal contexts of equal hash), all starts over with other hashes.
5. ``spans_by_doc``: the marked stretches of each document.

Anchors travel in binary batches of columns, dealt by a bucket of the gram hash, so that Spark moves few large rows.
A document is known by (doc_id, hash of its text): rows that repeat both are one document and get equal results. A
null doc_id counts as the smallest.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import Scratch, as_bytes, free, mix64, powers, tidy

NULL_ID = -(1 << 63)
POSITION_BITS = 22
BUFFER = 1 << 21  # symbols worked on at once; longer texts go in overlapping pieces
FLUSH = 600_000  # anchors that a task gathers before it passes them on
BUCKET_BYTES = 8 << 20  # text for each shuffle bucket

#: fields of an anchor in a batch: name, type
FIELDS = (("h", "<u8"), ("ctx", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("back", "u1"), ("front", "u1"))


class Finder:
    """Finds the anchors of joined pieces. ``length``: symbols of a window; ``gram``: symbols of an anchor's gram."""

    def __init__(self, length: int, gram: int, seed: int = 0, buffer: int = BUFFER):
        self.length, self.gram, self.span, self.seed = length, gram, length - gram + 1, np.uint64(seed)
        self.up, self.down = powers(buffer + 4 * length + 1)

    def find(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """``symbols``: 64-bit hashes of all symbols; pieces at ``begins`` with ``sizes``. One row for each run."""
        n, w = len(symbols), self.length
        starts = n - w + 1
        if starts <= 0:
            return {k: np.zeros(0, np.int64) for k in ("h", "ctx", "piece", "at", "low", "high")}
        if self.seed:
            symbols = mix64(symbols ^ self.seed)
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(symbols * self.up[:n], out=prefix[1:])
            grams = mix64((prefix[self.gram :] - prefix[: n - self.gram + 1]) * self.down[: n - self.gram + 1])
        mask = np.uint64((1 << POSITION_BITS) - 1)
        keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        smallest = self._sliding_min(keys)[:starts]
        anchor = (smallest & mask).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        whole = sizes >= w
        np.add.at(inside, begins[whole], 1)
        np.add.at(inside, begins[whole] + sizes[whole] - w + 1, -1)
        valid = np.cumsum(inside[:starts]) > 0
        fresh = np.ones(starts, bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        fresh[begins[begins < starts]] = True
        first = np.flatnonzero(valid & fresh)
        last = np.ones(starts, bool)
        last[:-1] = fresh[1:] | ~valid[1:]
        high = np.flatnonzero(valid & last)
        at = anchor[first]
        with np.errstate(over="ignore"):
            ctx = (prefix[high + w] - prefix[first]) * self.down[first]
            ctx = mix64(mix64(ctx) + ((at - first) * 512 + (high - first)).astype(np.uint64))
        piece = np.searchsorted(begins, first, side="right") - 1
        return {"h": grams[at], "ctx": ctx, "piece": piece, "at": at, "low": first, "high": high}

    def _sliding_min(self, keys: np.ndarray) -> np.ndarray:
        s = self.span
        pad = -len(keys) % s
        block = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, s)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        out = behind.copy()
        np.minimum(out[: len(out) - s + 1], ahead[s - 1 :], out=out[: len(out) - s + 1])
        return out


@dataclass
class Plan:
    """What an operator gives the frame. ``symbols`` turns a text into 64-bit symbol hashes."""

    length: int
    gram: int
    keep_first: bool  # the first occurrence of a repeated window stays
    symbols: Callable[[], Callable[[bytes], np.ndarray]]
    index: Callable[[dict, int], np.ndarray]  # contexts of a shard -> (context, start) of windows to mark
    buffer: int = BUFFER
    flush: int = FLUSH


def pack(columns: dict[str, np.ndarray], docs: list[tuple[int, int]]) -> bytes:
    import zstandard

    ids = np.array(docs, dtype="<i8").reshape(-1, 2)
    body = b"".join([ids.tobytes(), *(columns[name].astype(kind).tobytes() for name, kind in FIELDS)])
    small = len(body) < 512
    return struct.pack("<IIB", len(ids), len(columns["h"]), small) + (body if small else zstandard.compress(body, 1))


def unpack(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    import zstandard

    n_docs, n, small = struct.unpack_from("<IIB", data)
    body = data[9:] if small else zstandard.decompress(data[9:])
    ids = np.frombuffer(body, "<i8", 2 * n_docs).reshape(-1, 2)
    out, offset = {}, 16 * n_docs
    for name, kind in FIELDS:
        out[name] = np.frombuffer(body, kind, n, offset)
        offset += n * np.dtype(kind).itemsize
    return out, ids


def _classes(c: dict[str, np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (h, ctx, order), repeated entries once: the sorted places, and whether each opens a class."""
    place = np.lexsort((order, c["ctx"], c["h"]))
    h, x, o = c["h"][place], c["ctx"][place], order[place]
    opens = np.ones(len(place), bool)
    opens[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    new = opens.copy()
    new[1:] |= o[1:] != o[:-1]
    return place[new], opens[new]


def _ends(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sorted places are the first or the last of their class, and whether the class has several members."""
    last = np.append(opens[1:], True)[: len(opens)]
    return opens | last, ~(opens & last)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of a document become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = np.int64(1) << 33
    reach = np.maximum.accumulate(end.astype(np.int64) + doc.astype(np.int64) * wide)
    opens = np.ones(len(doc), bool)
    opens[1:] = start[1:].astype(np.int64) + doc[1:].astype(np.int64) * wide > reach[:-1]
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach[last] - doc[at].astype(np.int64) * wide)


def _by_doc(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(document, its slice of each column); ``doc`` is sorted."""
    if len(doc):
        edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(doc[lo]), *(c[lo:hi] for c in columns)


ROWS = "bucket int, doc_id long, key long, spans binary, body binary"


def _batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "doc_id", "key", "spans", "body"])


def _scan_task(plan: Plan, buckets: int, seed: int):
    def run(batches: Iterator):
        finder, to_symbols = Finder(plan.length, plan.gram, seed, plan.buffer), plan.symbols()
        docs: list[tuple[int, int]] = []  # (doc_id, key) of the documents since the last flush
        found: list[dict[str, np.ndarray]] = []
        pieces: list[tuple[int, int, np.ndarray]] = []  # document, offset, symbols
        held = total = 0

        def work() -> None:
            nonlocal held, total
            if not pieces:
                return
            sizes = np.array([len(p[2]) for p in pieces])
            begins = np.cumsum(sizes) - sizes
            r = finder.find(np.concatenate([p[2] for p in pieces]), begins, sizes)
            doc, shift = np.array([p[0] for p in pieces])[r["piece"]], np.array([p[1] for p in pieces])[r["piece"]] - begins[r["piece"]]
            found.append({"h": r["h"], "ctx": r["ctx"], "doc": doc.astype(np.uint32), "at": (r["at"] + shift).astype(np.uint32), "back": (r["at"] - r["low"]).astype(np.uint8), "front": (r["at"] - r["high"]).astype(np.uint8)})
            total += len(r["h"])
            pieces.clear()
            held = 0

        def flush() -> list[tuple]:
            nonlocal total
            rows: list[tuple] = []
            if total:
                c = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
                ids, number = np.unique(np.array(docs, dtype=np.int64).reshape(-1, 2), axis=0, return_inverse=True)
                c["doc"] = number.ravel()[c["doc"]]
                place, opens = _classes(c, (c["doc"] << 32) + c["at"])
                ends, _ = _ends(opens)
                kept = place[ends]
                rows += _span_rows(c, ids, place[~ends], plan.length)
                bucket = (c["h"][kept] >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                for b, mine in _by_doc(bucket[order], kept[order]):
                    used, doc = np.unique(c["doc"][mine], return_inverse=True)
                    part = {k: v[mine] for k, v in c.items()} | {"doc": doc}
                    rows.append((b, None, None, None, pack(part, ids[used].tolist())))
            found.clear(), docs.clear()
            total = 0
            return rows

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                symbols = to_symbols(text) if text else ()
                if len(symbols) < plan.length:
                    continue
                docs.append((NULL_ID if doc_id is None else doc_id, key))
                step = plan.buffer - plan.length + 1
                for lo in range(0, len(symbols) - plan.length + 1, step):
                    piece = symbols[lo : lo + plan.buffer]
                    if held + len(piece) > plan.buffer:
                        work()
                    pieces.append((len(docs) - 1, lo, piece))
                    held += len(piece)
                if total > plan.flush:
                    work()
                    yield _batch(flush())
        work()
        yield _batch(flush())

    return run


def _span_rows(c: dict[str, np.ndarray], ids: np.ndarray, places: np.ndarray, length: int) -> list[tuple]:
    """The stretches of all windows of the anchors at ``places``, a row for each document."""
    start = c["at"][places].astype(np.int64) - c["back"][places]
    end = c["at"][places].astype(np.int64) - c["front"][places] + length
    doc, start, end = merged(c["doc"][places].astype(np.int64), start, end)
    return [(d % 1024, int(ids[d, 0]), int(ids[d, 1]), np.stack([s, e], axis=1).astype("<u4").tobytes(), None) for d, s, e in _by_doc(doc, start, end)]


NEED = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("at", "<u4"), ("back", "u1"), ("front", "u1"), ("pair", "u1")])


def _joined(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Batches of anchors as one, their documents numbered in the order of (doc_id, key)."""
    parts = [unpack(b) for b in blobs]
    ids = np.concatenate([i for _, i in parts])
    known, number = np.unique(ids, axis=0, return_inverse=True)
    number, shift, columns = number.ravel(), 0, {k: np.concatenate([p[k] for p, _ in parts]) for k, _ in FIELDS}
    doc = []
    for p, i in parts:
        doc.append(number[shift + p["doc"].astype(np.int64)])
        shift += len(i)
    columns["doc"] = np.concatenate(doc)
    return columns, known


def _meet_bucket(plan: Plan, blobs: list[bytes]) -> list[tuple]:
    c, ids = _joined(blobs)
    place, opens = _classes(c, (c["doc"].astype(np.int64) << 32) + c["at"])
    ends, several = _ends(opens)
    rows = _span_rows(c, ids, place[~ends], plan.length)
    h, heads = c["h"][place], np.flatnonzero(opens)
    rivals = np.zeros(len(heads), bool)
    rivals[1:] |= h[heads[1:]] == h[heads[:-1]]
    rivals[:-1] |= h[heads[1:]] == h[heads[:-1]]
    asked = ends & (several | rivals[np.cumsum(opens) - 1])
    chosen, pair = place[asked], several[asked]
    order = np.argsort(c["doc"][chosen], kind="stable")
    chosen = chosen[order]
    need = np.empty(len(chosen), NEED)
    for k in ("h", "ctx", "at", "back", "front"):
        need[k] = c[k][chosen]
    need["pair"] = pair[order]
    for d, part in _by_doc(c["doc"][chosen], need):
        rows.append((0, int(ids[d, 0]), int(ids[d, 1]), None, part.tobytes()))
    return rows


def _grouped(batches: Iterator, work: Callable[[list[bytes]], list[tuple]]) -> Iterator:
    """Rows come sorted by bucket: ``work`` gets all bodies of one; rows with stretches pass through."""
    bucket, bodies = None, []
    for batch in batches:
        rows = batch.to_pylist()
        through = [(r["bucket"], r["doc_id"], r["key"], r["spans"], None) for r in rows if r["spans"] is not None]
        if through:
            yield _batch(through)
        for r in rows:
            if r["body"] is None:
                continue
            if bodies and r["bucket"] != bucket:
                yield _batch(work(bodies))
                bodies = []
            bucket = r["bucket"]
            bodies.append(r["body"])
    if bodies:
        yield _batch(work(bodies))


def _gather_task(plan: Plan, buckets: int):
    """Cuts the needed contexts from the texts; in: doc_id, key, text, needs."""

    def run(batches: Iterator):
        to_symbols = plan.symbols()
        held: dict[int, list] = {}
        size = 0

        def flush() -> list[tuple]:
            nonlocal size
            rows = [(b, None, None, None, _pack_contexts(parts)) for b, parts in held.items()]
            held.clear()
            size = 0
            return rows

        for batch in batches:
            for doc_id, key, text, needs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                need = np.frombuffer(b"".join(needs), NEED)
                symbols = to_symbols(text)
                low = need["at"].astype(np.int64) - need["back"]
                high = need["at"].astype(np.int64) - need["front"] + plan.length
                bucket = (need["h"] >> np.uint64(20)) % np.uint64(buckets)
                for b, n, lo, hi in zip(bucket.tolist(), need, low.tolist(), high.tolist(), strict=True):
                    held.setdefault(b, []).append((NULL_ID if doc_id is None else doc_id, key, n, symbols[lo:hi]))
                    size += hi - lo
                if size > 1 << 21:
                    yield _batch(flush())
        yield _batch(flush())

    return run


def _pack_contexts(parts: list) -> bytes:
    """Documents, needs and symbols; the symbols as numbers into a list of the distinct ones."""
    import zstandard

    ids = np.array([(p[0], p[1]) for p in parts], dtype="<i8")
    needs = np.array([p[2] for p in parts], dtype=NEED)
    values, codes = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
    body = ids.tobytes() + needs.tobytes() + values.astype("<u8").tobytes() + codes.astype("<u4").tobytes()
    return struct.pack("<III", len(parts), len(values), len(codes)) + zstandard.compress(body, 1)


def _unpack_contexts(blobs: list[bytes]) -> dict:
    """ids, needs and the joined symbols (numbered over all blobs in the order of their hashes) with their begins."""
    import zstandard

    ids, needs, symbols = [], [], []
    for data in blobs:
        n, v, m = struct.unpack_from("<III", data)
        body = zstandard.decompress(data[12:])
        at = 16 * n + NEED.itemsize * n
        ids.append(np.frombuffer(body, "<i8", 2 * n).reshape(-1, 2))
        needs.append(np.frombuffer(body, NEED, n, 16 * n))
        symbols.append(np.frombuffer(body, "<u8", v, at)[np.frombuffer(body, "<u4", m, at + 8 * v)])
    need = np.concatenate(needs)
    return {"ids": np.concatenate(ids), "need": need, "symbols": np.concatenate(symbols)}


def _index_bucket(plan: Plan, blobs: list[bytes]) -> list[tuple]:
    c = _unpack_contexts(blobs)
    need, ids = c["need"], c["ids"]
    sizes = need["back"].astype(np.int64) - need["front"] + plan.length
    begins = np.cumsum(sizes) - sizes
    # a run that the edge of a piece divides has one anchor and several contexts
    columns = (need["front"], need["back"], need["at"], ids[:, 1], ids[:, 0])
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in columns], axis=0)
    order = order[new]
    symbols = np.concatenate([c["symbols"][begins[i] : begins[i] + sizes[i]] for i in order.tolist()])
    need, ids, sizes = need[order], ids[order], sizes[order]
    pairs = _pairs(need)
    if pairs is None:
        return [(REFUTED, None, None, None, b"")]
    first = np.full(len(need), -1)
    first[pairs[1]] = pairs[0]  # of a class's last member
    contexts = {"symbols": symbols, "begins": np.cumsum(sizes) - sizes, "sizes": sizes, "h": need["h"], "back": need["back"].astype(np.int64), "front": need["front"].astype(np.int64), "first": first}
    which, offset = plan.index(contexts, plan.length)
    if _refuted(plan, need, pairs, np.bincount(which, minlength=len(need))):
        return [(REFUTED, None, None, None, b"")]
    if not len(which):
        return []
    known, doc = np.unique(ids, axis=0, return_inverse=True)
    start = need["at"].astype(np.int64)[which] - contexts["back"][which] + offset
    doc, start, end = merged(doc.ravel()[which], start, start + plan.length)
    return [(0, int(known[d, 0]), int(known[d, 1]), np.stack([s, e], axis=1).astype("<u4").tobytes(), None) for d, s, e in _by_doc(doc, start, end)]


REFUTED = -1


def _pairs(need: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first and the last members of classes; None if they don't come in pairs of equal width."""
    pairs = np.flatnonzero(need["pair"])
    pairs = pairs[np.lexsort((pairs, need["ctx"][pairs], need["h"][pairs]))]
    first, last = pairs[::2], pairs[1::2]
    if len(first) != len(last) or any((need[k][first] != need[k][last]).any() for k in ("h", "ctx", "back", "front")):
        return None
    return first, last


def _refuted(plan: Plan, need: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], hits: np.ndarray) -> bool:
    """Whether the index does not bear out a class: not all windows of its last member (or of both) were found again."""
    whole = hits == need["back"].astype(np.int64) - need["front"] + 1
    return not (whole[pairs[1]].all() and (plan.keep_first or whole[pairs[0]].all()))


def spans_by_doc(docs: DataFrame, plan: Plan, scratch: Scratch, seed: int = 0) -> DataFrame:
    """(doc_id, key, spans): the marked stretches of each document that has any, as pairs of 32-bit symbol places."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text").where(F.col("text").isNotNull())
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + int(total // BUCKET_BYTES)
    scanned = named.mapInArrow(tidy(_scan_task(plan, buckets, seed)), ROWS)
    met = scanned.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(lambda batches: _grouped(batches, lambda blobs: _meet_bucket(plan, blobs))), ROWS)
    met = scratch.save(met, f"met{seed}")
    scratch.release()
    needs = met.where(F.col("body").isNotNull()).groupBy("doc_id", "key").agg(F.collect_list("body").alias("needs"))
    wanted = named.join(needs, ["doc_id", "key"])
    contexts = wanted.select("doc_id", "key", "text", "needs").mapInArrow(tidy(_gather_task(plan, buckets)), ROWS)
    indexed = contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(lambda batches: _grouped(batches, lambda blobs: _index_bucket(plan, blobs))), ROWS)
    indexed = scratch.save(indexed, f"indexed{seed}")
    scratch.release()
    if indexed.where(F.col("bucket") == REFUTED).limit(1).count():
        scratch.drop(f"met{seed}", f"indexed{seed}")
        return spans_by_doc(docs, plan, scratch, seed + 1)
    marked = met.where(F.col("spans").isNotNull()).unionByName(indexed.where(F.col("spans").isNotNull()))
    return marked.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))


def with_spans(docs: DataFrame, plan: Plan, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with a column of binary stretches (null where there are none), and that column's name."""
    d, k, name = (free(n, docs.columns) for n in ("_doc", "_key", "_spans"))
    spans = spans_by_doc(docs, plan, scratch).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(name))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(k))
    return docs.join(spans, same, "left").drop(d, k), name


def merge_spans(spans: list[bytes] | None) -> np.ndarray:
    """Pairs of places of the merged stretches of one document."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    _, start, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return np.stack([start, end], axis=1)
