"""Token-ID output: id blocks transposed into byte or bit planes, each plane compressed on its own.

A written set is a folder with three Parquet tables:

``chunks``  one row for each chunk: ``part`` (range of doc_ids), ``chunk`` (number within it), ``first`` (ids of the
            part before it), ``n_ids``, ``block`` (ids in a block), ``planes`` (the compressed planes, one after the
            other, block by block), ``plane_bytes`` (their lengths), ``crc32`` of the raw ids, and for its documents
            ``doc_ids`` and ``doc_lengths``. A chunk holds whole documents, so that each one can be decoded alone.
``parts``   one row for each part: ``part``, ``part_start`` (ids of the whole set before it).
``index``   one row for each chunk: ``part``, ``chunk``, ``start`` (ids of the whole set before it), ``n_ids``,
            ``n_docs``, ``min_doc_id``, ``max_doc_id``, ``n_bytes``.

Spark's own Parquet writer commits the files, so that lost executors and repeated tasks leave no torn output.

Null text counts as empty: the document holds the end id alone. Documents are in ascending ``doc_id`` order, null ids
first; rows that repeat an id follow each other in the order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwright.llm.common import BROADCAST_LIMIT, Scratch, tidy

END_ID = 2
BLOCK = 4096
CHUNK_IDS = 1 << 17
CHUNK_SCHEMA = (
    "part int, chunk int, first long, n_ids long, block int, kind string, planes binary, plane_bytes array<int>, "
    "crc32 long, doc_ids array<long>, doc_lengths array<long>"
)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A-Z in lower case; other bytes as they are
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: small letters of Latin-1, in UTF-8: single, lower-case, composed
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: fixed values: a normaliser and a pre-tokenizer under which words can be encoded one by one
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: how the byte level writes bytes that are no printed character of their own
_PLAIN = {**{b: b + 0xA2 for b in range(0x80, 0xA1)}, 0xAD: 0x143}


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes, for a bounded number of words.

    When they are ``LIMIT`` or ``BYTES``, they become the older ones, of which those that come again stay.

    By its definition ``WORDWISE``, white space is cut before anything else, so a text's ids are those of its words in
    turn. Letters and the marks after them are separate pieces, as none of the patterns goes on from a letter to a mark
    (the one of marks holds no letter, and those with an apostrophe begin with it). A word of ``LETTERS`` alone is one
    piece that the normaliser leaves as it is, so it goes to the library's model at once. Case is folded first: that
    may only meet the normaliser's composing where marks of U+0300 to U+036F stand, and texts with these, as texts that
    hold an added token in any case (it is matched in the raw text, in its own case), are encoded whole. So is
    everything by files of another definition.
    """

    LIMIT = 200_000
    BYTES = 16_000_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.held = Tokenizer.from_file(path), 0
        self.older: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            defined = json.load(file)
        self.by_word = all(defined.get(k) == v for k, v in WORDWISE.items()) and defined["model"]["type"] == "BPE"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.encode().translate(LOWER) for token in added if token.content] + [b"\xcc", b"\xcd"]
        self.piece = self.tokenizer.model.tokenize

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        if not word.isalpha():
            stem = word.rstrip(MARKS)
            if len(stem) < len(word) and (stem.isalpha() or LETTERS.fullmatch(stem)):
                return self[stem] + self[word[len(stem) :]]
            if not LETTERS.fullmatch(word):
                return self._ids(word.decode("utf-8", "replace"))
        text = word.decode("latin-1")
        ids = [t.id for t in self.piece(text if word.isascii() else text.translate(_PLAIN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        value = self.older.pop(word, None)
        if value is None:
            value = self._new(word)
        if len(self) >= self.LIMIT or self.held > self.BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[word] = value
        self.held += len(word) + len(value)
        return value

    def encode(self, text: bytes) -> bytes:
        if self.by_word:
            lower = text.translate(LOWER)
            if not any(content in lower for content in self.added):
                return b"".join(map(self.__getitem__, lower.split()))
        return self._ids(text.decode("utf-8", "replace"))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """Kept by a Python worker from task to task, within the bounds of ``WordIds``."""
    return WordIds(path)


def to_planes(ids: np.ndarray, block: int, kind: str, level: int = 3) -> tuple[bytes, list[int]]:
    """Each block of ids as 4 byte planes or 32 bit planes, each compressed with zstandard."""
    import zstandard

    press, parts = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), block):
        planes = ids[at : at + block].astype("<u4").view(np.uint8).reshape(-1, 4).T
        if kind == "bit":
            planes = np.concatenate([np.packbits((plane[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) for plane in planes])
        parts += [press.compress(np.ascontiguousarray(plane)) for plane in planes]
    return b"".join(parts), [len(x) for x in parts]


def from_planes(data: bytes, lengths: list[int], n: int, block: int, kind: str) -> np.ndarray:
    import zstandard

    press, out, per, offset = zstandard.ZstdDecompressor(), np.empty(n, dtype="<u4"), 32 if kind == "bit" else 4, 0
    for b, at in enumerate(range(0, n, block)):
        size, planes = min(block, n - at), []
        for length in lengths[b * per : (b + 1) * per]:
            planes.append(np.frombuffer(press.decompress(data[offset : offset + length]), dtype=np.uint8))
            offset += length
        if kind == "bit":
            bits = [np.unpackbits(p, count=size) for p in planes]
            planes = [sum((bits[8 * k + j] << np.uint8(j) for j in range(8)), np.zeros(size, np.uint8)).astype(np.uint8) for k in range(4)]
        out[at : at + size] = np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
    return out


def _write_task(path: str, end_id: int, block: int, chunk_ids: int, kind: str):
    def run(batches: Iterator):
        import pyarrow as pa

        from markwright.llm.common import as_bytes

        words, end = _word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def row():
            raw = b"".join(ids)
            array = np.frombuffer(raw, dtype="<u4")
            data, sizes = to_planes(array, block, kind)
            return {
                "part": part, "chunk": chunk, "first": first, "n_ids": len(array), "block": block, "kind": kind, "planes": data,
                "plane_bytes": sizes, "crc32": zlib.crc32(raw), "doc_ids": list(doc_ids), "doc_lengths": list(lengths),
            }

        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block", pa.int32()), ("kind", pa.string()), ("planes", pa.binary()), ("plane_bytes", pa.list_(pa.int32())), ("crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                raw = words.encode(text or b"") + end
                ids.append(raw)
                doc_ids.append(doc_id)
                lengths.append(len(raw) // 4)
                held += lengths[-1]
                if held >= chunk_ids:
                    yield pa.RecordBatch.from_pylist([row()], schema=schema)
                    first, chunk, held = first + held, chunk + 1, 0
                    ids.clear(), doc_ids.clear(), lengths.clear()
        if doc_ids:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, chunk_ids: int = CHUNK_IDS, kind: str = "byte") -> None:
    """Encodes ``docs(doc_id, text)`` and writes the set to ``path``. ``tokenizer``: a file of the tokenizers library."""
    if kind not in ("byte", "bit"):
        raise ValueError(f"kind is 'byte' or 'bit', not {kind!r}")
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    chunks = ordered.mapInArrow(tidy(_write_task(tokenizer, end_id, block, chunk_ids, kind)), CHUNK_SCHEMA)
    chunks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    _part_starts(chunks).write.mode("overwrite").parquet(f"{path}/parts")
    index = _with_start(spark, path, chunks).select(
        "part", "chunk", (F.col("part_start") + F.col("first")).alias("start"), "n_ids", F.size("doc_ids").alias("n_docs"),
        F.array_min("doc_ids").alias("min_doc_id"), F.array_max("doc_ids").alias("max_doc_id"), F.length("planes").alias("n_bytes"),
    )
    index.write.mode("overwrite").parquet(f"{path}/index")


def _with_start(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Chunks with ``part_start``. The parts go to all tasks if they are few enough, and else by an ordinary join."""
    parts = spark.read.parquet(f"{path}/parts")
    return chunks.join(F.broadcast(parts) if parts.count() * 32 < BROADCAST_LIMIT else parts, "part")


def _part_starts(chunks: DataFrame) -> DataFrame:
    """One row for each part, of which there are as many as the writing job had partitions."""
    sums = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_start"))


def _read_task(with_ids: bool):
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                ids = from_planes(r["planes"], r["plane_bytes"], r["n_ids"], r["block"], r["kind"])
                raw, at = memoryview(ids.tobytes()), 0
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"chunk {r['chunk']} of part {r['part']} is damaged")
                for doc_id, n in zip(r["doc_ids"], r["doc_lengths"], strict=True):
                    out["doc_id"].append(doc_id)
                    out["start"].append(r["start"] + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    if with_ids:
                        out["ids"].append(ids[at : at + n].astype(np.int64).tolist())
                    at += n
            types = {"ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in out.items()], names=names)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the set: doc_id, start, n_tokens, ids_crc32, and on request its ids."""
    chunks = _with_start(spark, path, spark.read.parquet(f"{path}/chunks"))
    columns = chunks.select("part", "chunk", (F.col("part_start") + F.col("first")).alias("start"), "n_ids", "block", "kind", "planes", "plane_bytes", "crc32", "doc_ids", "doc_lengths")
    return columns.mapInArrow(tidy(_read_task(with_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    write_ids(docs, scratch.path("set"), tokenizer, **options)
    scratch.release()
    return read_ids(spark, scratch.path("set"))
