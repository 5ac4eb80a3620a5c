"""Recursive listings of folder trees, a level at a time, by tasks.

The folders of a level are a table; tasks list them and hand on their entries in pages, files and folders apart. The
folders found are the next level. The driver sees neither names nor counts, only whether there is a next level; a folder
of any size is read as a stream of pages by one task. Paths are those that pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.sources.written import fresh_path

PAGE = 1000  # entries of one page
ENTRY = "path string, parts array<string>, is_folder boolean, length long, modified timestamp"
_TYPE = pa.schema([("path", pa.string()), ("parts", pa.list_(pa.string())), ("is_folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, datetime | None]]:
    """(name, is a folder, length, time of change) of what is in a folder, without links to folders."""
    if folder.startswith(("file:", "/")):
        with os.scandir(folder.removeprefix("file://").removeprefix("file:")) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, None, None
                elif e.is_file():
                    s = e.stat()
                    yield e.name, False, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    for e in system.get_file_info(fs.FileSelector(path)):
        yield e.base_name, e.type == fs.FileType.Directory, e.size, e.mtime


def _list(batches):
    def page(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TYPE)], schema=_TYPE)

    for batch in batches:
        rows = []
        for folder, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for name, is_folder, length, modified in _entries(folder):
                rows.append((f"{folder}/{name}", [*parts, name], is_folder, length, modified))
                if len(rows) == PAGE:
                    yield page(rows)
                    rows = []
        yield page(rows)


def list_tree(spark: SparkSession, root: str, most_levels: int | None = None) -> DataFrame:
    """All files below ``root``: path, their path parts below it, length and time of change; down to ``most_levels``."""
    base, level = fresh_path(spark, "listing"), 0
    folders = spark.createDataFrame([(root.rstrip("/"), [])], "path string, parts array<string>")
    while most_levels is None or level < most_levels:
        tasks = 2 * spark.sparkContext.defaultParallelism if level else 1
        folders.repartition(tasks).mapInArrow(_list, ENTRY).write.parquet(f"{base}/level={level}")
        folders = spark.read.schema(ENTRY).parquet(f"{base}/level={level}").where("is_folder").select("path", "parts")
        level += 1
        if not folders.limit(1).count():
            break
    if not level:
        return spark.createDataFrame([], ENTRY).drop("is_folder")
    return spark.read.schema(ENTRY).parquet(*[f"{base}/level={k}" for k in range(level)]).where("NOT is_folder").select("path", "parts", "length", "modified")
