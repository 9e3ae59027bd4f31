"""Source-tree scan as a Spark job.

Spark's own file sources leave out names that start with `_` or `.`, which would lose every
`__init__.py`, so folders are listed through Arrow's file systems, inside the tasks:

* the tree is expanded level by level: each task lists its share of the current folders, once
  each, and writes what it found (files with their sizes, and the folders below) to the shared
  checkpoint folder; the folders below are the next level. The driver only counts them.
* the files found are then dealt to reading tasks: as many tasks as the bytes (TASK_BYTES a
  task) or the files (`per_task` a task) ask for, files spread over them by a hash of the path.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.operators.scale import durable

SCHEMA = "path STRING, content STRING, error STRING"
FOUND = "folder STRING, path STRING, is_dir BOOLEAN, size LONG"
BATCH_BYTES = 32 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _lister(root: str, glob: str, ignore: frozenset[str]):
    """Each folder of a batch listed once: its matching files and its folders, ignored names left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(root)
        for batch in batches:
            rows: dict[str, list] = {"folder": [], "path": [], "is_dir": [], "size": []}
            for folder in batch.column("folder").to_pylist():
                for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    if x.base_name in ignore:
                        continue
                    is_dir = x.type == fs.FileType.Directory
                    if is_dir or fnmatch.fnmatchcase(x.base_name, glob):
                        for key, value in (("folder", folder), ("path", x.path), ("is_dir", is_dir), ("size", x.size or 0)):
                            rows[key].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("folder", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64())]))
    return run


def _reader(root: str, base: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(root)
        rows: list[tuple[str, str | None, str | None]] = []
        size = 0
        for batch in batches:
            for path, bytes_ in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                rows.append((path[len(base.rstrip("/")) + 1:], *_text(system, path)))
                size += bytes_ or 0
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)
    return run


def _text(system: fs.FileSystem, path: str) -> tuple[str | None, str | None]:
    try:
        with system.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", errors="replace"), None
    except OSError as e:
        return None, str(e)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "content", "error"]
    columns = [pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3
    return pa.RecordBatch.from_arrays(columns, names=names)


def list_tree(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] | None = None,
              folders: int = 256) -> DataFrame:
    """(folder, path, is_dir, size) of everything below `root`, each folder listed by one task once.

    `folders` is how many folders of a level one task lists. Every level is written before the
    next one is listed, so a lost executor lists nothing twice into the result.
    """
    system, base = _open(root)
    found = spark.createDataFrame([], FOUND)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return found
    lister = _lister(root, glob, frozenset(ignore or []))
    frontier, count = spark.createDataFrame([(base,)], "folder STRING"), 1
    while count:
        level = durable(frontier.repartition(max(1, -(-count // max(1, folders)))).mapInArrow(lister, FOUND))
        found = found.unionByName(level.filter(~F.col("is_dir")))
        frontier = level.filter("is_dir").select(F.col("path").alias("folder"))
        count = frontier.count()
    return found


def read_source_tree(
    spark: SparkSession, root: str, glob: str = "*.py", subdir: str | None = "src",
    ignore: list[str] | None = None, project: str | None = None, folders: int = 256,
    shards: int = 8, per_task: int = 500,
) -> DataFrame:
    """`files(project, path, content, error)` of all matching files, hidden names included.

    Paths are relative to the root; a missing folder gives no rows. Names ignored below the
    scanned folder are pruned while listing, before anything is read. Bad bytes are replaced.
    At least `shards` tasks read the files when there are that many.
    """
    base = root.rstrip("/") + (f"/{subdir}" if subdir else "")
    names = v.IGNORED_SEGMENTS if ignore is None else ignore
    files = list_tree(spark, base, glob, list(names), folders)
    seen = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(int(seen["n"]), max(shards, -(-int(seen["bytes"]) // TASK_BYTES), -(-int(seen["n"]) // max(1, per_task)))))
    _, local = _open(base)
    rows = files.repartition(tasks, "path").select("path", "size").mapInArrow(_reader(base, local), SCHEMA)
    path = F.concat(F.lit(f"{subdir}/" if subdir else ""), F.col("path"))
    return rows.select(
        F.lit(project or root.rstrip("/")).alias("project"), path.alias("path"), "content", "error"
    )
