"""Source trees as Spark does not list them: every file, those with a leading dot or underscore too, and one row for each that fails.

``Tree`` is a Python data source. The driver goes down only until there are enough folders to share out; the readers walk these, and never enter an
excluded folder. Contents are opened in a second step, by tasks that each get about the same number of bytes, so a file that cannot be read, or is gone
by then, is a row with a reason and not a failed job. Files are reached through ``pyarrow.fs``, which every executor must be able to open
(a shared mount, HDFS, an object store).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.files import classified, skip_by_name

LISTED = "path string, length long, failed boolean"
#: Bytes of contents in one Arrow batch, and for one reading task.
BATCH_BYTES, TASK_BYTES = 8 << 20, 128 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root (a path or URI) and the root's path in it."""
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)
    system, path = fs.FileSystem.from_uri(root if root.startswith("/") or "://" in root else "file://" + root.removeprefix("file:"))
    return system, path.rstrip("/") or "/"


def entries(system: fs.FileSystem, folder: str, excluded: frozenset[str]) -> tuple[list[str], list[tuple[str, int | None, bool]]]:
    """Folders to go down to, and (path, length, failed) of the files, both by name. A folder that cannot be listed has neither.

    Links to folders are not followed, so no walk goes in a circle; a link to nothing is a file whose length cannot be told.
    """
    try:
        found = _on_disk(folder) if isinstance(system, fs.LocalFileSystem) else [(x.path, x.type == fs.FileType.Directory, x.size) for x in system.get_file_info(fs.FileSelector(folder))]
    except OSError:
        return [], []
    found.sort()
    folders = [path for path, is_folder, _ in found if is_folder and path.rpartition("/")[2] not in excluded]
    return folders, [(path, size, size is None) for path, is_folder, size in found if not is_folder]


def _on_disk(folder: str) -> list[tuple[str, bool, int | None]]:
    """(path, is it a folder, length) of a local folder's entries; Arrow leaves out those whose length it cannot get."""
    out = []
    with os.scandir(folder) as all_:
        for x in all_:
            is_folder = x.is_dir(follow_symlinks=False)
            if is_folder or not x.is_dir():
                try:
                    out.append((x.path, is_folder, None if is_folder else x.stat().st_size))
                except OSError:
                    out.append((x.path, False, None))
    return out


@dataclass
class Share(InputPartition):
    """Folders to walk whole, or files that the driver came by."""

    folders: tuple[str, ...] = ()
    files: tuple[tuple[str, int | None, bool], ...] = ()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.excluded = frozenset(x for x in options.get("excluded", "").split("/") if x)
        self.shares = int(options.get("shares", "64"))

    def partitions(self) -> list[Share]:
        system, path = opened(self.root)
        level, files, grows = [path], [], True
        while level and len(level) < self.shares and grows:
            below: list[str] = []
            for folder in level:
                folders, own = entries(system, folder, self.excluded)
                below += folders
                files += own
            grows, level = len(below) > len(level) or len(level) == 1, below
        each = [Share(folders=tuple(level[i :: self.shares])) for i in range(min(self.shares, len(level)))]
        return [*each, *([Share(files=tuple(files))] if files or not each else [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        cut = len(root.rstrip("/")) + 1
        waiting, rows = list(partition.folders), list(partition.files)
        while waiting or rows:
            while waiting and len(rows) < 4096:
                folders, files = entries(system, waiting.pop(), self.excluded)
                waiting += folders
                rows += files
            columns = zip(*((path[cut:], size, failed) for path, size, failed in rows), strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "length", "failed"])
            rows = []


class Tree(DataSource):
    """Options: path; excluded, folder names with a slash between; shares, the number of folders to share out from."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def listed(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), shares: int = 64) -> DataFrame:
    """(path under the root, length, failed): one row for each file outside the excluded folders."""
    spark.dataSource.register(Tree)
    return spark.read.format("source_tree").option("path", root).option("excluded", "/".join(excluded)).option("shares", shares).load()


def with_contents(files: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The files (path, length, ...) with their ``content``, null where it cannot be read. Dealt anew, about ``task_bytes`` to a task."""
    names = files.columns
    total = files.agg(F.coalesce(F.sum(F.col("length") + 4096), F.lit(0))).first()[0]
    dealt = files.repartition(max(1, -(-int(total) // task_bytes)))

    def read(batches):
        system, home = opened(root)
        for batch in batches:
            contents, size, at = [], 0, 0
            for i, path in enumerate(batch["path"].to_pylist()):
                try:
                    with system.open_input_stream(f"{home.rstrip('/')}/{path}") as stream:
                        contents.append(stream.read())
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*names, "content"])
                    contents, size, at = [], 0, i + 1

    return dealt.mapInArrow(read, type(files.schema)(list(files.schema.fields)).add("content", "binary"))


def discover(
    spark: SparkSession,
    root: str,
    max_bytes: int = 1 << 20,
    excluded: tuple[str, ...] = (".git", "node_modules", "__pycache__"),
    categories: tuple[str, ...] = ("code", "iac", "config"),
    languages: tuple[str, ...] | None = None,
    binary_suffixes: tuple[str, ...] = (),
    scan_unknown: bool = True,
) -> DataFrame:
    """Every file under ``root`` with the first reason to skip it, and text, digest and size of those that stay.

    Reasons in order: those of the name (``files.skip_by_name``), stat_error, too_large, binary (a NUL byte in the first 8192), read_error. Files over
    ``max_bytes`` are not opened. Text is UTF-8 with replacement.
    """
    about = ["path", "language", "category", "length", "skip_reason"]
    names = skip_by_name(categories, languages, binary_suffixes, scan_unknown)
    reason = F.coalesce(names, F.when(F.col("failed"), "stat_error"), F.when(F.col("length") > max_bytes, "too_large"))
    known = classified(listed(spark, root, excluded)).withColumn("skip_reason", reason).select(about)
    none = F.lit(None).cast("string")
    read = with_contents(known.filter("skip_reason is null"), root)
    why = F.when(F.contains(F.substring("content", 1, 8192), F.lit(b"\0")), "binary").when(F.col("content").isNull(), "read_error")
    read = read.withColumn("skip_reason", why)
    kept = F.col("skip_reason").isNull()
    text = F.when(kept, F.make_valid_utf8(F.col("content").cast("string")))
    return known.filter("skip_reason is not null").select(*about, none.alias("sha256"), none.alias("text")).unionByName(read.select(*about, F.when(kept, F.sha2("content", 256)).alias("sha256"), text.alias("text")))
