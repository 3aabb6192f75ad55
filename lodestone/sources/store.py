"""The ledger between runs: Parquet tables whose new versions are staged, checked, and made current by one pointer.

A version is a small file ``versions/<number>.json`` that names a folder for each table, the layout it was written in, and the run's checkpoint. The highest
number is current. Tables are written into folders of their own before; a run that dies in between leaves the version before it as it was. Two writers cannot both
make the same number: the file is created only if it is not there, and the loser reads the winner's version and tries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ledger import first_rows

LAYOUT = 5
#: Columns that must tell rows of a table apart; rows with a null in them are not compared.
KEYS = {"files": ["path"], "cells": ["file_id", "chunk_index", "attack_class"], "findings": ["dedup_key"]}
# The layout that brought a column, its type, and what it holds in rows from before.
ADDED = {
    "llm_calls": [(2, "cache_read_tokens", "bigint", "0"), (2, "cache_write_tokens", "bigint", "0")],
    "cells": [(3, "chunk_start", "int", "null"), (3, "chunk_end", "int", "null")],
    "findings": [(4, "symbol", "string", "null"), (4, "cited_snippet", "string", "null"), (5, "base_severity", "string", "null"), (5, "base_confidence", "double", "null")],
}
#: From this layout on, findings are one row for each dedup_key.
ONE_ROW_EACH = 4


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Broken(RuntimeError):
    """Staged rows are not what the table may hold."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)  # name: folder, layout
    checkpoint: dict | None = None


class Store:
    """Tables of a ledger under ``root``, a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("versions").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def current(self) -> Version:
        """The version with the highest number that is written to its end; number 0 without tables in a new store."""
        folder = self._path("versions")
        if not self.files.exists(folder):
            return Version()
        numbers = sorted((int(x.getPath().getName().removesuffix(".json")) for x in self.files.listStatus(folder) if x.getPath().getName().endswith(".json")), reverse=True)
        for n in numbers:
            text = "".join(r["value"] for r in self.spark.read.text(f"{self.root}/versions/{n:012d}.json", wholetext=True).collect())
            try:
                return Version(**json.loads(text))
            except ValueError:  # being written just now, or left behind by a writer that died doing it
                continue
        return Version()

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """A table of a version (the current one), in the present layout whatever it was written in."""
        at = (version or self.current()).tables[table]
        return in_layout(self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{at['folder']}"), table, at["layout"])

    def commit(self, tables: dict[str, DataFrame], read: Version, checkpoint: dict | None = None) -> Version:
        """Make a version of new tables; all others, and the checkpoint if none is given, stay those of the version that was read.

        Raises Broken if a table's key is not unique, Conflict if another version was made since. In both cases nothing changes.
        """
        staged = {name: {"folder": self._stage(name, df), "layout": LAYOUT} for name, df in tables.items()}
        return self._point(Version(read.number + 1, {**read.tables, **staged}, checkpoint or read.checkpoint))

    def _stage(self, table: str, df: DataFrame) -> str:
        folder = f"data/{table}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        if key := KEYS.get(table):
            written = self.spark.read.parquet(f"{self.root}/{folder}").na.drop(subset=key)
            if twice := written.groupBy(key).count().filter("count > 1").first():
                raise Broken(f"{table} has {twice['count']} rows of {[twice[k] for k in key]}")
        return folder

    def _point(self, version: Version) -> Version:
        text = json.dumps({"number": version.number, "tables": version.tables, "checkpoint": version.checkpoint})
        last = self.current().number
        if last >= version.number:
            raise Conflict(f"version {last} was made meanwhile")
        try:
            out = self.files.create(self._path("versions", f"{version.number:012d}.json"), False)
        except Py4JJavaError as e:
            if "already exists" in str(e.java_exception):
                raise Conflict(f"version {version.number} is being made") from None
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return version

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> Version:
        """Change a table as it is in the current version, again if another writer was first: an update that holds against what it read."""
        for left in reversed(range(tries)):
            version = self.current()
            try:
                return self.commit({table: change(self.read(table, version))}, version)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one try is needed")

    def set_checkpoint(self, phase: str, pass_no: int = 0, config_hash: str | None = None) -> Version:
        return self.commit({}, self.current(), {"phase": phase, "pass_no": pass_no, "config_hash": config_hash})

    def migrate(self) -> Version:
        """Write all tables of older layouts anew, as one version; nothing if there is none."""
        version = self.current()
        old = [t for t, at in version.tables.items() if at["layout"] < LAYOUT]
        return self.commit({t: self.read(t, version) for t in old}, version) if old else version


def in_layout(df: DataFrame, table: str, layout: int) -> DataFrame:
    """Rows of an older layout as of the present one: columns that came later have their defaults, findings are one row for each key, the least id's."""
    for since, name, kind, value in ADDED.get(table, []):
        if layout < since and name not in df.columns:
            df = df.withColumn(name, F.expr(f"cast({value} as {kind})"))
        elif layout < since and value != "null":  # files of several layouts in one folder
            df = df.withColumn(name, F.coalesce(F.col(name), F.expr(f"cast({value} as {kind})")))
    if table == "findings" and layout < ONE_ROW_EACH:
        df = first_rows(df.filter("dedup_key is not null")).unionByName(df.filter("dedup_key is null"))
    return df
