"""Cutting the lineage of plans, and positions in a total order."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sound_unions(spark: SparkSession) -> None:
    """Have a union's rows dealt anew before they are grouped.

    Spark 4.1 may take a union of tables that are each dealt by a key as dealt by it (spark.sql.unionOutputPartitioning), and then rows of one key can stay in
    several tasks: windows, groups and joins above give wrong rows (tests/test_unions.py has a case). The setting is turned off for the session.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_methods(spark: SparkSession) -> None:
    """Have stages whose generated method is too long for the JVM's compiler run as several shorter ones.

    HotSpot compiles no method of over 8000 bytes of code, and Spark's default limit is 65535: between the two, rows are interpreted. The setting is
    changed for the session, unless it is lower.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under the session's ``spark.checkpoint.dir``, which driver and executors share.

    Where unset, a temporary folder is set on a local master; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lodestone-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    sound_unions(df.sparkSession)
    return df.checkpoint()


def kept(rows: DataFrame) -> DataFrame:
    """The rows written once, by columns, in the shared folder: for what is read more than once and costs more to make than to read."""
    sound_unions(rows.sparkSession)
    path = f"{shared_dir(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else they stay on the disks until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def placed(rows: DataFrame, *order: str, apart: str | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """The rows with ``place``, their position from 0 in the total order of some columns, without a window over all rows.

    Rows are dealt to tasks by ranges of the order and written; the tasks' counts, one row for each, give where each begins.
    Rows alike in all columns of the order are placed among themselves as they come. ``apart`` names a column of few values, none null: the rows of each
    value are placed from 0 by themselves, all in one pass. ``told`` has columns of the order that follow from a row's others: they do not travel.
    """
    by = [apart, *order] if apart else [*order]
    told = told or {}
    dealt = rows.repartitionByRange(*(told.get(c, F.col(c)) for c in by)).withColumns({c: told[c] for c in by if c in told}).sortWithinPartitions(*by).select(*rows.columns)
    path = f"{shared_dir(rows.sparkSession)}/placed-{uuid.uuid4().hex}"
    with shuffles_dropped(rows.sparkSession):
        dealt.withColumn("part_", F.spark_partition_id()).withColumn("nth_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path)
    staged = rows.sparkSession.read.parquet(path)
    key = ["part_", apart] if apart else ["part_"]
    counts = staged.groupBy(*key).agg(F.count("*").alias("n"), F.min("nth_").alias("first"))
    earlier = Window.partitionBy(*key[1:]).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*key, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("before_"))
    return staged.join(F.broadcast(before), key).withColumn("place", F.col("before_") + F.col("nth_")).drop("part_", "nth_", "before_")
