"""Chunks of texts by line windows and by symbol ranges, and the cells they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.lineage import sound_unions


def windows(spans: DataFrame, size: int = 150, overlap: int = 20) -> DataFrame:
    """Cut spans (path, lo, hi) longer than ``size`` lines into windows that overlap; rows gain start_line, end_line."""
    step = size - overlap
    n = F.col("hi") - F.col("lo") + 1
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / float(step))).cast("int")
    out = spans.filter("hi >= lo").withColumn("w", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("start_line", (F.col("lo") + F.col("w") * step).cast("int")).withColumn("end_line", F.least(F.col("hi"), F.col("lo") + F.col("w") * step + size - 1).cast("int")).drop("w")


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_index by position over the whole file."""
    order = Window.partitionBy("path").orderBy("start_line", "end_line")
    return chunks.select("path", (F.row_number().over(order) - 1).alias("chunk_index"), "start_line", "end_line")


def fixed_chunks(files: DataFrame, size: int = 150, overlap: int = 20) -> DataFrame:
    """files: (path, n_lines). Empty files have no chunk."""
    return numbered_chunks(windows(files.select("path", F.lit(1).alias("lo"), F.col("n_lines").alias("hi")), size, overlap))


def symbol_chunks(files: DataFrame, ranges: DataFrame, size: int = 150, overlap: int = 20) -> DataFrame:
    """Whole symbols where they fit, the gaps between them, and windows of what is too long.

    ranges: (path, start_line, end_line). Reversed ranges and those that start behind the end count as none. A running
    maximum tells the first line that no earlier range covers, so nested ranges give no line twice. Files
    without ranges are cut by windows.
    """
    sound_unions(files.sparkSession)
    r = ranges.join(files, "path").filter("end_line >= start_line and start_line <= n_lines").select("path", "start_line", "end_line", F.greatest(F.lit(1), "start_line").alias("a"), F.least("n_lines", "end_line").alias("b"))
    before = Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("cursor", F.greatest(F.lit(1), F.coalesce(F.max(F.col("b") + 1).over(before), F.lit(1)))).filter("b >= cursor")
    inside = r.select("path", F.greatest("a", "cursor").alias("lo"), F.col("b").alias("hi"))
    gaps = r.filter("a > cursor").select("path", F.col("cursor").alias("lo"), (F.col("a") - 1).alias("hi"))
    covered = r.groupBy("path").agg(F.max("b").alias("b"))
    tails = files.join(covered, "path", "left").select("path", (F.coalesce("b", F.lit(0)) + 1).alias("lo"), F.col("n_lines").alias("hi")).filter("lo <= hi")
    return numbered_chunks(windows(inside.unionByName(gaps).unionByName(tails), size, overlap))


def cells(chunks: DataFrame, files: DataFrame, classes: list[str]) -> DataFrame:
    """Every chunk with every class; a file without chunks has one cell for each class, without a range.

    The classes are a short configured list, so they are exploded in place instead of joined.
    """
    spans = files.select("path").join(chunks, "path", "left").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0)))
    return spans.withColumn("attack_class", F.explode(F.array(*[F.lit(c) for c in classes])))
