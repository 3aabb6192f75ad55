"""Coverage out of the log of reads, as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def functions_read(reads: DataFrame, functions: DataFrame, span: int = 256) -> DataFrame:
    """Functions (file_id, name, start_line, end_line) that some read (file_id, start_line, end_line) overlaps, each once.

    Batch or stream: a stream of reads meets the fixed table of functions. Both sides are cut into spans of lines, which
    join by equality. What is kept between batches is one key for each function already read, so it cannot outgrow the
    functions. Reads that end before they start, or hold a null, meet nothing.
    """

    def cut_up(df: DataFrame) -> DataFrame:
        return df.withColumn("span", F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))))

    key = ["file_id", "name", "start_line", "end_line"]
    r = cut_up(reads.filter("end_line >= start_line").select("file_id", "start_line", "end_line"))
    r = r.withColumnsRenamed({"file_id": "file", "start_line": "lo", "end_line": "hi", "span": "at"})
    f = cut_up(functions.filter("end_line >= start_line").select(key).distinct())
    met = (F.col("file_id") == F.col("file")) & (F.col("span") == F.col("at")) & (F.col("lo") <= F.col("end_line")) & (F.col("hi") >= F.col("start_line"))
    return r.join(f, met).select(key).dropDuplicates(key)
