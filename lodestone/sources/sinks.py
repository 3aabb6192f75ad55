"""Reports as rows of text, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scoring import fingerprint


def report_rows(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object for each finding, with its fingerprint and short id, beside the columns in ``keep``; judges' and base values left out."""
    hidden = {"judge_verdicts", "base_severity", "base_confidence", "ord", "key", *keep}
    f = findings.withColumn("fingerprint", fingerprint()).withColumn("id", F.concat(F.lit("F-"), F.substring("fingerprint", 1, 8)))
    names = sorted(c for c in f.columns if c not in hidden)
    return f.select(*keep, "fingerprint", F.to_json(F.struct(*names)).alias("json"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("reachable") == "reachable").alias("reachable"))


def write_report(findings: DataFrame, path: str) -> None:
    """JSON lines, written in parallel into a folder; an empty table gives an empty folder."""
    report_rows(findings).select("json").write.mode("overwrite").text(path)


def write_empty_report(spark: SparkSession, path: str, reason: str) -> None:
    """An empty report, so that an earlier run's is not taken for this one's: no findings, and a head that says why."""
    spark.createDataFrame([], "json string").write.mode("overwrite").text(f"{path}/findings")
    head = spark.createDataFrame([(0, 0.0, f"no scan performed: {reason}")], "findings int, coverage double, note string")
    head.write.mode("overwrite").json(f"{path}/head")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
