"""Baseline, suppression and severity gates, and the exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import gate_rank
from lodestone.plans.lineage import sound_unions


def skip_validation(findings: DataFrame, bar: str) -> DataFrame:
    """``skip``: findings of a model under the severity bar are not sent to judges."""
    rank = {"none": 0, "informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}.get(bar, 1)
    return findings.withColumn("skip", F.lit(rank > 0) & (F.col("source") == "llm") & (gate_rank("severity", 2) < rank))


def passes(threshold: str):
    rank = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}.get(threshold, 2)
    return gate_rank("severity", 0) >= rank


def active_suppressions(suppressions: DataFrame, now: float) -> DataFrame:
    """Last entry of each fingerprint (by ord), if it has not expired."""
    last = F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("ord")))
    return suppressions.withColumn("nth", last).filter(F.col("nth") == 1).filter(F.col("expires").isNull() | (F.col("expires") > now)).select("fingerprint")


def gated(findings: DataFrame, baseline: DataFrame, suppressions: DataFrame, now: float, threshold: str = "medium", new_only: bool = True) -> DataFrame:
    """``gate`` of each finding (fingerprint, severity, status): dropped, informational, suppressed, baselined or reportable."""
    quiet = active_suppressions(suppressions, now).withColumn("quiet", F.lit(True))
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    f = findings.join(quiet, "fingerprint", "left").join(known, "fingerprint", "left")
    is_quiet = F.coalesce("quiet", F.lit(False))
    low = F.when((F.lower("severity") == "informational") & ~is_quiet, "informational").otherwise("dropped")
    gate = F.when(F.col("status") == "false_positive", "dropped").when(~passes(threshold), low).when(is_quiet, "suppressed").when(F.lit(new_only) & F.coalesce("known", F.lit(False)), "baselined").otherwise("reportable")
    return f.withColumn("gate", gate).drop("quiet", "known")


def fail_closed(findings: DataFrame, threshold: str = "medium") -> DataFrame:
    """``gate`` where baseline and suppressions cannot be read: every finding at the threshold is reportable, but those refuted or suppressed."""
    told = ~F.coalesce(F.col("status").isin("false_positive", "suppressed"), F.lit(False)) & passes(threshold)
    return findings.withColumn("gate", F.when(told, "reportable").otherwise("dropped"))


def merged_baseline(old: DataFrame, found: DataFrame) -> DataFrame:
    """Union of fingerprints; ``added`` tells the new ones."""
    o = old.select("fingerprint").distinct().withColumn("was", F.lit(True))
    return o.join(found.select("fingerprint").distinct(), "fingerprint", "full").select("fingerprint", F.col("was").isNull().alias("added"))


def exit_code(gates: DataFrame, cells: DataFrame, limited: bool = False) -> DataFrame:
    """1 if anything is reportable, else 2 if coverage is incomplete and no limit was set, else 0."""
    n = gates.agg(F.count_if(F.col("gate") == "reportable").alias("n"))
    left = cells.agg(F.count_if(F.col("state") != "ANALYZED").alias("left"))
    return n.join(left).select(F.when(F.col("n") > 0, 1).when((F.col("left") > 0) & F.lit(not limited), 2).otherwise(0).alias("code"))


def resolved(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Find (asked) by row id, else whole fingerprint, else an unambiguous prefix of 8: status found, ambiguous or none."""
    sound_unions(findings.sparkSession)
    # the rows of a key are told by their least and greatest id before they are joined, so that a request meets one row, however many findings share a fingerprint
    span = [F.min("id").alias("least"), F.max("id").alias("most")]
    prints = findings.groupBy(F.col("fingerprint").alias("key")).agg(*span)
    short = prints.groupBy(F.substring("key", 1, 8).alias("key")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    known = findings.select(F.lit(1).alias("way"), F.col("id").cast("string").alias("key"), F.col("id").alias("least"), F.col("id").alias("most"))
    for way, table in ((2, prints), (3, short)):
        known = known.unionByName(table.select(F.lit(way).alias("way"), "key", "least", "most"))
    prefix = F.substring(F.regexp_replace("asked", "^F-", ""), 1, 8)
    ways = [F.struct(F.lit(way).alias("way"), key.alias("key")) for way, key in ((1, F.col("asked")), (2, F.col("asked")), (3, F.when(F.length(prefix) == 8, prefix)))]
    asked = wanted.groupBy("asked").agg(F.count("*").cast("int").alias("times"))
    met = asked.select("asked", "times", F.explode(F.array(*ways)).alias("w")).select("asked", "times", "w.*").join(known.filter("least is not null"), ["way", "key"], "left")
    met = met.groupBy("asked", "times", "way").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    first = met.groupBy("asked", "times").agg(F.min(F.when(F.col("least").isNotNull(), F.struct("way", "least", "most"))).alias("x"))
    several = F.col("x.least") != F.col("x.most")
    status = F.when(F.col("x").isNull(), "none").when(several, "ambiguous").otherwise("found")
    # what was asked for twice is answered twice
    again = first.select("asked", status.alias("status"), F.when(~several, F.col("x.least")).alias("id"), F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return again.select("asked", "status", "id")
