"""Imported findings, rules, baselines and suppressions from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SARIF = """struct<runs array<struct<tool struct<driver struct<rules array<struct<id string, properties struct<cwe string>>>>>,
results array<struct<ruleId string, level string, message struct<text string>,
locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int, endLine int>>>>>>>>>"""


def sarif_uri(uri: str) -> F.Column:
    """Path of a URI: scheme and host dropped from ``file:``, percent codes decoded, no leading ``./`` or ``/``."""
    p = F.regexp_replace(F.col(uri), "^file:(//[^/]*)?", "")
    p = F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^(\./|/)+", "")


def seeds(documents: DataFrame, column: str = "json") -> DataFrame:
    """Findings of SARIF documents (one JSON text in each row): first location only; texts cut to 120 and 2000."""
    runs = documents.select(F.explode_outer(F.from_json(column, SARIF)["runs"]).alias("run"))
    rules = F.map_from_entries(F.transform(F.filter(F.coalesce("run.tool.driver.rules", F.array()), lambda r: r["id"].isNotNull()), lambda r: F.struct(r["id"], r["properties"]["cwe"])))
    r = runs.select(rules.alias("rules"), F.explode("run.results").alias("r"))
    where = F.get("r.locations", F.lit(0))["physicalLocation"]
    level = F.when(F.col("r.level") == "error", "high").when(F.col("r.level").isin("note", "none"), "low").otherwise("medium")
    out = r.select(where["artifactLocation"]["uri"].alias("uri"), F.coalesce(where["region"]["startLine"], F.lit(1)).alias("line_start"), where["region"]["endLine"].alias("line_end"), F.coalesce(F.col("rules")[F.col("r.ruleId")], F.lit("")).alias("cwe"), level.alias("severity"), F.coalesce("r.message.text", F.lit("")).alias("message"))
    return out.filter("uri is not null").select(sarif_uri("uri").alias("file_rel"), "line_start", F.coalesce("line_end", "line_start").alias("line_end"), F.lit("seed").alias("category"), "cwe", "severity", F.lit(0.5).alias("confidence"), F.substring("message", 1, 120).alias("title"), F.substring("message", 1, 2000).alias("description"), F.lit("seed").alias("source"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of a baseline file with scheme 2; raises ValueError for another scheme."""
    doc = spark.read.option("multiLine", True).schema("fingerprint_scheme int, fingerprints array<string>").json(path)
    if doc.filter("not (fingerprint_scheme <=> 2) or fingerprints is null").limit(1).count():
        raise ValueError("not a baseline of fingerprint scheme 2")
    return doc.select(F.explode("fingerprints").alias("fingerprint")).distinct()


def suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ord, fingerprint, reason, owner, expires in epoch seconds) of a JSON list; dates are days in the session's zone."""
    rows = spark.read.option("multiLine", True).schema("fingerprint string, reason string, owner string, expires string").json(path)
    return suppression_entries(rows.withColumn("ord", F.monotonically_increasing_id()))


def suppression_entries(rows: DataFrame) -> DataFrame:
    """Rows with ``expires`` (text: epoch seconds or a day) as epoch seconds; null if it is neither. Rows without a fingerprint go."""
    when = F.coalesce(F.col("expires").try_cast("double"), F.unix_timestamp(F.try_to_timestamp("expires", F.lit("yyyy-MM-dd"))).cast("double"))
    return rows.filter("fingerprint is not null").withColumn("expires", when)
