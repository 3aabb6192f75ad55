"""URL filters by a sort-merge range join.

A host's canonical key is its labels in reverse, each followed by a dot (``com.example.www.``), so a rule for a
host and its subdomains is an interval of keys. The intervals are nested or apart: between two interval
bounds the active rules are constant. Keys and bounds are sorted together; a sweep carries the stack of active rules
from the last bound on to every url, and the longest rule of the stack whose path fits decides.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, host/path) pairs; a repeated rule keeps its least verdict: allow before block."""
    df = spark.createDataFrame(rules, "verdict string, rule string")
    df = df.groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.regexp_extract("rule", "^([^/]*)", 1)
    return df.withColumn("key", key_of(host)).withColumn("rule_path", F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))).withColumn("long", F.length("rule"))


def _prefixes(key: str) -> Column:
    """All interval starts that hold a key: its prefixes that end with a dot."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".")))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): the active rules from each interval bound on, longest first."""
    after = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))  # the character behind the dot
    bounds = rules.select("key").unionByName(rules.select(after.alias("key"))).distinct()
    active = bounds.withColumn("start", F.explode(_prefixes("key"))).join(rules.withColumnRenamed("key", "start"), "start")
    stack = F.sort_array(F.collect_list(F.struct("long", "rule", "rule_path", "verdict")), asc=False)
    return bounds.join(active.groupBy("key").agg(stack.alias("stack")), "key", "left").withColumn("stack", F.coalesce("stack", F.array().cast("array<struct<long:int,rule:string,rule_path:string,verdict:string>>")))


def _range_starts(bounds: DataFrame, n: int) -> list[str]:
    """Keys of bounds that split them into ``n`` ranges of about equal size (one row of the driver's for each range)."""
    if n == 1:
        return []
    ranged = bounds.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("key"))
    return sorted(r.key for r in ranged.select("key").collect())[1:]


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", slice_rows: int = 100_000, range_bounds: int = 100_000) -> DataFrame:
    """page_id, host, path, rule and verdict of every url.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; of those that fit the
    longest rule wins (then the greater text). Without one, rule is null and the verdict is ``default``. A null url or one
    without ``://`` has an empty host and path; a url without a path fits no rule. Repeated rows stay; other columns are
    not read; an empty table or rule list is allowed.

    Keys are split into ranges of about ``range_bounds`` bounds, each of which starts at a bound with its whole stack. The urls
    of a range are dealt into slices by hash, so a frequent host does not gather in one task; every slice is swept
    with its own copy of its range's bounds. Copies and urls together stay in proportion to the urls and bounds. The
    urls are counted first, to choose the slices.
    """
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path"), F.xxhash64("page_id", "url").alias("dealt"))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    bounds = _stacks(rule_table(pages.sparkSession, rules))
    starts = _range_starts(bounds, math.ceil(2 * len(rules) / range_bounds))
    within = F.size(F.filter(F.lit(starts), lambda start: start <= F.col("key"))) if starts else F.lit(0)
    points = urls.withColumn("key", key_of(F.col("host"))).withColumn("range", within)
    rows = dict(points.groupBy("range").count().collect())  # one row for each range
    least = math.ceil(pages.sparkSession.sparkContext.defaultParallelism / (len(starts) + 1))
    slices = F.get(F.lit([max(least, math.ceil(rows.get(i, 0) / slice_rows)) for i in range(len(starts) + 1)]), F.col("range"))
    points = points.withColumn("slice", F.pmod("dealt", slices).cast("int"))
    bounds = bounds.withColumn("range", within).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    events = points.withColumn("is_url", F.lit(1)).unionByName(bounds.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("range", "slice").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url = 1")
    hit = F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return swept.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
