"""The coverage ledger: files, cells, reads, claims and their updates between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUMAN = ["false_positive", "accepted_risk", "fixed", "suppressed"]


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha256, change) by comparing snapshots: added, changed, same or missing."""
    both = old.select("path", F.col("sha256").alias("old_sha")).join(new.select("path", F.col("sha256").alias("new_sha")), "path", "full")
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "missing").when(F.col("old_sha") == F.col("new_sha"), "same").otherwise("changed")
    return both.select("path", F.coalesce("new_sha", "old_sha").alias("sha256"), change.alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key; other old rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pruned(old: DataFrame, found: DataFrame) -> DataFrame:
    """Drop rows whose path was not found again, unless more than half would go."""
    gone = old.join(found.select("path").distinct(), "path", "left_anti").select("path").distinct()
    n = old.select("path").distinct().agg(F.count("*").alias("n")).join(gone.agg(F.count("*").alias("g")))
    marked = old.join(gone.withColumn("gone", F.lit(True)), "path", "left").join(F.broadcast(n))
    return marked.filter(F.col("gone").isNull() | (F.col("g") * 2 > F.col("n"))).drop("gone", "g", "n")


def reseeded(old: DataFrame, planned: DataFrame, resume: bool) -> DataFrame:
    """Cells after seeding anew: planned ones only; progress is kept for ANALYZED cells on resume, else reset."""
    key = ["path", "chunk_index", "attack_class"]
    state = old.select(*key, F.col("state").alias("old_state"), F.col("thoroughness").alias("old_t"))
    keep = F.col("old_state").eqNullSafe(F.lit("ANALYZED")) & F.lit(resume)
    return planned.join(state, key, "left").withColumn("state", F.when(keep, "ANALYZED").otherwise("PENDING")).withColumn("thoroughness", F.when(keep, F.col("old_t")).otherwise(0.0)).withColumn("attempts", F.lit(0)).drop("old_state", "old_t")


def replaced_functions(old: DataFrame, indexed: DataFrame, new: DataFrame, resume: bool) -> DataFrame:
    """Functions (path, name, start_line, end_line, visited) after the files ``indexed`` (path) were indexed anew.

    Their functions are those of ``new``; on resume one of the same name and start line keeps ``visited``. Other files' stay.
    """
    again = indexed.select("path").distinct()
    key = ["path", "name", "start_line"]
    prior = old.groupBy(key).agg(F.max("visited").alias("prior"))
    visited = F.coalesce("prior", F.lit(False)) if resume else F.lit(False)
    fresh = new.join(again, "path", "left_semi").join(prior, key, "left").select(*key, "end_line", visited.alias("visited"))
    return old.join(again, "path", "left_anti").select(*key, "end_line", "visited").unionByName(fresh)


def boosted(cells: DataFrame, prefixes: DataFrame, delta: float) -> DataFrame:
    """Weight plus ``delta`` for every prefix of the path.

    A path is cut at the lengths that prefixes have, so prefixes of any number are joined by equality.
    """
    p = prefixes.select("prefix").distinct()
    lengths = p.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    paths = cells.select("path").distinct().join(F.broadcast(lengths))  # one row, no longer than the longest prefix
    starts = paths.select("path", F.explode("lengths").alias("size")).filter(F.col("size") <= F.length("path")).select("path", F.substring(F.col("path"), F.lit(1), F.col("size")).alias("prefix"))
    hits = starts.join(p, "prefix").groupBy("path").count()
    return cells.join(hits, "path", "left").withColumn("weight", F.col("weight") + F.coalesce("count", F.lit(0)) * delta).drop("count")


def claimable(now: float, max_attempts: int) -> Column:
    free = F.col("state").isin("PENDING", "SHALLOW", "FAILED") | ((F.col("state") == "IN_PROGRESS") & (F.col("lease_expires") < now))
    return free & (F.col("attempts") < max_attempts)


def claimed(cells: DataFrame, n: int, now: float, max_attempts: int = 3, lease: float = 600.0) -> DataFrame:
    """The next ``n`` cells in one go: highest weight, fewest attempts, least id; leased and counted."""
    best = cells.filter(claimable(now, max_attempts)).orderBy(F.desc("weight"), "attempts", "id").limit(n)
    return best.withColumn("state", F.lit("IN_PROGRESS")).withColumn("lease_expires", F.lit(now + lease)).withColumn("attempts", F.col("attempts") + 1)


def visited(functions: DataFrame, reads: DataFrame, span: int = 256) -> DataFrame:
    """Functions (file_id, name, start_line, end_line) that some read overlaps.

    Reads are first merged into disjoint intervals for each file. Both sides are cut into spans of lines, which join by
    equality with the overlap as a further condition, so a large or often read file is spread over its spans.
    """

    def cut_up(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("span", F.explode(F.sequence(F.floor(F.col(lo) / span), F.floor(F.greatest(lo, hi) / span))))

    key = ["file_id", "name", "start_line", "end_line"]
    met = cut_up(merged_intervals(reads), "lo", "hi").withColumnRenamed("file_id", "f").withColumnRenamed("span", "s")
    f = cut_up(functions.select(key).distinct(), "start_line", "end_line")
    hit = f.join(met, (F.col("file_id") == F.col("f")) & (F.col("span") == F.col("s")) & (F.col("lo") <= F.col("end_line")) & (F.col("hi") >= F.col("start_line")), "left_semi")
    hit = hit.select(key).distinct().withColumn("hit", F.lit(True))
    return functions.select(key).distinct().join(hit, key, "left").withColumn("visited", F.coalesce("hit", F.lit(False))).drop("hit")


def merged_intervals(reads: DataFrame) -> DataFrame:
    """Disjoint intervals (file_id, lo, hi) that cover the same lines as the reads (start_line, end_line)."""
    order = Window.partitionBy("file_id").orderBy("start_line", "end_line")
    r = reads.filter("end_line >= start_line").select("file_id", "start_line", "end_line").distinct()
    r = r.withColumn("top", F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("island", F.sum(F.when(F.col("start_line") <= F.col("top") + 1, 0).otherwise(1)).over(order))
    return r.groupBy("file_id", "island").agg(F.min("start_line").alias("lo"), F.max("end_line").alias("hi")).drop("island")


def coverage(cells: DataFrame, least: float) -> DataFrame:
    """One row: cells, analyzed, ratio (0 without cells) and analyzed cells under the thoroughness ``least``."""
    done = F.col("state") == "ANALYZED"
    a = cells.agg(F.count("*").alias("n_cells"), F.count_if(done).alias("analyzed"), F.count_if(done & (F.coalesce("thoroughness", F.lit(0.0)) < least)).alias("thin"))
    return a.withColumn("ratio", F.coalesce(F.col("analyzed") / F.nullif("n_cells", F.lit(0)), F.lit(0.0)))


def outcome(replies: DataFrame, least: float, max_shallow: int) -> DataFrame:
    """State and thoroughness after a reply (error, parsed, shape_ok, truncated, calls, errors, n_findings, attempts, prior)."""
    ok = F.greatest(F.lit(0), F.col("calls") - F.col("errors"))
    score = F.when(ok >= 1, 0.4).otherwise(0.0) + F.when(ok >= 3, 0.2).otherwise(0.0) + F.when((F.col("n_findings") > 0) | (ok >= 2), 0.4).otherwise(0.0)
    score = F.least(F.lit(1.0), score)
    failed, weak = F.col("error").isNotNull(), ~F.col("shape_ok") | F.col("truncated")
    t = F.when(failed, 0.0).when(~F.col("parsed"), 0.3).when(weak, F.least(score, F.lit(0.5))).otherwise(score)
    analyzed = ~failed & F.col("parsed") & ~weak & (t >= least)
    plateau = (t > 0) & (F.col("attempts") >= max_shallow) & (t <= F.col("prior"))
    state = F.when(failed, F.when(t > 0, "SHALLOW").otherwise("FAILED")).when(analyzed | (F.col("n_findings") > 0) | plateau, "ANALYZED").otherwise("SHALLOW")
    return replies.withColumn("thoroughness", t).withColumn("state", state)


def plateaus(attempts: DataFrame, max_shallow: int = 2) -> DataFrame:
    """Attempts (cell, attempt, thoroughness) with ``plateau``: some work was done, often enough, and no better than the time before.

    The first attempt is measured against 0, so it is no plateau.
    """
    before = F.coalesce(F.lag("thoroughness").over(Window.partitionBy("cell").orderBy("attempt")), F.lit(0.0))
    return attempts.withColumn("plateau", (F.col("thoroughness") > 0) & (F.col("attempt") >= max(1, max_shallow)) & (F.col("thoroughness") <= before))


def upserted_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings by dedup_key: new values win, a human status stays, base values keep the new or else the old."""
    o = old.select("dedup_key", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "dedup_key"])
    both = o.join(new, "dedup_key", "full")
    cols = []
    for c in new.columns:
        if c == "status":
            cols.append(F.when(F.col("o_status").isin(HUMAN), F.col("o_status")).otherwise(F.coalesce("status", "o_status")).alias("status"))
        elif c != "dedup_key":
            cols.append(F.coalesce(c, f"o_{c}").alias(c))
    return both.select("dedup_key", *cols)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("finding_id").agg(F.max_by("human_result", F.struct("ts", "ord")).alias("human_result"))


def convergence(passes: DataFrame, quiet: int) -> DataFrame:
    """First pass at which coverage is full and the last ``quiet`` passes confirmed nothing (null if none)."""
    order = Window.orderBy("pass_no")
    p = passes.withColumn("island", F.sum(F.when(F.col("confirmed") > 0, 1).otherwise(0)).over(order))
    p = p.withColumn("run", F.sum(F.when(F.col("confirmed") == 0, 1).otherwise(0)).over(Window.partitionBy("island").orderBy("pass_no")))
    return p.filter((F.col("coverage") >= 1) & (F.col("run") >= quiet)).agg(F.min("pass_no").alias("stop_at"))


def first_rows(findings: DataFrame) -> DataFrame:
    """The row with the least id of each dedup_key."""
    nth = F.row_number().over(Window.partitionBy("dedup_key").orderBy("id"))
    return findings.withColumn("nth", nth).filter("nth = 1").drop("nth")


def reloaded(stored: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """Stored findings (file_id) with their path, for keys that are not present yet; only nulls get defaults."""
    f = stored.join(present.select("dedup_key"), "dedup_key", "left_anti")
    f = f.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_rel")), "file_id", "left")
    return f.withColumn("file_rel", F.coalesce("file_rel", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn("votes", F.coalesce("votes", F.lit(1)))
