"""Findings: merging, votes, enrichment, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.replies import id_of
from lodestone.functions.scoring import CATEGORIES, confidence_of, fingerprint, gate_rank, location_key, lookup, merge_rank, scored_confidence, scored_severity, severity_of
from lodestone.plans.lineage import placed

FIRST = ["file_rel", "line_start", "line_end", "category", "hedged", "status", "source"]
FILLED = ["cited_snippet", "symbol", "cwe", "remediation"]
#: Columns that order findings of one ``ord``.
TIES = ["line_start", "line_end", "severity", "title", "description", "confidence", "reachable", "cited_snippet", "cwe", "symbol", "file_rel", "category", "status"]


def merged(findings: DataFrame, key: Column) -> DataFrame:
    """``folded`` by a key that is worked out, which stays as ``key``."""
    return folded(findings.withColumn("key", key), "key")


def folded(findings: DataFrame, *keys: str) -> DataFrame:
    """Fold findings with equal keys in the order of ``ord``, those of one ``ord`` by the columns in TIES.

    Votes add up; severity and confidence are the highest; title and description follow the last finding that
    raised the severity and has them; reachable wins over the first value; evidence is concatenated in order; empty
    snippet, symbol, cwe and remediation are filled from the first that has one; other fields are the first's. ``superseded`` lists the fingerprints that the fold leaves behind. The evidence of one key gathers in one row.
    """
    # one sort of each key gives every row its number, which then stands for the order
    order = Window.partitionBy(*keys).orderBy("ord", *TIES)
    f = findings.withColumn("rank", merge_rank("severity")).withColumn("print", fingerprint())
    f = f.withColumn("nth", F.row_number().over(order))
    f = f.withColumn("raises", F.coalesce(F.col("rank") > F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))

    def leading(name: str) -> Column:
        return F.coalesce(F.max_by(name, F.when(F.col("raises") & (F.col(name) != ""), F.col("nth"))), F.lit("")).alias(name)

    def filled(name: str) -> Column:
        return F.coalesce(F.min_by(name, F.when(F.col(name) != "", F.col("nth"))), F.lit("")).alias(name)

    # the first row's values travel as one, and lists are sorted natively: an interpreted comparison for each pair costs more than the fold
    one = ["ord", *FIRST, "print", F.col("reachable").alias("own")]
    evidence = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "evidence"))), lambda x: x["evidence"])).alias("evidence")
    aggs = [
        F.min_by(F.struct(*one), "nth").alias("one"),
        F.sum("votes").cast("int").alias("votes"),
        F.min_by("severity", F.struct(-F.col("rank"), "nth")).alias("severity"),
        leading("title"),
        leading("description"),
        F.max("confidence").alias("confidence"),
        F.max((F.col("reachable") == "reachable").cast("int")).alias("reached"),
        evidence,
        F.collect_set("print").alias("prints"),
        *[filled(c) for c in FILLED],
    ]
    reachable = F.when(F.col("reached") == 1, "reachable").otherwise(F.col("one.own"))
    superseded = F.sort_array(F.array_except("prints", F.array("one.print")))
    shown = [*(f"one.{c}" for c in ["ord", *FIRST]), "votes", "severity", "title", "description", "confidence", reachable.alias("reachable"), "evidence", superseded.alias("superseded"), *FILLED]
    return f.groupBy(*keys).agg(*aggs).select(*keys, *shown)


def merge_findings(findings: DataFrame) -> DataFrame:
    return merged(findings, fingerprint())


def merge_by_location(findings: DataFrame) -> DataFrame:
    return merged(findings, location_key())


def grouped_ids(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, group) from claimed groups (grp, members): the first claim of an id holds, unclaimed ids stand alone.

    Refused, so that all stand alone, if one group of four or more ids would hold more than max(2, half of them).
    """
    claims = groups.select("grp", F.posexplode("members").alias("pos", "id")).join(ids, "id", "left_semi")
    first = claims.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("grp", "pos"))).filter("nth = 1")
    sizes = first.groupBy("grp").count()
    limits = ids.agg(F.count("*").alias("n")).join(sizes.agg(F.max("count").alias("biggest")))
    refused = F.col("n") < 3
    refused = refused | ((F.col("n") >= 4) & (F.coalesce("biggest", F.lit(0)) > F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    out = ids.join(first.select("id", "grp"), "id", "left").join(F.broadcast(limits.select(refused.alias("refused"))))
    return out.select("id", F.when(~F.col("refused"), F.col("grp").cast("string")).otherwise(None).alias("grp")).withColumn("grp", F.coalesce("grp", F.concat(F.lit("single-"), F.col("id").cast("string"))))


def batched(findings: DataFrame, order: list[str], size: int = 150, told: dict[str, Column] | None = None) -> DataFrame:
    """Findings with ``batch`` and ``idx``, their number in it from 0: so many at a time, in the total order of some columns (``told`` as in ``placed``)."""
    return placed(findings, *order, told=told).withColumn("batch", F.floor(F.col("place") / size)).withColumn("idx", F.col("place") % size).drop("place")


def reply_groups(replies: DataFrame, sizes: DataFrame) -> DataFrame:
    """(batch, groups) out of replies (batch, json): lists of lists of ids, for batches of ``n`` findings (batch, n); ``groups`` has (grp, pos) of an id.

    Ids may be numbers or texts; what is no id from 0 to n - 1 is left out, and an id belongs to the first group that names it, once. A batch
    has no row, so that all its findings stand alone, if it has under three, if its reply is no list or holds no id, or if it is refused: one group of
    a batch of four or more would hold more than max(2, half) of it.
    """
    # replies are dealt by batch before they are unfolded, into a fixed number of parts: they are short beside what they unfold to
    asked = dealt_by_batch(replies.join(sizes, "batch").filter("n >= 3").select("batch", "n", "json"))
    lists = asked.select("batch", "n", F.posexplode(F.from_json("json", "array<string>")).alias("grp", "members"))
    named = lists.select("batch", "n", "grp", F.posexplode(F.from_json("members", "array<string>")).alias("pos", "raw")).withColumn("idx", id_of("raw", "n")).filter("idx is not null")
    first = named.groupBy("batch", "n", "idx").agg(F.min(F.struct("grp", "pos")).alias("x"))
    members = first.groupBy("batch", "n", F.col("x.grp").alias("grp")).agg(F.count("*").alias("size"), F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), "x")).alias("members"))
    groups = members.groupBy("batch", "n").agg(F.max("size").alias("biggest"), F.flatten(F.collect_list("members")).alias("groups"))
    allowed = ~((F.col("n") >= 4) & (F.col("biggest") > F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    return groups.filter(allowed).select("batch", F.map_from_entries("groups").alias("groups"))


def dealt_by_batch(rows: DataFrame) -> DataFrame:
    """The rows dealt by ``batch`` into as many parts as the session's shuffles have, however few bytes they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch")


def semantically_merged(batches: DataFrame, replies: DataFrame, told: dict[str, Column] | None = None) -> DataFrame:
    """Findings of ``batched`` folded by the groups that the replies (batch, json) give each batch; the rest as they are.

    The representative has the highest severity, then confidence, then comes first in its group; it absorbs the others in the group's order. ``ord`` and all
    that a fold does not combine are the representative's. Findings are dealt once, by batch, as groups do not leave it. With ``told``, the findings'
    columns, all of them, are worked out of those of ``batches`` only then, so that these travel alone.
    """
    sizes = batches.groupBy("batch").agg(F.count("*").alias("n"))
    f = batches.repartition("batch").join(reply_groups(replies, sizes), "batch", "left").withColumn("said", F.try_element_at("groups", F.col("idx").cast("long"))).drop("groups")
    if told:
        f = f.select("batch", "idx", "said", *[x.alias(name) for name, x in told.items()])
    f = f.withColumn("grp", F.coalesce("said.grp", F.lit(-1))).withColumn("alone", F.when(F.col("said").isNull(), F.col("idx")).otherwise(-1)).withColumn("pos", F.col("said.pos")).drop("said", "idx")
    lead = F.row_number().over(Window.partitionBy("batch", "grp", "alone").orderBy(-merge_rank("severity"), F.desc("confidence"), "pos"))
    f = f.withColumn("ord", F.struct(F.when(lead == 1, -1).otherwise(F.col("pos")).alias("pos"), F.col("ord").alias("own"))).drop("pos")
    return folded(f, "batch", "grp", "alone").withColumn("ord", F.col("ord.own")).drop("batch", "grp", "alone")


def judged(votes: DataFrame, quorum: int, panel: int) -> DataFrame:
    """Outcome of judge votes (id, prior, verdict, reachable, voted), one row for each judge.

    Quorum is clamped to the panel. Confirmed is tested before rejected; without enough answers nothing changes. The
    majority of the voters' reachability wins, ties alphabetically.
    """
    q = max(1, min(quorum, panel))
    c = F.sum((F.col("voted") & (F.col("verdict") == "confirmed")).cast("int"))
    r = F.sum((F.col("voted") & (F.col("verdict") == "rejected")).cast("int"))
    n = F.sum(F.col("voted").cast("int"))
    tally = votes.groupBy("id").agg(F.max("prior").alias("prior"), c.alias("c"), r.alias("r"), n.alias("n"))
    said = votes.filter("voted and reachable is not null").groupBy("id", "reachable").count()
    mode = said.groupBy("id").agg(F.min_by("reachable", F.struct(-F.col("count"), "reachable")).alias("reachable"))
    status = F.when(F.col("c") >= q, "confirmed").when(F.col("r") >= q, "false_positive").otherwise("new")
    conf = F.when(F.col("c") >= q, F.greatest("prior", F.least(F.lit(1.0), 0.5 + 0.15 * F.col("c")))).when(F.col("r") >= q, F.greatest(F.lit(0.0), F.col("prior") - 0.4)).when(F.col("n") < q, F.col("prior")).otherwise(F.greatest(F.lit(0.1), F.least("prior", 0.2 + 0.1 * F.col("c"))))
    return tally.join(mode, "id", "left").select("id", status.alias("status"), conf.alias("confidence"), F.col("c").alias("votes"), "reachable")


def enriched(findings: DataFrame) -> DataFrame:
    """CWE and OWASP defaults, severity and confidence from the base values, latched on first use.

    A ``language`` column, if there is one, lowers the confidence for c and cpp.
    """
    f = findings.withColumn("cwe", F.coalesce(F.nullif("cwe", F.lit("")), lookup(F.col("category"), {k: v[0] for k, v in CATEGORIES.items()}, "")))
    f = f.withColumn("owasp", lookup(F.col("category"), {k: v[1] for k, v in CATEGORIES.items()}, ""))
    for c in ("severity", "confidence"):
        f = f.withColumn(f"base_{c}", F.coalesce(f"base_{c}", c) if f"base_{c}" in f.columns else F.col(c))
    return f.withColumn("severity", scored_severity("base_severity", "reachable")).withColumn("confidence", scored_confidence(F.col("base_confidence"), F.col("votes"), F.col("hedged"), F.col("language") if "language" in f.columns else None))


def settled(findings: DataFrame) -> DataFrame:
    """Enrich, then merge by fingerprint again, as the cwe is part of it."""
    return merge_findings(enriched(findings).drop("base_severity", "base_confidence"))


def canonical(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_rel", "line_start", "line_end", "category", fingerprint())


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(-gate_rank("severity", 0), "file_rel", "line_start", "category", fingerprint())


def coerced(replies: DataFrame) -> DataFrame:
    """Reply values (raw_severity, raw_confidence as text) made regular."""
    return replies.withColumn("severity", severity_of("raw_severity")).withColumn("confidence", confidence_of("raw_confidence"))
