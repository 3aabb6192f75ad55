"""Whole report documents, put together in parallel: JSON, SARIF, Markdown and an executive summary.

A document is a table of lines (section, place, text) whose order is that of section and place. Bodies are placed by ranges of the report's
order, heads and tails come from aggregates, and nothing is gathered: ``write_document`` leaves part files whose names are in the
document's order, so that one after the other they are the document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scoring import fingerprint, gate_rank, sarif_rule_id
from lodestone.operators.findings import TIES
from lodestone.plans.lineage import placed, sound_unions
from lodestone.sources.sinks import report_rows, severity_counts

TOOL, PREFIX = "lodestone", "LODE"
# Frame and levels of SARIF 2.1.0.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "note"}
SEVERITIES = list(LEVELS)
FORMATS = {"json", "sarif", "markdown", "exec_summary"}


def ordered(findings: DataFrame, urgent_first: bool = False, apart: str | None = None) -> DataFrame:
    """Findings with their ``place`` in the report and their fingerprint (``print_``): by location, or by severity first.

    Ties go by all that tells findings apart. The parts of a report, told by the values of ``apart``, are each placed by themselves.
    """
    f = findings.withColumn("print_", fingerprint()).withColumn("rank_", -gate_rank("severity", -5))
    ties = [c for c in ("ord", *TIES) if c in findings.columns]
    by = ["rank_", "file_rel", "line_start", "category", "print_"] if urgent_first else ["file_rel", "line_start", "line_end", "category", "print_"]
    return placed(f, *by, *ties, apart=apart).drop("rank_")


def _line(spark: SparkSession, text: Column) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("place"), text.alias("text"))


def assembled(spark: SparkSession, *parts: str | DataFrame) -> DataFrame:
    """One document of literal lines and of tables (place, text), in this order."""
    tables = [_line(spark, F.lit(p)) if isinstance(p, str) else p.select(F.col("place").cast("long").alias("place"), "text") for p in parts]
    out = None
    for i, t in enumerate(tables):
        t = t.select(F.lit(i).alias("section"), "place", "text")
        out = t if out is None else out.unionByName(t)
    return out


def listed(rows: DataFrame) -> DataFrame:
    """Elements of a JSON list: a comma before each but the first, which is at place 0."""
    return rows.select("place", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), "text").alias("text"))


def write_document(document: DataFrame, path: str, files: int | None = None) -> None:
    """Part files in the document's order; ``files``: how many at most (1 for a short document in one file)."""
    by = ("section", "place")
    dealt = document.repartitionByRange(*by) if files is None else document.repartitionByRange(files, *by)
    dealt.sortWithinPartitions(*by).select("text").write.mode("overwrite").text(path)


# --------------------------------------------------------------------------------------- JSON


def report_json(gating: DataFrame, informational: DataFrame, about: dict, coverage: float, suppressed: int = 0, baselined: int = 0) -> DataFrame:
    """The report with its counts: what gates, and, apart and in no count of it, what is only informational."""
    spark = gating.sparkSession

    # both tiers are dealt and sorted in one pass
    sound_unions(spark)
    own = ordered(gating.withColumn("tier_", F.lit("gating")).unionByName(informational.withColumn("tier_", F.lit("informational")), allowMissingColumns=True), apart="tier_").drop("print_")

    def elements(tier: str) -> DataFrame:
        told = own.filter(F.col("tier_") == tier).drop("tier_")
        return listed(report_rows(told, keep=("place",)).select("place", F.col("json").alias("text")))

    told = {"tool": TOOL, **about, "coverage_pct": round(coverage, 4), "coverage_complete": coverage >= 1.0, "suppressed_count": suppressed, "baselined_count": baselined}
    head = json.dumps(told, ensure_ascii=False)[:-1]

    def count(tier: str, name: str) -> DataFrame:
        n = own.filter(F.col("tier_") == tier).agg(F.count("*").cast("string").alias("n"))
        return n.select(F.lit(0).alias("place"), F.concat(F.lit(f',"{name}_count":'), "n").alias("text"))

    return assembled(spark, head, count("gating", "finding"), ',"findings":[', elements("gating"), "]", count("informational", "informational"), ',"informational":[', elements("informational"), "]}")


# -------------------------------------------------------------------------------------- SARIF


def sarif_results(findings: DataFrame, prefix: str = PREFIX, keep: tuple[str, ...] = ()) -> DataFrame:
    """One SARIF result for each finding: rule_id and json, beside the columns in ``keep``. Lines begin at 1, messages end at 2000 characters."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")], F.lit("warning"))
    rule = sarif_rule_id(prefix)
    region = F.struct(F.greatest(F.lit(1), "line_start").alias("startLine"), F.greatest(F.lit(1), "line_end").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_rel").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.substring(F.concat("title", F.lit(": "), "description"), 1, 2000)
    named = ["votes", "reachable", "hedged", "source", "status", *(c for c in ("sample_request",) if c in findings.columns)]
    properties = F.struct("severity", F.round("confidence", 2).alias("confidence"), *named)
    result = F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), properties.alias("properties"))
    return findings.select(*keep, rule.alias("rule_id"), F.to_json(result).alias("json"))


def sarif_rules(findings: DataFrame, by: str = "place", prefix: str = PREFIX) -> DataFrame:
    """(rule_id, place, json): each rule as its first finding describes it, at that finding's place."""
    text = F.coalesce(F.nullif("title", F.lit("")), "category")
    cwe, owasp = (F.coalesce(c, F.lit("")) if c in findings.columns else F.lit("") for c in ("cwe", "owasp"))
    own = F.struct(sarif_rule_id(prefix).alias("id"), F.col("category").alias("name"), F.struct(text.alias("text")).alias("shortDescription"), F.struct(cwe.alias("cwe"), owasp.alias("owasp")).alias("properties"))
    first = findings.select(F.col(by).alias("place"), own.alias("own")).groupBy(F.col("own.id").alias("rule_id")).agg(F.min("place").alias("place"), F.min_by("own", "place").alias("own"))
    return first.select("rule_id", "place", F.to_json("own").alias("json"))


def report_sarif(findings: DataFrame) -> DataFrame:
    own = ordered(findings).drop("print_")
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","rules":['
    rules = listed(sarif_rules(own).select("place", F.col("json").alias("text")))
    return assembled(findings.sparkSession, head, rules, ']}},"results":[', listed(sarif_results(own, keep=("place",)).select("place", F.col("json").alias("text"))), "]}]}")


# ----------------------------------------------------------------------------------- Markdown


def coverage_note(coverage: float) -> str:
    return "Coverage complete (100%)." if coverage >= 1.0 else f"⚠ COVERAGE INCOMPLETE ({coverage * 100:.1f}%): some cells did not reach the thoroughness bar."


def _two_places(x: str) -> Column:
    """A number with two places, as ``%.2f`` has it, which is slow and left for what the decimal does not hold or has no sign for."""
    x = F.col(x)
    return F.when((x > 0) & (x < 1000000), x.cast("decimal(9,2)").cast("string")).otherwise(F.format_string("%.2f", x))


def finding_section(findings: DataFrame) -> Column:
    """The lines of one finding. Parts without content are left out. A fingerprint told before (``print_``) is not made again."""
    c = F.concat
    n_a = lambda name: F.coalesce(F.nullif(name, F.lit("")), F.lit("n/a")) if name in findings.columns else F.lit("n/a")
    some = lambda name, *lines: F.when(F.coalesce(name, F.lit("")) != "", c(*lines))
    own = F.col("print_") if "print_" in findings.columns else fingerprint()
    parts = [
        c(F.lit("### `F-"), F.substring(own, 1, 8), F.lit("` — ["), F.upper("severity"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), "category")),
        c(F.lit("- **Location:** `"), "file_rel", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("`")),
        c(F.lit("- **Category:** "), "category", F.lit("  |  **CWE:** "), n_a("cwe"), F.lit("  |  **OWASP:** "), n_a("owasp")),
        c(F.lit("- **Confidence:** "), _two_places("confidence"), F.lit("  |  **Votes:** "), F.col("votes").cast("string"), F.lit("  |  **Reachable:** "), "reachable", F.lit("  |  **Source:** "), "source"),
        c(F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\n")),
        some("cited_snippet", F.lit("```\n"), F.col("cited_snippet"), F.lit("\n```\n")),
        some("remediation", F.lit("**Remediation:** "), F.col("remediation"), F.lit("\n")),
    ]
    if "sample_request" in findings.columns:
        s = F.col("sample_request")
        told = F.filter(F.array(s["payload_note"], c(F.lit("derivation: "), F.nullif(s["derivation"], F.lit(""))), c(F.lit("from "), F.nullif(s["citation"], F.lit("")))), lambda x: F.coalesce(x, F.lit("")) != "")
        after = F.when(F.size(told) > 0, c(F.lit("_"), F.array_join(told, " · "), F.lit("_\n"))).otherwise("")
        parts.insert(6, F.when(F.coalesce(s["curl"], F.lit("")) != "", c(F.lit("**Sample attack request** ("), F.coalesce(s["method"], F.lit("")), F.lit(" "), F.coalesce(s["path"], F.lit("")), F.lit("):\n```bash\n"), s["curl"], F.lit("\n```\n"), after)))
    return F.concat_ws("\n", *parts)


def report_markdown(findings: DataFrame, coverage: float, stats: tuple[str, ...] = ()) -> DataFrame:
    """Reachable findings by urgency, then, under a heading of their own if there are any, those that nothing outside reaches."""
    spark = findings.sparkSession
    far = F.col("reachable") == "unreachable"

    # both parts are dealt and sorted in one pass
    own = ordered(findings.withColumn("far_", F.coalesce(far, F.lit(False))), urgent_first=True, apart="far_")
    near, away = (own.filter(c).select("place", finding_section(own).alias("text")) for c in (~F.col("far_"), F.col("far_")))
    none = near.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).alias("place"), F.lit("_None._").alias("text"))
    apart = "\n---\n\n## Informational — not externally reachable\n\n_No path from an external entry point leads here: code hygiene, in no count and no gate._\n"
    heading = away.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(0).alias("place"), F.lit(apart).alias("text"))
    head = "\n".join(["# Vulnerability Scan Report", "", *stats, coverage_note(coverage), "", "## Reachable findings", ""])
    return assembled(spark, head, near, none, heading, away)


def executive_summary(findings: DataFrame, coverage: float, suppressed: int = 0, baselined: int = 0, stats: tuple[str, ...] = ()) -> DataFrame:
    """Counts by severity and reachability, as one line of a document."""
    counts = severity_counts(findings).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("reachable"), F.lit(0)).alias("reached"), *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITIES]
    )
    text = F.format_string(
        "\n".join(["# Executive Summary", "", coverage_note(coverage).replace("%", "%%"), "", "- **Total reportable findings:** %d (%d exploitable + %d informational)", "- Critical: %d | High: %d | Medium: %d | Low: %d | Informational: %d", "- **Reachable (attacker-exposed):** %d", f"- Suppressed: {suppressed} | In baseline (not new): {baselined}", "", *(s.replace("%", "%%") for s in stats), "Findings are judgments of models, checked by citation, review and reachability; no code was run."]),
        "total", F.col("total") - F.col("informational"), "informational", *SEVERITIES, "reached",
    )
    return assembled(findings.sparkSession, counts.select(F.lit(0).alias("place"), text.alias("text")))


def write_reports(gated: DataFrame, path: str, formats: set[str], about: dict, coverage: float, stats: tuple[str, ...] = (), files: int | None = None) -> dict[str, int]:
    """Every asked format of findings with their ``gate``, each in a folder of its own; the four counts of the gate.

    The executive summary is written with Markdown, or where it is asked for by name.
    """
    if unknown := formats - FORMATS:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    n = {r["gate"]: r["count"] for r in gated.groupBy("gate").count().collect()}
    counts = {k: n.get(k, 0) for k in ("reportable", "informational", "suppressed", "baselined")}
    tiers = [gated.filter(F.col("gate") == g).drop("gate") for g in ("reportable", "informational")]
    shown = tiers[0].unionByName(tiers[1])
    hidden = (counts["suppressed"], counts["baselined"])
    if "json" in formats:
        write_document(report_json(*tiers, about, coverage, *hidden), f"{path}/report.json", files)
    if "sarif" in formats:
        write_document(report_sarif(shown), f"{path}/report.sarif", files)
    if "markdown" in formats:
        write_document(report_markdown(shown, coverage, stats), f"{path}/report.md", files)
    if formats & {"markdown", "exec_summary"}:
        write_document(executive_summary(shown, coverage, *hidden, stats), f"{path}/executive_summary.md", 1)
    return counts
