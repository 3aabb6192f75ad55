"""Accounts of a run: what was skipped, entered, settled and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import fingerprint
from lodestone.functions.text import as_col, squeezed
from lodestone.operators import findings as merging
from lodestone.operators import gate, symbols
from lodestone.plans.lineage import sound_unions


def skip_reasons(files: DataFrame) -> DataFrame:
    return files.filter("skip_reason is not null").groupBy("skip_reason").count()


def language_support(files: DataFrame, supported: list[str]) -> DataFrame:
    """One row: files of a supported language, others, and the sorted names of unsupported languages."""
    known = F.col("language").isin(supported)
    return files.agg(F.count_if(known).alias("supported"), F.count_if(~known).alias("others"), F.array_sort(F.collect_set(F.when(~known, F.col("language")))).alias("unsupported"))


def entry_points(surface: DataFrame, ranges: DataFrame) -> DataFrame:
    """Names of the functions around (or just below) a source of the attack surface."""
    points = surface.filter("kind = 'source'").select("path", "line_no").distinct()
    return symbols.enclosing(points, ranges).filter("symbol is not null").select(F.col("symbol").alias("name")).distinct()


def weighted(files: DataFrame, boundary: DataFrame) -> DataFrame:
    """Weight (path, weight) raised by 1 for files at a trust boundary."""
    raised = boundary.select("path").distinct().withColumn("raised", F.lit(1.0))
    return files.join(raised, "path", "left").withColumn("weight", F.col("weight") + F.coalesce("raised", F.lit(0.0))).drop("raised")


def by_weight(files: DataFrame) -> DataFrame:
    """Files with the most weight first, then by path."""
    return files.orderBy(F.desc("weight"), "path")


def cell_ranges(cells: DataFrame, chunks: DataFrame, files: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Lines of every cell: its chunk's as stored, else those of ``derived`` chunks (found anew by symbols), else the whole file's."""
    place = ["path", "chunk_index"]
    out = cells.join(chunks.select(*place, "start_line", "end_line"), place, "left").join(files.select("path", "n_lines"), "path", "left")
    if derived is not None:
        anew = derived.select(*place, F.col("start_line").alias("start_"), F.col("end_line").alias("end_"))
        known = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
        out = out.join(anew, place, "left").withColumns({"start_line": F.when(known, F.col("start_line")).otherwise(F.col("start_")), "end_line": F.when(known, F.col("end_line")).otherwise(F.col("end_"))}).drop("start_", "end_")
    return out.withColumn("start_line", F.coalesce("start_line", F.lit(1))).withColumn("end_line", F.coalesce("end_line", F.greatest(F.lit(1), "n_lines"))).drop("n_lines")


def hints(surface: DataFrame, kind: str, most: int) -> DataFrame:
    """The first hits of a kind, by file and line, as a prompt tells them."""
    first = surface.filter(F.col("kind") == kind).orderBy("path", "line_no", "label").limit(most)
    return first.select("path", "line_no", F.concat(F.lit("  "), F.col("label"), F.lit(" "), F.col("path"), F.lit(":"), F.col("line_no").cast("string")).alias("hint"))


def settled_union(*parts: DataFrame) -> DataFrame:
    """Findings of several tiers (validated, skipped, demoted) as one, folded by fingerprint."""
    sound_unions(parts[0].sparkSession)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merging.merge_findings(out)


def without_superseded(stored: DataFrame, merged: DataFrame) -> DataFrame:
    """Stored findings (dedup_key) but those that a fold left behind."""
    stale = merged.select(F.explode("superseded").alias("dedup_key")).join(merged.select(F.col("key").alias("dedup_key")), "dedup_key", "left_anti").distinct()
    return stored.join(stale, "dedup_key", "left_anti")


def of_rules(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings out of rule hits (path, line_no, rule_id, cwe, severity, snippet)."""
    low = F.lower("rule_id")
    category = F.when(low.contains("config"), "misconfig").when(low.contains("secret"), "secrets").otherwise("logic")
    f = symbols.enclosing(hits, ranges)
    return f.select(F.col("path").alias("file_rel"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), category.alias("category"), F.col("rule_id").alias("title"), "severity", F.lit(0.9).alias("confidence"), "cwe", F.col("snippet").alias("cited_snippet"), F.lit("rule").alias("source"), F.coalesce("symbol", F.lit("")).alias("symbol"))


def secret_findings(masked: DataFrame) -> DataFrame:
    """A finding for each line (path, line_no, masked, n_masked) with something masked; the text shown is the masked one."""
    # a generated row keeps the filter from repeating the masking
    kept = masked.select("path", "line_no", F.explode(F.array(F.struct("masked", "n_masked"))).alias("m")).select("path", "line_no", "m.*").filter("n_masked > 0")
    return kept.select(F.col("path").alias("file_rel"), F.col("line_no").alias("line_start"), F.lit("secrets").alias("category"), F.lit("CWE-798").alias("cwe"), F.col("n_masked").cast("int").alias("n_secrets"), F.substring(squeezed("masked"), 1, 200).alias("cited_snippet"))


def sample_candidates(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings for which a sample request is worth the effort: not refuted, not unreachable, of a file with text."""
    with_text = files.filter("text <> ''").select(F.col("path").alias("file_rel"))
    return findings.filter("status <> 'false_positive' and reachable <> 'unreachable'").join(with_text, "file_rel", "left_semi")


def provable(findings: DataFrame) -> DataFrame:
    return findings.filter("status in ('confirmed', 'new') and reachable <> 'unreachable'")


def refused_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, pattern) that repeat a group that repeats inside: matching them may never end."""
    return rules.filter(F.col("pattern").rlike(r"\([^()]*[+*]\)\s*[+*]"))


def scopes(areas: DataFrame, most: int = 50) -> DataFrame:
    """(ord, scope): the first ``most`` different scopes that look like a path, in order."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("scope", F.lit(""))), r"\\", "/"), r"^(\./)+", ""), "^/+|/+$", "")
    a = areas.select("ord", s.alias("scope")).filter("scope <> '' and not contains(scope, '..') and (contains(scope, '/') or contains(scope, '.'))")
    return a.groupBy("scope").agg(F.min("ord").alias("ord")).orderBy("ord", "scope").limit(most).select("ord", "scope")


def attack_classes(spark, flat: list[str], groups: dict[str, list[str]] | None = None, open_ended: bool = False) -> DataFrame:
    """(attack_class): one for each group if there are groups, else the flat ones; ``all`` where the hunt is open-ended."""
    names = [",".join(v) for v in groups.values() if v] if groups else list(dict.fromkeys(flat))
    return spark.createDataFrame([(n,) for n in [*names, *(["all"] if open_ended or not names else [])]], "attack_class string")


def harvested(reports: DataFrame) -> DataFrame:
    """Different fingerprints of report rows (json)."""
    # a generated row keeps the filter from making the JSON once more
    told = reports.select(F.explode(F.array(F.get_json_object("json", "$.fingerprint"))).alias("fingerprint"))
    return told.filter("fingerprint is not null").distinct()


def baseline_rows(fingerprints: DataFrame) -> DataFrame:
    """The entries of a baseline file, one JSON line each, in order; ``write.text`` stores them in parallel."""
    f = fingerprints.select("fingerprint").filter("fingerprint is not null").distinct()
    return f.select("fingerprint", F.to_json(F.struct(F.lit(2).alias("fingerprint_scheme"), F.array("fingerprint").alias("fingerprints"))).alias("json"))


def runtime(seconds: str | Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = F.greatest(F.lit(0), F.floor(as_col(seconds))).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def money(amount: str | Column) -> Column:
    return F.format_string("$%,.2f", as_col(amount).cast("double"))


def run_stats(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens, cost and time from the first call to the last, also as text."""
    tokens = sum((F.sum(F.coalesce(f"{k}_tokens", F.lit(0))) for k in ("output", "cache_read", "cache_write")), F.sum(F.coalesce("input_tokens", F.lit(0))))
    s = calls.agg(F.count("*").alias("calls"), tokens.alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp")), F.lit(0)).alias("seconds"))
    return s.withColumn("line", F.concat(F.format_string("%,d", "tokens"), F.lit(" tokens, "), money("cost"), F.lit(", "), runtime("seconds")))


def summary(gates: DataFrame, coverage: float) -> DataFrame:
    """One row of counts for a report's head: gated tiers (gate, severity, reachable) and the note on coverage.

    Works on whatever is there, so a run that was broken off is closed by the same rows.
    """
    told = F.col("gate").isin("reportable", "informational")
    counts = [F.count_if(F.col("gate") == g).alias(g) for g in ("reportable", "informational", "suppressed", "baselined")]
    levels = [F.count_if(told & (F.col("severity") == s)).alias(s) for s in ("critical", "high", "medium", "low")]
    note = "Coverage complete (100%)." if coverage >= 1 else f"⚠ COVERAGE INCOMPLETE ({coverage * 100:.1f}%). Some cells were not analyzed to the thoroughness bar — see audit log for gaps."
    return gates.agg(*counts, *levels, F.count_if(told & (F.col("reachable") == "reachable")).alias("reachable")).withColumn("note", F.lit(note))


def finalised(findings: DataFrame, baseline: DataFrame | None, suppressions: DataFrame | None, now: float, threshold: str = "medium") -> DataFrame:
    """Findings at the end of a run, whole or broken off: scored, folded again, gated (``gate``, ``fingerprint``).

    Nothing is kept between calls, so the same findings give the same rows however often it is called. Without a baseline or
    suppressions that can be read (None) the gate fails closed. A folded finding has the status of its first one (by ord).
    """
    status = findings.withColumn("status", F.coalesce("status", F.lit("new")))
    scored = merging.enriched(status).drop("base_severity", "base_confidence")
    folded = merging.merge_findings(scored)
    first = scored.select(fingerprint().alias("key"), "ord", "status").groupBy("key").agg(F.min(F.struct("ord", "status")).alias("x"))
    out = folded.drop("status").join(first.select("key", "x.status"), "key").withColumn("fingerprint", F.col("key"))
    if baseline is None or suppressions is None:
        return gate.fail_closed(out, threshold)
    return gate.gated(out, baseline, suppressions, now, threshold)


def documents_of(gates: DataFrame, formats: list[str]) -> DataFrame:
    """Findings of each report format: json keeps its tiers apart, sarif and markdown tell reportable and informational ones."""
    told = gates.filter("gate in ('reportable', 'informational')").withColumn("fingerprint", fingerprint())
    return told.withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats]).cast("array<string>")))


def tool_counts(turns: DataFrame) -> DataFrame:
    """Turns, tool calls, errors and successes of each conversation; turns have (conv_id, role, text).

    A tool's result is an error if its text begins with ``[error]``.
    """
    tool = F.col("role") == "tool"
    failed = tool & F.startswith("text", F.lit("[error]"))
    out = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(tool).alias("calls"), F.count_if(failed).alias("errors"))
    return out.withColumn("successful", F.col("calls") - F.col("errors"))


def last_text(turns: DataFrame, role: str) -> DataFrame:
    """(conv_id, turn, text) of the latest turn of a role; text joins the text blocks of the turn (array ``blocks``)."""
    said = turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.max_by(F.struct("turn", "blocks"), F.struct("turn", "blocks")).alias("x"))
    return said.select("conv_id", "x.turn", F.array_join(F.filter("x.blocks", lambda b: b.isNotNull()), "").alias("text"))


def one_line(text: str | Column, most: int = 120) -> Column:
    return F.substring(squeezed(F.coalesce(as_col(text), F.lit(""))), 1, most)


def resumable(stored_hash: str | None, config_hash: str, force: bool = False) -> bool:
    """May a run go on from its checkpoint? Only with the same configuration, or if told to."""
    return stored_hash is not None and (force or stored_hash == config_hash)
