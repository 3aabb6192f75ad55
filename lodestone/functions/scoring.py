"""Severity, confidence and identity of findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import as_col

# Default CWE and OWASP class of each category.
CATEGORIES = {
    "injection": ("CWE-89", "A03:2021-Injection"),
    "xss": ("CWE-79", "A03:2021-Injection"),
    "authz": ("CWE-285", "A01:2021-Broken Access Control"),
    "authn": ("CWE-287", "A07:2021-Identification and Authentication Failures"),
    "crypto": ("CWE-327", "A02:2021-Cryptographic Failures"),
    "deserialization": ("CWE-502", "A08:2021-Software and Data Integrity Failures"),
    "ssrf": ("CWE-918", "A10:2021-Server-Side Request Forgery"),
    "path_traversal": ("CWE-22", "A01:2021-Broken Access Control"),
    "secrets": ("CWE-798", "A07:2021-Identification and Authentication Failures"),
    "logic": ("CWE-840", "A04:2021-Insecure Design"),
    "misconfig": ("CWE-16", "A05:2021-Security Misconfiguration"),
    "csrf": ("CWE-352", "A01:2021-Broken Access Control"),
}
# Severity floors, high to low, and the factors of reachability.
FLOORS = {"critical": 0.85, "high": 0.65, "medium": 0.4, "low": 0.05, "informational": 0.0}
REACH = {"reachable": 1.0, "unclear": 0.7, "unreachable": 0.4}
# Words for a confidence.
CONFIDENCE_WORDS = {"very high": 0.95, "high": 0.8, "medium": 0.5, "moderate": 0.5, "low": 0.3, "very low": 0.15, "certain": 0.95, "unsure": 0.3}
SEVERITY_ALIASES = {"info": "informational", "informational/low": "informational", "moderate": "medium", "severe": "high", "crit": "critical"}

# Words for the severity of an organisation's rules.
RULE_SEVERITIES = {"info": "informational", "informational": "informational", "low": "low", "minor": "low", "medium": "medium", "moderate": "medium", "high": "high", "major": "high", "severe": "high", "critical": "critical", "crit": "critical", "blocker": "critical"}


def lookup(x: Column, table: dict, default) -> Column:
    """Value of a small fixed table; ``default`` (a column or literal) for other keys and null."""
    chain = reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(x == next(iter(table)), F.lit(next(iter(table.values())))))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def merge_rank(severity: str | Column) -> Column:
    """Rank for merging: informational and unknown are both 0."""
    return lookup(F.lower(as_col(severity)), {"low": 1, "medium": 2, "high": 3, "critical": 4}, 0)


def gate_rank(severity: str | Column, unknown: int) -> Column:
    """Rank for thresholds: informational 0 to critical 4, ``unknown`` for anything else."""
    return lookup(F.lower(as_col(severity)), {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}, unknown)


def scored_severity(base: str | Column, reachable: str | Column) -> Column:
    base, reachable = F.lower(as_col(base)), as_col(reachable)
    start = lookup(base, {k: v + 0.1 for k, v in FLOORS.items()}, 0.05)
    score = start * lookup(reachable, REACH, 0.7)
    bucket = F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.4, "medium").when(score >= 0.05, "low").otherwise("informational")
    return F.when((reachable == "unreachable") | (base == "informational"), "informational").otherwise(bucket)


def scored_confidence(base: Column, votes: Column, hedged: Column, language: Column | None = None) -> Column:
    c = base + F.least(F.lit(0.3), 0.05 * F.greatest(F.lit(0), votes - 1)) - F.when(hedged, 0.2).otherwise(0.0)
    if language is not None:
        c = c - F.when(language.isin("c", "cpp"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def location_token(symbol: str | Column = "symbol", line_start: str | Column = "line_start") -> Column:
    symbol = as_col(symbol)
    return F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("sym:"), symbol)).otherwise(F.concat(F.lit("blk:"), F.floor(as_col(line_start) / 25).cast("long").cast("string")))


def fingerprint(of: Callable[[str], Column] = F.col) -> Column:
    """``of`` gives a finding's fields by their names."""
    parts = F.concat_ws("|", of("file_rel"), of("category"), F.coalesce(of("cwe"), F.lit("")), location_token(of("symbol"), of("line_start")))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 16)


def location_key() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "file_rel", "category", location_token()).cast("binary"), 256), 1, 16)


def sarif_rule_id(prefix: str) -> Column:
    """The rule of a finding: its CWE, or its category where it has none."""
    cwe = F.coalesce("cwe", F.lit(""))
    named = F.when(cwe != "", F.replace(cwe, F.lit("CWE-"), F.lit("CWE"))).otherwise(F.replace(F.upper("category"), F.lit("/"), F.lit("_")))
    return F.concat(F.lit(f"{prefix}-"), named)


def confidence_of(raw: str | Column) -> Column:
    """A reply's confidence, given as text, as a number from 0 to 1; 0.5 if it is none."""
    low = F.lower(F.trim(as_col(raw)))
    number = F.regexp_replace(low, r"\s*%+$", "").try_cast("double")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100))
    scale = F.when(number > 100, 1.0).when(number > 10, share).when(number > 1, 1.0).otherwise(F.greatest(F.lit(0.0), number))
    value = F.when(low.endswith("%"), share).otherwise(scale)
    return lookup(low, CONFIDENCE_WORDS, F.when(low.isNull() | low.isin("", "true", "false") | number.isNull() | F.isnan(number), 0.5).otherwise(value))


def severity_of(raw: str | Column, default: str = "medium") -> Column:
    low = F.lower(F.trim(F.coalesce(as_col(raw), F.lit(""))))
    return F.when(low.isin(list(FLOORS)), low).otherwise(lookup(low, SEVERITY_ALIASES, default))


def rule_severity_of(raw: str | Column) -> Column:
    """The severity that a rule gives, in words of its own; medium for any other."""
    return lookup(F.lower(F.trim(F.coalesce(as_col(raw), F.lit("")))), RULE_SEVERITIES, "medium")
