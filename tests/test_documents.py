"""Whole report documents against small loops, and read back."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.scoring import fingerprint
from lodestone.plans.lineage import placed
from lodestone.sources import documents, reports

RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "informational": 4}


@pytest.fixture(scope="module")
def findings(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        rows.append((f"src/{rng.choice('abc')}.py", rng.randint(-1, 9), rng.randint(10, 12), rng.choice(["xss", "novel/other"]), rng.choice(["", "CWE-79", "CWE-89"]), rng.choice([*RANK, "odd"]), rng.randint(0, 100) / 100, 1, bool(i % 2), rng.choice(["reachable", "unclear", "unreachable"]), rng.choice(["new", "confirmed"]), "llm", rng.choice(["", f'T "{i}" – é']), "d" * rng.choice([0, 3, 2500]), rng.choice(["", "a\nb"]), f"s{i}", rng.choice(["", "fix it"]), "A03"))
    schema = "file_rel string, line_start int, line_end int, category string, cwe string, severity string, confidence double, votes int, hedged boolean, reachable string, status string, source string, title string, description string, cited_snippet string, symbol string, remediation string, owasp string"
    return spark.createDataFrame(rows, schema).repartition(5)


def text_of(folder):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*")))


def test_place_is_the_position(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k int, v int").repartition(7)
    rows = placed(df, "k", "v").collect()
    assert sorted(r.place for r in rows) == list(range(1000))
    assert [r.place for r in sorted(rows, key=lambda r: (r.k, r.v))] == list(range(1000))
    assert placed(df.limit(0), "k").count() == 0


def test_markdown(findings, tmp_path):
    def section(f):
        lines = [f"### `F-{f.p[:8]}` — [{f.severity.upper()}] {f.title or f.category}", f"- **Location:** `{f.file_rel}:{f.line_start}-{f.line_end}`", f"- **Category:** {f.category}  |  **CWE:** {f.cwe or 'n/a'}  |  **OWASP:** {f.owasp or 'n/a'}"]
        lines += [f"- **Confidence:** {f.confidence:.2f}  |  **Votes:** {f.votes}  |  **Reachable:** {f.reachable}  |  **Source:** {f.source}", "", f.description, ""]
        lines += ["```", f.cited_snippet, "```", ""] if f.cited_snippet else []
        return lines + ([f"**Remediation:** {f.remediation}", ""] if f.remediation else [])

    rows = sorted(findings.withColumn("p", fingerprint()).collect(), key=lambda f: (RANK.get(f.severity, 9), f.file_rel, f.line_start, f.category, f.p, f.line_start, f.line_end, f.severity, f.title, f.description, f.confidence, f.reachable, f.cited_snippet))
    lines = ["# Vulnerability Scan Report", "", "ran 3 calls", "⚠ COVERAGE INCOMPLETE (25.0%): some cells did not reach the thoroughness bar.", "", "## Reachable findings", ""]
    for f in rows:
        lines += section(f) if f.reachable != "unreachable" else []
    lines += ["", "---", "", "## Informational — not externally reachable", "", "_No path from an external entry point leads here: code hygiene, in no count and no gate._", ""]
    for f in rows:
        lines += section(f) if f.reachable == "unreachable" else []
    documents.write_document(documents.report_markdown(findings, 0.25, ("ran 3 calls",)), str(tmp_path / "md"))
    assert text_of(tmp_path / "md") == "\n".join(lines) + "\n"
    documents.write_document(documents.report_markdown(findings.limit(0), 1.0), str(tmp_path / "none"))
    assert text_of(tmp_path / "none").endswith("## Reachable findings\n\n_None._\n")


def test_sample_requests(findings):
    s = "named_struct('method', 'GET', 'path', '/a', 'curl', if(votes = 1, 'curl x', ''), 'payload_note', 'n', 'derivation', '', 'citation', 'c:1')"
    text = findings.withColumn("sample_request", F.expr(s)).select(documents.finding_section(findings.withColumn("sample_request", F.expr(s))).alias("t")).first().t
    assert "\n**Sample attack request** (GET /a):\n```bash\ncurl x\n```\n_n · from c:1_\n" in text
    bare = findings.withColumn("sample_request", F.expr(s.replace("'curl x'", "''")))
    assert "Sample attack" not in bare.select(documents.finding_section(bare).alias("t")).first().t


def test_sarif_is_read_back(spark, findings, tmp_path):
    documents.write_document(documents.report_sarif(findings), str(tmp_path / "s"), 3)
    text = text_of(tmp_path / "s")
    doc = json.loads(text)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 60
    results, rules = doc["runs"][0]["results"], doc["runs"][0]["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == list(dict.fromkeys(r["ruleId"] for r in results))
    assert {r["ruleId"] for r in results} <= {"LODE-CWE79", "LODE-CWE89", "LODE-XSS", "LODE-NOVEL_OTHER"}
    places = [(p["artifactLocation"]["uri"], p["region"]["startLine"]) for r in results for p in [r["locations"][0]["physicalLocation"]]]
    assert places == sorted(places) and min(n for _, n in places) == 1
    assert max(len(r["message"]["text"]) for r in results) == 2000 and all(r["properties"]["votes"] == 1 for r in results)
    back = reports.seeds(spark.createDataFrame([(text,)], "json string"))
    want = findings.selectExpr("file_rel", "greatest(1, line_start) as line_start", "case when severity in ('critical', 'high') then 'high' when severity in ('low', 'informational') then 'low' else 'medium' end as severity", "cwe")
    assert sorted(map(tuple, back.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_all_formats(spark, findings, tmp_path):
    gated = findings.withColumn("gate", F.when(F.col("reachable") == "unreachable", "informational").when(F.col("severity") == "low", "suppressed").otherwise("reportable"))
    n = {r["gate"]: r["count"] for r in gated.groupBy("gate").count().collect()}
    counts = documents.write_reports(gated, str(tmp_path), {"json", "markdown", "sarif"}, {"config_hash": "c"}, 1.0)
    assert counts == {**n, "baselined": 0}
    doc = json.loads(text_of(tmp_path / "report.json"))
    assert doc["finding_count"] == len(doc["findings"]) == n["reportable"] and doc["informational_count"] == len(doc["informational"]) == n["informational"]
    assert doc["suppressed_count"] == n["suppressed"] and doc["coverage_complete"] and {f["reachable"] for f in doc["informational"]} == {"unreachable"}
    assert all(f["id"] == "F-" + f["fingerprint"][:8] for f in doc["findings"])
    summary = text_of(tmp_path / "executive_summary.md")
    assert f"- **Total reportable findings:** {n['reportable'] + n['informational']} (" in summary and f"- Suppressed: {n['suppressed']} | In baseline (not new): 0" in summary
    empty = documents.write_reports(gated.limit(0), str(tmp_path / "e"), {"json", "exec_summary"}, {}, 0.0)
    assert set(empty.values()) == {0} and json.loads(text_of(tmp_path / "e" / "report.json"))["findings"] == []
    assert not (tmp_path / "e" / "report.md").exists() and (tmp_path / "e" / "executive_summary.md").exists()
    with pytest.raises(ValueError):
        documents.write_reports(gated, str(tmp_path), {"pdf"}, {}, 1.0)


def test_parts_are_placed_by_themselves(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i, i % 5 == 0) for i in range(1000)], "k int, v int, far boolean").repartition(7)
    for far in (False, True):
        rows = sorted((r for r in placed(df, "k", "v", apart="far").collect() if r.far == far), key=lambda r: (r.k, r.v))
        assert [r.place for r in rows] == list(range(200 if far else 800))
    assert placed(df.limit(0), "k", apart="far").count() == 0


@pytest.mark.parametrize("made", [lambda f: documents.report_markdown(f, 1.0), lambda f: documents.report_json(f.filter("votes = 1"), f.filter("votes = 2"), {}, 1.0)])
def test_a_report_is_dealt_once(findings, monkeypatch, made):
    dealt = []
    monkeypatch.setattr(documents, "placed", lambda *a, **k: dealt.append(1) or placed(*a, **k))
    assert made(findings).count() > 60 and len(dealt) == 1


def test_confidence_has_two_places(spark, findings):
    some = [0.0, -0.0, 0.005, 0.125, 0.135, 0.994999, 1.005, 2.675, -1.005, 999999.994, 999999.996, 1e7, float("nan"), float("inf"), 1e-9, *(i / 1000 for i in range(1000))]
    x = spark.createDataFrame([(v,) for v in some], "x double").select(documents._two_places("x").alias("mine"), F.format_string("%.2f", "x").alias("java"))
    assert x.filter("mine <> java").count() == 0
