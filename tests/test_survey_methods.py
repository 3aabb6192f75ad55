"""Reachability gate, replaced functions, sanitised texts and unwrapped replies on small fixtures."""

import json

import pytest

from lodestone.operators import detect, graph, ledger, replies


def test_reachability_gate(spark):
    edges = spark.createDataFrame([("b", "a"), ("x", "y")], "callee string, caller string")
    entries = spark.createDataFrame([("a",)], "name string")
    f = spark.createDataFrame([(1, "b", "unclear"), (2, "y", "reachable"), (3, "x", "prior"), (4, None, "prior")], "ord long, name string, reachable string")
    got = {h: {r.ord: (r.reachable, r.demoted, r.note is not None) for r in graph.gated(f, edges, entries, h).collect()} for h in ("informational", "hide", "report")}
    kept = {1: ("reachable", False, False), 3: ("prior", False, False), 4: ("prior", False, False)}
    assert got["hide"] == kept and got["informational"] == {**kept, 2: ("unreachable", True, True)}
    assert got["report"] == {1: ("unclear", False, False), 2: ("reachable", False, False), 3: kept[3], 4: kept[4]}
    with pytest.raises(ValueError):
        graph.gated(f, edges, entries, "odd")


def test_replaced_functions(spark):
    ddl = "path string, name string, start_line int, end_line int"
    old = spark.createDataFrame([("a", "f", 1, 5, True), ("a", "g", 7, 9, True), ("b", "h", 1, 2, True), ("c", "k", 1, 2, True)], ddl + ", visited boolean")
    new = spark.createDataFrame([("a", "f", 1, 6), ("a", "g", 8, 9)], ddl)
    indexed = spark.createDataFrame([("a",), ("c",)], "path string")
    got = {resume: sorted(tuple(r) for r in ledger.replaced_functions(old, indexed, new, resume).collect()) for resume in (True, False)}
    for resume in got:
        assert got[resume] == [("a", "f", 1, 6, resume), ("a", "g", 8, 9, False), ("b", "h", 1, 2, True)]


def test_sanitised_texts(spark):
    secret = 'password = "hunter2000"'
    texts = {"p/x.ENV": "k=1", "a.py": f"x\r\n{secret}\n\ny\n", "b.py": "one\n\n", "c.py": ""}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {m: {r.path: (r.text, r.n_masked, r.blocked) for r in detect.sanitised(df, m).collect()} for m in ("off", "redact", "block")}
    assert got["off"] == {p: (t, 0, False) for p, t in texts.items()}
    for m in ("redact", "block"):
        assert got[m]["b.py"] == ("one\n", 0, False) and got[m]["c.py"] == ("", 0, False)
        assert got[m]["p/x.ENV"][0].startswith("[QUARANTINED") and got[m]["p/x.ENV"][2] == (m == "block")
    text, n, blocked = got["redact"]["a.py"]
    assert text.startswith("x\n") and text.endswith("\n\ny") and "hunter" not in text and (n, blocked) == (1, False)
    assert got["block"]["a.py"][0].startswith("[BLOCKED") and got["block"]["a.py"][1:] == (1, True)


def test_unwrapped_replies(spark):
    t = {"title": "t"}
    cases = [
        ([t, t], 2, True), ([[t]], 1, True), (t, 1, True), ({}, 0, True), ([], 0, True), ({"a": 1}, 0, False), (7, 0, False),
        ({"other": [t]}, 1, True), ({"a": [t], "b": [t]}, 0, False), ([t, 3], 1, False), ({"a": [t], "data": [t, t]}, 2, True),
        *[({k: [t]}, 1, True) for k in ("findings", "vulnerabilities", "vulns", "issues", "results", "items", "data")],
    ]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(99, None), (98, "{")]
    got = replies.items(spark.createDataFrame(rows, "id int, json string"), "struct<title string>").collect()
    for i, n, ok in [(i, c[1], c[2]) for i, c in enumerate(cases)] + [(99, 0, False), (98, 0, False)]:
        mine = [r for r in got if r.id == i]
        assert len(mine) == max(1, n) and all(r.shape_ok == ok for r in mine)
        assert [r.item.title for r in mine if r.item] == ["t"] * n
