"""Replies with brackets in strings, snippets of several lines, merges of tied rows, routes against a walk."""

import random

from lodestone.operators import findings, graph, replies


def test_json_of_awkward_replies():
    f = replies.json_of
    assert f('so {"title": "missing } here", "line": 3} it is') == '{"title": "missing } here", "line": 3}'
    assert f('{"code": "if (a[0) {"}') == '{"code": "if (a[0) {"}'
    assert f('x [{"a": 1}] ' + "]" * 12) == '[{"a": 1}]'
    assert f('{"a": 1} then {}') == '{"a": 1}'
    assert f('{"v": "NO"} no {"v": "YES"}') == '{"v": "YES"}'
    assert f("see [1]\n```json\n[{\"b\": 2}]\n```") == '[{"b": 2}]'
    assert f("no value") is None and f(None) is None and f("[" * 5000) is None


def test_snippets_of_several_lines(spark):
    lines = spark.createDataFrame([("a.py", i + 1, x) for i, x in enumerate(["def f(x):", "    y = g(x)", "    return  y", "", "print(f(1))", "z"])], "path string, line_no int, line string")
    claims = [("two", 2, 2, "def f(x):\n  y = g(x)"), ("late", 5, 4, "return y"), ("far", 6, 6, "def f(x):"), ("word", 6, 6, "z"), ("odd", 6, 6, "1_a"), ("none", 1, 1, " "), ("wide", 1, 3, "y = g(x) return y")]
    df = spark.createDataFrame([(c, "a.py", a, b, s) for c, a, b, s in claims], "claim_id string, path string, lo int, hi int, snippet string")
    got = {r.claim_id: (r.found_at, r.found_to) for r in replies.located(df, lines).collect()}
    # the last stands on two lines but is cited as one: the claimed range stays
    assert got == {"two": (1, 2), "late": (3, 3), "far": (None, None), "word": (None, None), "odd": (None, None), "none": (None, None), "wide": (1, 3)}


def test_merge_does_not_depend_on_row_order(spark):
    ddl = "ord long, file_rel string, line_start int, line_end int, category string, cwe string, severity string, confidence double, votes int, hedged boolean, reachable string, status string, source string, title string, description string, cited_snippet string, symbol string, remediation string, evidence array<string>"
    rows = [(1, "a", 1, 2, "xss", "", s, 0.5, 1, False, "unclear", "new", "llm", t, "", "", "f", "", ["e"]) for s in ("low", "high") for t in ("b", "a", "")] * 2
    out = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out.update(str(r) for r in findings.merge_findings(spark.createDataFrame(rows, ddl).repartition(3)).collect())
    assert len(out) == 1


def test_nearest_routes_equal_a_walk(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)})
    routes = [(f"n{i}", f"/r{i}") for i in (3, 17, 44)]
    wide = {c for c, _ in edges if sum(x == c for x, _ in edges) > 3}
    up = {}
    for callee, caller in edges:
        if callee not in wide:
            up.setdefault(callee, set()).add(caller)
    want = {}
    for i in range(60):
        seen = front = {f"n{i}"}
        for depth in range(16):
            if hit := sorted(front & {n for n, _ in routes}):
                want[f"n{i}"] = (dict(routes)[hit[0]], depth)
                break
            front = {x for n in front for x in up.get(n, ())} - seen
            seen = seen | front
    names = spark.createDataFrame([(f"n{i}",) for i in range(60)], "name string")
    got = graph.nearest_routes(names, spark.createDataFrame(edges, "callee string, caller string"), spark.createDataFrame(routes, "name string, route string"), most_callers=3)
    assert {r.name: (r.route, r.depth) for r in got.collect()} == want
