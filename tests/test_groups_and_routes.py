"""Semantic groups, and the routes that walks up the callers come to, against loops."""

import collections
import json
import random
import re

from paths import DATA

from lodestone.operators import findings, graph
from lodestone.plans import registry, registry_more  # noqa: F401 (it registers its queries)


def walk(target, callers, routes, depth=15, most=200):
    """Breadth first, callers by name, one target at a time."""
    if target in routes:
        return routes[target], 0
    seen, queue = set(), collections.deque([(target, 0)])
    while queue:
        name, d = queue.popleft()
        if name in seen or d > depth:
            continue
        seen.add(name)
        if len(callers[name]) > most:
            continue
        for c in sorted(callers[name]):
            if c in routes:
                return routes[c], d + 1
            queue.append((c, d + 1))
    return None


def test_nearest_routes(spark):
    rng = random.Random(8)
    edges = {("t", "a"), ("t", "z"), ("a", "zz"), ("z", "aa")}
    edges |= {(f"k{i}", f"k{i + 1}") for i in range(20)}  # a chain: k20 has a route, 16 steps above k4
    edges |= {(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(110)}
    edges |= {("n1", f"w{i}") for i in range(8)}
    edges = {(a, b) for a, b in edges if a != b}
    routes = {"zz": "/zz", "aa": "/aa", "k20": "/k", **{f"n{i}": f"/n{i}" for i in (3, 40, 41)}, "w5": "/w"}
    callers = collections.defaultdict(set)
    for a, b in edges:
        callers[a].add(b)
    names = sorted({x for e in edges for x in e})
    for most in (200, 6):
        want = {n: walk(n, callers, routes, most=most) for n in names}
        got = graph.nearest_routes(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(edges), "callee string, caller string"), spark.createDataFrame(list(routes.items()), "name string, route string"), most_callers=most)
        assert {r.name: (r.route, r.depth) for r in got.collect()} == {n: w for n, w in want.items() if w}
    assert walk("t", callers, routes) == ("/zz", 2) and walk("k4", callers, routes) == ("/k", 16) and walk("k3", callers, routes) is None


def cleaned(reply, n):
    """Groups of a batch of n findings: lists of ids."""
    try:
        lists = json.loads(reply)
    except ValueError:
        return None
    if not isinstance(lists, list) or n < 3:
        return None
    seen, out = set(), []
    for g in lists:
        ids = []
        for x in g if isinstance(g, list) else []:
            token = str(x).strip().strip("[]#().").strip() if not isinstance(x, bool) else ""
            i = int(token) if token.lstrip("+-").isdigit() else -1
            if 0 <= i < n and i not in seen:
                seen.add(i)
                ids.append(i)
        out += [ids] if ids else []
    if not out or n >= 4 and max(map(len, out)) > max(2, n // 2):
        return None
    return out


REPLIES = ["[[0, 1], [2, 3, 0]]", '[["0","3"],["1"]]', "[[0, 0, 1, 1], [1, 4]]", '[["#2", "[3]", "4.", "(1)"], 7, "x", {"a": [0]}]', "[[true, false, 1, 2]]", "[]", "{}", "none", "", None, "[[9, -1, null]]", "[[0, 1, 2, 3, 4]]", "[[4, 2], [], [3]]"]


def test_groups(spark):
    rng = random.Random(4)
    rows, sizes = [], [5] * len(REPLIES)
    sizes[2] = 6
    for b, n in enumerate(sizes):
        rows += [(f"f{b:03}", i, i, "xss", rng.choice(["", "CWE-1"]), rng.choice(["low", "high", "odd"]), rng.choice([0.1, 0.9]), 1, False, rng.choice(["reachable", "unclear"]), "new", "llm", rng.choice(["", f"t{i}"]), f"d{i}", rng.choice(["", f"s{i}"]), rng.choice(["", f"y{i}"]), "", [f"e{b}.{i}"], b * 100 + i) for i in range(n)]
    schema = "file_rel string, line_start int, line_end int, category string, cwe string, severity string, confidence double, votes int, hedged boolean, reachable string, status string, source string, title string, description string, cited_snippet string, symbol string, remediation string, evidence array<string>, ord long"
    df = spark.createDataFrame(rows, schema).repartition(4)
    # batches of five or six: the place in the whole order says which
    batches = findings.batched(df, ["file_rel", "line_start"], 5)
    got = {(r.batch, r.idx): r.ord for r in batches.collect()}
    order = sorted(rows, key=lambda r: r[:2])
    assert got == {(k // 5, k % 5): r[18] for k, r in enumerate(order)}
    replies = spark.createDataFrame(list(enumerate(REPLIES)), "batch long, json string")
    out = {r.ord: r for r in findings.semantically_merged(batches, replies).collect()}
    want = {}
    for b in range(-(-len(order) // 5)):
        own = order[5 * b : 5 * b + 5]
        groups = (cleaned(REPLIES[b] or "", len(own)) if b < len(REPLIES) else None) or []
        groups += [[i] for i in range(len(own)) if not any(i in g for g in groups)]
        for g in groups:
            members = [own[i] for i in g]
            rank = {"low": 1, "high": 3}
            lead = max(members, key=lambda f: (rank.get(f[5], 0), f[6]))
            rest = [lead] + [f for f in members if f is not lead]
            first = lambda k: next((f[k] for f in rest if f[k]), "")
            want[lead[18]] = (lead[1], lead[5], max(f[6] for f in rest), len(rest), "reachable" if any(f[9] == "reachable" for f in rest) else lead[9], lead[12], first(14), first(15), first(4), sum((f[17] for f in rest), []))
    assert {o: (r.line_start, r.severity, r.confidence, r.votes, r.reachable, r.title, r.cited_snippet, r.symbol, r.cwe, r.evidence) for o, r in out.items()} == want
    assert any(len(w[9]) == 2 for w in want.values())
    assert findings.semantically_merged(findings.batched(df.limit(0), ["ord"]), replies).count() == 0


def test_findings_travel_as_the_rows_behind_them(spark):
    """Neither shuffle nor the placed rows have what follows from a row's other columns, and a fold deals the findings once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["a4_semantic_groups"](spark, f"{DATA}/sf0.001")._jdf.queryExecution()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = re.findall(r"Relation \[(.*?)\]", plan.optimizedPlan().toString())
    assert kept and all("l_orderkey" in x and "file_rel" not in x for x in kept)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?", plan.executedPlan().toString())
    assert dealt and set(dealt) <= {"batch", "part_"}, dealt
