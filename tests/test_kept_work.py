"""Work that is done once: numbering lines, listing symbols and callees, counting lines; against small loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import lines_of, n_lines_of
from lodestone.operators import detect, graph, navigation, symbols


def joins(df):
    return len(re.findall(r"\bJoin \w+", df._jdf.queryExecution().optimizedPlan().toString()))


def test_outline_is_sizes_and_definitions(spark):
    rows = [("a.py", "python", 1, "def f(x):"), ("a.py", "python", 2, "  pass"), ("a.py", "python", 3, "class B:"), ("b.go", "go", 1, "func (r) g() {"), ("c.txt", "text", 7, "def no()")]
    lines = spark.createDataFrame(rows, "path string, language string, line_no int, line string").repartition(3)
    out = {r.path: (r.n_lines, sorted(map(tuple, r.defs))) for r in symbols.outline(lines).collect()}
    assert out == {"a.py": (3, [(1, "f"), (3, "B")]), "b.go": (1, [(1, "g")]), "c.txt": (7, [])}


def test_enclosing_meets_one_row_of_symbols(spark):
    rng = random.Random(3)
    syms = [(rng.choice("ab"), f"s{i}", a, a + rng.choice([-1, 0, 5, 90, 300])) for i in range(60) for a in [rng.randint(1, 400)]]
    points = [(rng.choice("abc"), rng.randint(1, 450), i) for i in range(300)] * 2
    s = spark.createDataFrame(syms, "path string, name string, start_line int, end_line int")
    p = spark.createDataFrame(points, "path string, line_no int, id int")

    def best(path, n):
        c = [(0, b - a, a, m) if a <= n <= b else (1, a - n, a, m) for q, m, a, b in syms if q == path and (a <= n <= b or 1 <= a - n <= 3)]
        return min(c)[3] if c else None

    out = symbols.enclosing(p, s)
    assert sorted(map(tuple, out.select("path", "line_no", "id", F.coalesce("symbol", F.lit(""))).collect())) == sorted((q, n, i, best(q, n) or "") for q, n, i in points)
    assert joins(out) == 1


@pytest.mark.parametrize("rule", detect.RULES)
def test_what_a_rule_needs_is_in_all_it_matches(spark, rule):
    lines = ["eval (x)", "EXEC(", "os.system(", "subprocess.run( a, shell = True", "Runtime.getRuntime().exec", "child_process.exec", "pickle.load (", "yaml.load (f", "hashlib.sha1 (", "md5(", "DES", "ARC4", "a ECB", "random.choice (", "Math.random(", "VERIFY = False", "rejectunauthorized : FALSE", "curlopt_ssl_verifypeer , 0", "DEBUG = true", "app.Debug=True", "'/tmp/x'", '"/var/tmp/"']
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    want = sorted(r.line_no for r in df.filter(F.col("line").rlike(rule[3])).collect())
    assert want and sorted(r.line_no for r in detect.rule_hits(df, [rule]).collect()) == want and rule[3] in detect.RULE_NEEDS


def test_claims_are_judged_one_by_one(spark):
    lines = [("src/a.py", i, f"r{i}") for i in range(1, 101)] + [("b.py", 5, "x")]
    claims = [("same", "a.py", n, f"r{r}") for n in (1, 31, 32, 63, 64, 100, 103) for r in range(1, 101)] + [("same", "nowhere.py", 1, "r1"), ("e", "a.py", 5, ""), ("n", "a.py", None, "r1"), ("up", "x/b.py", 8, "x"), ("up", "x/b.py", 9, "x")]
    out = navigation.cited_routes(spark.createDataFrame(claims, "claim_id string, path string, line_no int, route string"), spark.createDataFrame(lines, "path string, line_no int, line string"))
    text = {(p, n): x for p, n, x in lines}

    def held(path, n, route):
        file = {"a.py": "src/a.py", "x/b.py": "b.py"}.get(path)
        return bool(route) and n is not None and any(route in text.get((file, m), "") for m in range(n - 3, n + 4))

    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((c, p, n, r, held(p, n, r)) for c, p, n, r in claims), key=key)


def test_lines_are_counted_as_they_are_made(spark):
    ends = ["", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n\n", " ", "é"]
    texts = [None, "", *(a + e + b + f for a in ("", "x") for e in ends for b in ("", "y") for f in ends)]
    t = spark.createDataFrame([(x,) for x in texts], "t string").select("t", n_lines_of("t").alias("n"), F.size(lines_of("t")).alias("want"))
    assert t.filter("n is null or n <> want").count() == 0


def test_callees_are_listed_in_bounded_rows(spark):
    edges = spark.createDataFrame([(f"c{i % 25}", "hub") for i in range(100)] + [("hub", "n1"), ("n1", "n1")], "callee string, caller string")
    rows = graph.adjacency(edges, 10).collect()
    assert max(len(r.callees) for r in rows) <= 10
    assert {(r.caller, c) for r in rows for c in r.callees} == {("hub", f"c{i}") for i in range(25)} | {("n1", "hub"), ("n1", "n1")}
    reach = graph.reached_from(edges, spark.createDataFrame([("n1",)], "name string"))
    assert sorted((r.name, r.depth) for r in reach.collect()) == sorted([("n1", 0), ("hub", 1), *((f"c{i}", 2) for i in range(25))])
