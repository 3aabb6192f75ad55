"""Snippets sought near their lines: spans of a file, ranges over their ends, and how often texts are dealt."""

import random
import re

from paths import DATA

from lodestone.operators import replies
from lodestone.plans import registry, registry_more  # noqa: F401 (it registers its queries)

SMALL = f"{DATA}/sf0.001"


def sought(own, lo, hi, snippet, slack=2):
    """The rule told line by line."""
    flat = lambda x: " ".join(x.split())
    want, height = flat(snippet), snippet.strip().count("\n") + 1
    if not want or len(want) < 12 and re.fullmatch(r"[^\W\d]\w*|[^\W_]+", want):
        return None, None
    a, b = min(lo, hi), max(lo, hi)
    near = [i for i in range(max(1, a - slack), min(len(own), max(b, a + height - 1) + slack) + 1)]
    holds = lambda at: want in flat(" ".join(own[i - 1] for i in at))
    if not near or not holds(near):
        return None, None
    first = next((i for k, i in enumerate(near) if holds(near[k : k + height])), None)
    return (first, first + height - 1) if first else (a, b)


def test_snippets_over_the_ends_of_spans(spark):
    rng = random.Random(7)
    words = ["f(x)", "y =", "", "  g( y )", "return", "a b", "\tz"]
    own = {p: [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(n)] for p, n in (("a", 3), ("b", 40), ("c", 17))}
    claims = []
    for k in range(400):
        p = rng.choice("abc")
        i, h = rng.randrange(len(own[p])), rng.choice([1, 1, 2, 3, 9])
        lo = i + 1 + rng.choice([-6, -2, -1, 0, 0, 1, 2, 5])
        claims.append((k, p, lo, rng.choice([lo, lo, lo + h - 1, lo - 1, lo + 7, 2_000_000_000]), rng.choice(["\n", " \n"]).join(own[p][i : i + h])))
    lines = spark.createDataFrame([(p, i + 1, x) for p, xs in own.items() for i, x in enumerate(xs)], "path string, line_no int, line string")
    df = spark.createDataFrame(claims, "claim_id int, path string, lo int, hi int, snippet string")
    want = {k: sought(own[p], lo, hi, x) for k, p, lo, hi, x in claims}
    assert sum(f is not None for f, _ in want.values()) > 100
    for span in (4, 128):
        assert {r.claim_id: (r.found_at, r.found_to) for r in replies.located(df, lines, span=span).collect()} == want


def test_texts_are_dealt_once(spark):
    """The lines, the claims and twice their ids; file sizes and wide claims, which the given ones are not, besides."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["f7_located_snippets"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 6


def test_citations_meet_lines_by_spans(spark):
    """A citation dealt by line would travel once for each line looked at."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["f41_cited_findings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not any("line_no" in x for x in dealt)
    assert any("span_" in x for x in dealt)
