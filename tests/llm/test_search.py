"""Vector searches and the URL filter against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann_search, topk_search, url_filter


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8))
    x[50:120] = x[50]  # many equal vectors: ties
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (405, [1.0, 2.0]), (406, []), (None, rows[0][1]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("own")).repartition(3)


def usable(df, nonzero=False):
    out = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v)):
            out[r.vec_id] = v
    return out


def test_exact_top_k(vectors):
    have = {i: [math.floor(256 * x) for x in v] for i, v in usable(vectors).items()}
    got = {}
    for r in topk_search.search(vectors, vectors.filter("vec_id % 10 = 0 or vec_id in (404, 405)"), k=5, block=64, query_block=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q, v in have.items():
        if q % 10 == 0 or q in (404, 405):
            all_ = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in have.items() if i != q and len(w) == len(v))[:5]
            assert got.get(q, {}) == {n: (i, -s) for n, (s, i) in enumerate(all_, 1)}
    assert 405 not in got


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(i, [float(x), 3.0 + i]) for i, x in enumerate([5e6, 4.9e6, -5e6, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in topk_search.search(df, df.filter("vec_id = 0"), k=2).collect()]
    assert got == [(0, 1, int(256 * 5e6) * int(256 * 4.9e6) + 768 * 1024), (0, 3, int(256 * 5e6) * 256 + 768 * 256 * 6)]
    huge = spark.createDataFrame([(i, [1e16]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(huge, huge).collect()


def test_one_large_row_spoils_nothing(spark):
    """Rows beyond 63 bits are exact, or out of the result where they lose; only a score to be returned that doesn't fit is an error."""
    rows = [(0, [1.0, 2.0]), (1, [-1e30, 1.0]), (2, [3.0, 4.0]), (3, [-1e300, -1e307]), (4, [5.0, 1.0]), (5, [1e6, -1e6]), (6, [2.0**20, 1.0]), (7, [0.0, -1.7e308]), (8, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) if math.isfinite(256 * x) else math.floor(x) * 256 for x in v] for i, v in rows}
    got = topk_search.search(df, df.filter("vec_id in (0, 6, 8)"), k=3).collect()
    for q in (0, 6, 8):
        want = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in want]
    alone = df.filter("vec_id in (0, 1, 2)")
    assert [(r.vec_id, r.score) for r in topk_search.search(alone, alone.filter("vec_id = 0"), k=1).collect()] == [(2, 256 * 768 + 512 * 1024)]
    with pytest.raises(Exception, match="64 bits"):  # a score far below all others is to be returned
        topk_search.search(alone, alone.filter("vec_id = 0"), k=2).collect()
    with pytest.raises(Exception, match="64 bits"):  # one far above
        topk_search.search(df, df.filter("vec_id = 3"), k=2).collect()


def test_ann_is_exact_when_all_parts_are_visited(vectors):
    have = {i: np.array(v) for i, v in usable(vectors, True).items() if len(v) == 8}
    got = {}
    for r in ann_search.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20, parts=4, visit=1.0, block=64, query_block=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 9))
    for q, v in have.items():
        if q % 20 == 0:
            want = sorted((-round(float(sum(v * w)), 9), i) for i, w in have.items() if i != q)[:20]
            assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(want, 1)}


def test_ann_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    hit = n = 0
    found = {}
    for r in ann_search.search(df, df.filter("vec_id % 20 = 0"), k=20, sample=1000).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.argsort(-s)[:20].tolist())
        hit, n = hit + len(want & found[q]), n + 20
    assert hit / n >= 0.9


def test_routing_of_the_given_vectors(spark):
    """Recall of at least 0.9 on the given table, with fewer products than brute force; queries meet only parts they visit."""
    from paths import DATA

    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    have = {i: np.array(v) for i, v in usable(df, True).items()}
    ids, x = np.array(sorted(have)), np.stack([have[i] for i in sorted(have)])
    found, hit = {}, 0
    for r in ann_search.search(df, df.filter("vec_id % 20 = 0"), k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    for q, s in zip(ids[asked].tolist(), score, strict=True):
        hit += len(found[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(asked) and all(len(f) == 20 for f in found.values())
    index = ann_search.build(ann_search.usable(df, nonzero=True), x.shape[1], len(ids), 20)
    visits = index.visits(x[asked])
    products = int((visits * index.held).sum())
    assert index.held.sum() == len(ids) and products < 0.8 * len(asked) * len(ids)
    part = {r.vec_id: r.part for r in index.rows.select("vec_id", "part").collect()}
    row = {q: v for q, v in zip(ids[asked].tolist(), visits, strict=True)}
    assert all(row[q][part[v]] for q, vs in found.items() for v in vs)


def test_many_lengths(spark, vectors):
    """Only lengths that are asked for have an index."""
    rows = [(1000 + 10 * d + i, [float(i + 1)] * d) for d in range(20, 60) for i in range(2)]
    both = vectors.select("vec_id", "embedding").unionByName(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = ann_search.search(both, both.filter("vec_id in (1200, 1591)"), k=20).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1200, 1201), (1591, 1590)]


def test_few_and_no_vectors(spark, vectors):
    assert topk_search.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert ann_search.search(vectors.limit(0), vectors.limit(0)).count() == 0
    three = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    assert topk_search.search(three, three.filter("vec_id = 0")).count() == 2
    assert ann_search.search(three, three.filter("vec_id = 0")).count() == 2


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "a.b.example.org/"), ("allow", "example.org/x"), ("block", "net/es/"), ("block", "co/")]
URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/a", "https://www.example.com/en/?q#f", "https://x.www.Example.com/en/", "http://notexample.com/en/", "http://example.com", "http://example.com/en", "ftp://net/es/", "http://a.net/fr/x", "http://b.net/de/", "http://com/", "http://com:80/", "http://u@example.com/en/", "http://a.b.example.org/x", "http://c.a.b.example.org/y", "http://b.example.org/xx", "http://..com/", "http://.com./", "http://x.co/", "http://É.com/é", "a://b://c/d", "http://example.com?x=/en/"]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = []
    for v, r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, v))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("range_bounds,slice_rows", [(100_000, 100_000), (4, 3), (1, 1)])
def test_url_filter(spark, range_bounds, slice_rows):
    df = spark.createDataFrame([(i % 23, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, key string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(df, RULES, slice_rows=slice_rows, range_bounds=range_bounds).collect())
    assert got == sorted((i % 23, h, p, r or "", v) for i, u in enumerate(URLS * 2) for h, p, r, v in [verdict(u)])
    assert url_filter.judge(df.limit(0), RULES, range_bounds=range_bounds).count() == 0
    assert {r.verdict for r in url_filter.judge(df, [], default="block").collect()} == {"block"}
