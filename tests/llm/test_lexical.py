"""Ranked lexical search against a loop over all documents."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lexical_search as search
from lodestone.llm.shared import Words


def loop(rows, items, k):
    docs = [(i, collections.Counter(search.terms_of(t))) for i, t in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(search.terms_of(text)) if t in c)
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(corpus):
    texts = [t for _, t in corpus]
    queries = [texts[5] or "x", "w1 w2 w3, W4; w1", "漢字 é ünïcode", "nowhere", None, "", "again", " ".join(f"w{i}" for i in range(300)), "one w7 one"]
    return [(i if i != 3 else None, t) for i, t in enumerate(queries)] + [(1, "w9 w8 w200")]


@pytest.mark.parametrize("k,chunk,each", [(10, 1000, 32), (3, 4, 1), (200, 1000, 5)])
def test_search(spark, docs, corpus, items, k, chunk, each):
    """Ties, copies, rows that share a doc_id or have none, chunks of queries, queries without terms or documents."""
    more = [(7, corpus[9][1]), (None, "w1 w2"), (None, "w1 w2"), (7, "again again"), (11, "x " * 700 + "w3")]
    both = docs.select("doc_id", "text", "bucket", "copies").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"bucket": F.lit(1), "copies": F.lit("x")}))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(0), "h": F.lit(5)})
    got = [tuple(r) for r in search.search(both, asked, k=k, chunk=chunk, each=each).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(loop([*corpus, *more], items, k), key=key)


def test_empty_tables(spark, docs, empty, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(empty, asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


def test_bounds_hold(spark, docs, corpus, items):
    """No document's bound is below its score, and most documents are excluded by it."""
    index = search.signatures(docs)
    n_docs, n_terms = index.agg(F.sum("with_terms"), F.sum("terms")).first()
    q = search.weigh([t for _, t in items], docs, n_docs, n_terms)
    by_id, loose, pairs = dict(corpus), 0, 0
    for block in index.collect():
        ub = search.bounds(block.asDict(), q)
        for d, doc_id in enumerate(block.doc_id):
            text, term, tf = q.vocabulary.counted(Words(pa.array([by_id[doc_id]]), lower=True, gap=search.GAP))
            value = np.zeros(len(q.weight), np.int64)
            value[term] = q.weight[term] * search.part(tf, q.length(np.array([block.n[d]]))[0])
            for i, terms in enumerate(q.asked):
                assert value[terms].sum() <= ub[i, d]
                loose, pairs = loose + (ub[i, d] > 1.3 * value[terms].sum()), pairs + 1
    assert loose < 0.02 * pairs


def test_words_of_a_batch():
    texts = ["Ab_c-É漢!x", None, "", "..", "9" * 70, "a" * (1 << 21) + " b"]
    words = Words(pa.array(texts), lower=True, gap=search.GAP)
    got = [bytes(words.data[s:e]).decode() for s, e in zip(words.start, words.end, strict=True)]
    assert got == [w for t in texts for w in search.TERM.findall(t or "")]
    assert np.diff(words.first).tolist() == [len(search.terms_of(t)) for t in texts]
