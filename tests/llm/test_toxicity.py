"""The convolutional toxicity classifier against loops, numeric gradients and held-out labels."""

import math

import numpy as np
import pyarrow as pa
from paths import DATA
from pyspark.sql import functions as F

from lodestone.llm import language_id, toxicity
from lodestone.llm.lexical_search import terms_of

TEXTS = [None, "", "...", "One", "a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh réeuxment", "x y " * 40, "É é É"]


def net(seed=3):
    n = toxicity.Net.fresh(seed)
    for w in toxicity.WIDTHS:
        n.shift[w] += np.linspace(-0.2, 0.3, toxicity.FILTERS, dtype=np.float32)
    n.bias += 0.25
    return n


def loop(n, ids):
    """One text, window by window."""
    x = np.concatenate([n.table[ids.astype(int)].sum(axis=1), np.zeros((toxicity.PAD + 1, toxicity.SIZE))])
    pool = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            pool.append(max(0, *(sum(float(x[t + j] @ n.filters[w][j][:, f]) for j in range(w)) + float(n.shift[w][f]) for t in range(max(1, len(ids))))))
    return float(np.array(pool) @ n.weights + n.bias[0])


def test_words_and_beginnings():
    ids, first = toxicity.word_ids(pa.array(TEXTS, pa.string()))
    assert np.diff(first).tolist() == [len(terms_of(t)) for t in TEXTS]
    words = [w.encode() for t in TEXTS for w in terms_of(t)]
    for word, row in zip(words, ids, strict=True):
        assert row[0] > 0 and [bool(x) for x in row[1:]] == [len(word) > n for n in toxicity.BEGINNINGS]
    begin = {}
    for word, row in zip(words, ids, strict=True):
        for n, x in zip(toxicity.BEGINNINGS, row[1:], strict=True):
            if x:
                assert begin.setdefault(word[:n], x) == x
    assert len(set(begin.values())) == len(begin)


def test_forward(monkeypatch):
    n = net()
    ids, first = toxicity.word_ids(pa.array(TEXTS, pa.string()))
    want = [loop(n, ids[a:b]) for a, b in zip(first, first[1:], strict=False)]
    for chunk in (1 << 15, 7, 3):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(n.logits(ids, first), want, atol=1e-4)


def test_gradients():
    n = net(5)
    ids, first = toxicity.word_ids(pa.array(TEXTS[2:], pa.string()))
    label, share = np.array([0, 1, 0, 1, 1]), np.array([1.0, 0.5, 2, 1, 1])

    def loss():
        z = n.logits(ids, first)
        return float((share * (np.log1p(np.exp(z)) - label * z)).mean())

    for p, g in zip(n.parameters(), n.gradients(ids, first, label, share), strict=True):
        if isinstance(g, tuple):
            full = np.zeros_like(p)
            full[g[0]] = g[1]
            g = full
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            i = np.unravel_index(at, p.shape)
            old, step = p[i], 2e-3
            p[i] = old + step
            up = loss()
            p[i] = old - step
            down = loss()
            p[i] = old
            assert math.isclose((up - down) / (2 * step), float(g[i]), rel_tol=0.1, abs_tol=2e-3)


def test_threshold():
    z, y = np.array([3.0, 2.5, 1.0, 0.5, -1.0]), np.array([1, 1, 1, 0, 0])
    assert toxicity.threshold(z, y, np.ones(5)) == 0.75
    assert toxicity.threshold(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0]), np.array([1.0, 5.0, 1.0])) <= 0.5


def test_held_out(spark):
    """Held-out toxic documents are found, clean ones left alone; only folds 0 and 2 are learned from."""
    folder = f"{DATA}/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    seen = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, seen, sample=600)  # what is held out has wrong labels here
    got = toxicity.predict(docs.join(labels.select("doc_id", "toxic"), "doc_id"), model).filter("held_out").select("toxic", "predicted", "score").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(toxic) > 100 and toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.03


def test_all_rows_are_learned(spark):
    """A word of a single text, and rows put aside, count, however few rows the first fit draws."""
    rows = [(i, ("vile" if i % 2 else "kind") + f" only{i} word", "en", i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=20)
    learned = {r.doc_id for r in labels.filter(toxicity.fold() != 1).collect()}
    aside = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) == 0).collect()}
    ids, first = toxicity.word_ids(pa.array([r[1] for r in rows]))
    for i, _, _, _ in rows:
        own = ids[first[i] + 1][0]
        assert (model.net.table[own, 0] != 0) == (i in learned - aside) or (ids == own).sum() > 1
    assert set(model.thresholds) == {"", "en"} and min(len(learned & aside), len(learned - aside)) > 40
    got = toxicity.predict(docs.join(labels, "doc_id"), model).filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98


def test_odd_rows(spark, docs, empty):
    model = toxicity.Model(net(), language_id.train(np.zeros((0, language_id.FEATURES), np.float32), []))
    odd = docs.withColumn("score", F.lit("own")).withColumn("x", F.lit(1)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("score", F.lit("own")).withColumn("x", F.lit(1)))
    got = toxicity.predict(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.toxic_lang == "und" for r in got)
    assert len({r.score for r in got if not terms_of(r.text)}) == 1
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.thresholds == {} and toxicity.predict(empty, nothing).count() == 0
    one = toxicity.fit(docs, spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (5, 7)], "doc_id long, toxic int"))
    assert toxicity.predict(docs, one).count() == docs.count()
