"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Votes are counted by pattern over the
whole corpus (at most 3 ** labellers patterns), and expectation-maximisation on the counts estimates each labeller's
accuracies and every pattern's posterior. Posteriors train a linear scorer over hashed words, which then
scores every document, also where the labellers abstain or disagree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import U, Words, slices

BITS = 16
BAD, GOOD, ABSTAIN = 0, 1, 2
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#$%&*|@^~<>{}[]\\_=+"]] = True


def _three(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def votes(w: Words) -> np.ndarray:
    """Votes (texts x labellers) of these labellers, each from a different property of the text:

    letters: share of letters among all bytes; symbols: symbol characters for each word; variety: different
    words among all; repeats: words equal to the one before; length: mean bytes of a word; size: number of words.
    A text without words gets bad from size and no other vote.
    """
    n = np.diff(w.first)
    words = np.maximum(n, 1)
    doc = np.repeat(np.arange(w.n), n)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[w.off[1:]] - c[w.off[:-1]]

    letters = total(IS_LETTER[w.data]) / np.maximum(1, np.diff(w.off))
    symbols = total(IS_SYMBOL[w.data]) / words
    order = np.lexsort((w.hash, doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    variety = np.bincount(doc[order][new], minlength=w.n) / words / np.minimum(1, 3 * words**-0.15)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc[again], minlength=w.n) / words
    length = np.bincount(doc, w.end - w.start, minlength=w.n) / words
    v = np.stack([
        _three(letters, letters < 0.65, letters > 0.75),
        _three(symbols, symbols > 0.3, symbols < 0.05),
        _three(variety, variety < 0.3, variety > 0.5),
        _three(repeats, repeats > 0.2, repeats < 0.05),
        _three(length, (length < 2) | (length > 12), (length > 3) & (length < 9)),
        _three(n, n < 5, n >= 50),
    ], axis=1)
    v[n == 0, :-1] = ABSTAIN
    return v


def pattern_of(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(labellers) % 3


@dataclass
class LabelModel:
    prior: float
    #: chance of each vote by class: class x labeller x vote
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        each = np.arange(v.shape[1])
        bad = np.log(1 - self.prior) + np.log(self.chance[0, each, v]).sum(axis=1)
        good = np.log(self.prior) + np.log(self.chance[1, each, v]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = 200, trust: float = 0.01, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from the belief that labellers are mostly right, which also weighs as ``trust`` of the documents in each
    class, so that a labeller that sees a rare kind of bad text alone isn't explained away.
    """
    chance = np.tile(np.array([[[0.6, 0.2, 0.2]], [[0.01, 0.79, 0.2]]]), (1, v.shape[1], 1))
    model = LabelModel(0.7, chance)
    smooth = chance * max(1.0, trust * count.sum())
    for _ in range(rounds):
        p = model.posterior(v)
        by_class = np.stack([count * (1 - p), count * p])
        seen = np.stack([[[(c * (v[:, j] == k)).sum() for k in range(3)] for j in range(v.shape[1])] for c in by_class]) + smooth
        fresh = LabelModel(float(np.clip(by_class[1].sum() / max(count.sum(), 1e-9), 0.01, 0.99)), seen / seen.sum(axis=2, keepdims=True))
        done = abs(fresh.prior - model.prior) < tolerance and np.abs(fresh.chance - model.chance).max() < tolerance
        model = fresh
        if done:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, w: Words) -> np.ndarray:
        n = np.diff(w.first)
        c = np.concatenate([[0.0], np.cumsum(self.weights[(w.hash >> U(64 - BITS)).astype(np.int64)])])
        z = (c[w.first[1:]] - c[w.first[:-1]]) / np.maximum(n, 1) + self.bias
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def train(rows: list[np.ndarray], counts: list[np.ndarray], target: np.ndarray, epochs: int = 40, rate: float = 2.0) -> Scorer:
    """Logistic regression on mean word weights, by full-batch AdaGrad. rows, counts: different hashed words of each text."""
    weights, bias = np.zeros(1 << BITS), 0.0
    squares, square = np.full(1 << BITS, 1e-8), 1e-8
    words = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.concatenate([c / c.sum() for c in counts]) if rows else np.zeros(0)
    for _ in range(epochs if len(words) else 0):
        z = np.bincount(doc, weights[words] * share, minlength=len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / len(rows)
        gw = np.bincount(words, g[doc] * share, minlength=1 << BITS)
        squares += gw * gw
        weights -= rate * gw / np.sqrt(squares)
        square += g.sum() ** 2
        bias -= 0.1 * rate * g.sum() / np.sqrt(square)
    return Scorer(weights, bias)


def score(docs: DataFrame, sample: int = 4000, keep_at: float = 0.5) -> DataFrame:
    """doc_id, votes (pattern number), weak_label (posterior of good), score (of the trained scorer), keep.

    One row for each input row, over whole texts. A null text or one without words has score 0 and is not kept; otherwise
    keep is score >= ``keep_at``. The scorer is fitted on about ``sample`` documents with words, drawn by a
    hash of doc_id and text (at most twice as many; of each, its different words out of 65,536); votes and the label model cover all. Repeated rows count as often as they occur. Other columns
    are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def vote(batches):
        for batch in slices(batches):
            patterns, n = np.unique(pattern_of(votes(Words(batch["text"]))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n)], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    patterns, counts = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    labellers = 6
    model = estimate(votes_of(patterns, labellers), counts)
    share = min(1.0, sample / max(1.0, counts.sum()))
    drawn = docs.select("text", F.xxhash64("doc_id", "text", F.lit(13)).alias("h")).filter(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    # rows alike in doc_id and text are drawn once; twice the expected number bounds what the driver gets
    drawn = drawn.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(2 * sample)

    def read(batches):
        for batch in slices(batches):
            w = Words(batch["text"])
            label = model.posterior(votes(w).astype(np.int64))
            h = (w.hash >> U(64 - BITS)).astype(np.uint16)
            rows, counts = [], []
            for i in range(w.n):
                word, n = np.unique(h[w.first[i] : w.first[i + 1]], return_counts=True)
                rows.append(word.tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(label), pa.array(rows, pa.binary()), pa.array(counts, pa.binary())], ["h", "label", "words", "counts"])

    drawn = drawn.select("h", "text").mapInArrow(read, "h long, label double, words binary, counts binary").toPandas().sort_values("h")
    drawn = drawn[drawn["words"].str.len() > 0] if len(drawn) else drawn
    scorer = train([np.frombuffer(x, np.uint16) for x in drawn["words"]], [np.frombuffer(x, np.uint32) for x in drawn["counts"]], drawn["label"].to_numpy(float))

    def judge(batches):
        for batch in slices(batches):
            w = Words(batch["text"])
            v = votes(w).astype(np.int64)
            s = scorer(w)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(pattern_of(v)), pa.array(model.posterior(v)), pa.array(s), pa.array((s >= keep_at) & (np.diff(w.first) > 0))], ["doc_id", "votes", "weak_label", "score", "keep"])

    return docs.mapInArrow(judge, "doc_id long, votes long, weak_label double, score double, keep boolean")
