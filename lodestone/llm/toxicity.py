"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings. Filters of several widths run over the words, their
responses are rectified, the largest of each filter over the whole text is kept, and a linear layer weighs those. A threshold for each language
is fitted on rows put aside; scores are shifted so that every language's threshold becomes the same score.

The language is told from the text (``language_id``), so a score has the text as its only input. Texts that are null, or have no word,
are scored as a text of no words.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import language_id
from lodestone.llm.lexical_search import GAP
from lodestone.llm.shared import LOWER, MUL2, U, Words, mix, slices, written

#: Rows and length of the embedding table (row 0: nothing), filters' widths and number, and bytes of the beginnings that are hashed.
TABLE, SIZE, WIDTHS, FILTERS, BEGINNINGS = 1 << 16, 16, (1, 2, 3), 12, (3, 4, 5, 6, 7)
PAD = max(WIDTHS) - 1
CHUNK = 1 << 15
#: Rows of an array in one block of a sum; steps of a logit that thresholds tell apart, and the largest.
PIECE, STEPS, MOST = 1 << 11, 1 << 10, 32
#: The score that stands for a language's threshold.
LIMIT = 0.7


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): embedding rows of each word (the word, then its beginnings; 0 for those no shorter than the word), and each text's first word."""
    words = Words(texts, lower=True, gap=GAP)
    n, size = len(words.hash), words.end - words.start
    ids = np.zeros((n, 1 + len(BEGINNINGS)), np.uint16)
    ids[:, 0] = words.hash % U(TABLE - 1) + U(1)
    begin = np.zeros(n, U)
    for j in range(max(BEGINNINGS)):
        have = size > j
        begin[have] |= LOWER[words.data[words.start[have] + j]].astype(U) << U(8 * j)
        if j + 1 in BEGINNINGS:
            longer = size > j + 1
            ids[longer, 1 + BEGINNINGS.index(j + 1)] = mix(begin[longer] + U(j * MUL2 % (1 << 64))) % U(TABLE - 1) + U(1)
    return ids, words.first


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text (an empty one, if it has none) followed by PAD empty ones, and where each text's windows begin and end."""
    n = np.diff(first)
    starts = np.cumsum(np.maximum(n, 1) + PAD) - np.maximum(n, 1) - PAD
    out = np.zeros((int((np.maximum(n, 1) + PAD).sum()), ids.shape[1]), ids.dtype)
    out[np.arange(len(ids)) + np.repeat(starts - (np.cumsum(n) - n), n)] = ids
    return out, starts, starts + np.maximum(n, 1)


@dataclass
class Net:
    """table: embeddings; filters[w]: (w, SIZE, FILTERS); shift[w]: FILTERS; weights of the pooled filters, and bias."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    shift: dict[int, np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        table = (0.05 * rng.standard_normal((TABLE, SIZE))).astype(np.float32)
        table[0] = 0
        filters = {w: (rng.standard_normal((w, SIZE, FILTERS)) / math.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS}
        return cls(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, (0.3 * rng.standard_normal(FILTERS * len(WIDTHS))).astype(np.float32), np.zeros(1, np.float32))

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        """Filters of width w at each word but the last PAD."""
        n = len(x) - PAD
        return sum(x[j : j + n] @ self.filters[w][j] for j in range(w)) + self.shift[w]

    def pooled(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest rectified response of each filter in each text, by chunks of words."""
        out = np.zeros((len(starts), FILTERS * len(WIDTHS)), np.float32)
        for lo in range(0, len(ids) - PAD, CHUNK):
            hi = min(lo + CHUNK, len(ids) - PAD)
            x = self.table[ids[lo : hi + PAD]].sum(axis=1)
            of = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left"))
            if len(of):
                bounds = np.stack([np.maximum(starts[of], lo) - lo, np.minimum(ends[of], hi) - lo], axis=1).ravel()
                both = np.concatenate([self.responses(x, w) for w in WIDTHS], axis=1)
                best = np.maximum.reduceat(both, bounds[:-1] if bounds[-1] == len(both) else bounds, axis=0)[::2]
                out[of] = np.maximum(out[of], best)
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        return (self.pooled(*padded(ids, first)) @ self.weights + self.bias).astype(np.float64)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters.values(), *self.shift.values(), self.weights, self.bias]

    def gradients(self, ids: np.ndarray, first: np.ndarray, label: np.ndarray, share: np.ndarray) -> list[np.ndarray | tuple]:
        """Of the weighted logistic loss, in the order of ``parameters``; the table's as (rows, values). Only the largest response of a filter has one."""
        rows, starts, ends = padded(ids, first)
        x, pool, at = self.table[rows].sum(axis=1), [], []
        for w in WIDTHS:
            r = self.responses(x, w)
            best = np.stack([r[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
            at.append(best)
            pool.append(np.take_along_axis(r, best, 0))
        pool = np.concatenate(pool, axis=1)
        live = pool > 0
        logit = np.where(live, pool, 0) @ self.weights + self.bias
        out = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / len(label)
        back = out[:, None] * self.weights * live
        to_x, filters, shift = np.zeros_like(x), [], []
        for i, w in enumerate(WIDTHS):
            g, best = back[:, i * FILTERS : (i + 1) * FILTERS], at[i]
            shift.append(g.sum(axis=0))
            df = np.zeros_like(self.filters[w])
            for j in range(w):
                df[j] = np.einsum("dfs,df->sf", x[best + j], g)
                np.add.at(to_x, best + j, g[:, :, None] * self.filters[w][j].T[None])
            filters.append(df)
        hit = np.flatnonzero(np.abs(to_x).sum(axis=1))
        named, inverse = np.unique(rows[hit], return_inverse=True)
        values = np.zeros((len(named), SIZE), np.float32)
        np.add.at(values, inverse.reshape(len(hit), -1), to_x[hit][:, None, :])
        values[named == 0] = 0
        return [(named, values), *filters, *shift, (np.where(live, pool, 0) * out[:, None]).sum(axis=0), out.sum(keepdims=True)]


def holders(batches) -> np.ndarray:
    """How many texts of either label hold each embedding row."""
    held = np.zeros((2, TABLE))
    for ids, first, label in batches:
        for d, y in enumerate(label.tolist()):
            held[int(y)] += np.bincount(np.unique(ids[first[d] : first[d + 1]]), minlength=TABLE) > 0
    return held


def lean(net: Net, held: np.ndarray, n: np.ndarray, prior: float = 2.0) -> None:
    """Begin with what single words tell: the first entry of an embedding row is its smoothed log odds over texts, halved."""
    odds = np.log((held[1] + prior) / (n[1] + 2 * prior)) - np.log((held[0] + prior) / (n[0] + 2 * prior))
    net.table[1:, 0] = 0.5 * np.where(held.sum(axis=0) > 0, odds, 0)[1:]


def step(net: Net, seen: list[np.ndarray], ids: np.ndarray, first: np.ndarray, label: np.ndarray, share: np.ndarray, rate: float) -> np.ndarray:
    """One batch of AdaGrad, in place. The embedding rows it moved."""
    grads = net.gradients(ids, first, label, share)
    for p, s, g in zip(net.parameters(), seen, grads, strict=True):
        at, g = g if isinstance(g, tuple) else (slice(None), g)
        s[at] += g * g
        p[at] -= (rate * g / np.sqrt(s[at])).astype(np.float32)
    return grads[0][0]


def train(ids: list[np.ndarray], label: np.ndarray, held: np.ndarray, n: np.ndarray, epochs: int = 8, rate: float = 0.03, batch: int = 32, seed: int = 7) -> tuple[Net, list[np.ndarray]]:
    """A net and its AdaGrad sums, by shuffled batches of some rows; both classes weigh the same. It begins with the counts of all texts."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    seen = [np.full_like(p, 1e-4) for p in net.parameters()]
    if n.min() > 0:
        lean(net, held, n)
    if not len(ids) or len(set(label.tolist())) < 2:
        return net, seen
    share = np.where(label == 1, len(label) / (2 * (label == 1).sum()), len(label) / (2 * (label == 0).sum()))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(ids), batch):
            i = order[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum([len(ids[k]) for k in i])])
            step(net, seen, np.concatenate([ids[k] for k in i]), first, label[i], share[i], rate)
    return net, seen


def summed(rows: DataFrame, run, size: int, width: int) -> np.ndarray:
    """The sum over all tasks of ``run(batches)``, an array (size, width) of each: cut into blocks of PIECE rows that Spark adds up."""

    def blocks(batches):
        out = np.ascontiguousarray(run(batches), np.float64)
        at = range(0, size, PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([out[a : a + PIECE].tobytes() for a in at], pa.binary())], ["at", "x"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch["x"]:
                total = total + np.frombuffer(x.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "x"])

    out = np.zeros((size, width))
    for r in rows.mapInArrow(blocks, "at int, x binary").groupBy("at").applyInArrow(add, "at int, x binary").toLocalIterator():
        x = np.frombuffer(bytes(r["x"])).reshape(-1, width)
        out[r["at"] : r["at"] + len(x)] = x
    return out


def batches_of(batches, rows: int = 32):
    for batch in slices(batches, rows):
        if batch.num_rows:
            yield (*word_ids(batch["text"]), batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64))


def taught(rows: DataFrame, net: Net, seen: list[np.ndarray], n: np.ndarray, rate: float = 0.03) -> Net:
    """The net after one pass over all rows (text, toxic): each task goes on from it with its own rows, and the moves are averaged.

    An embedding row's move is averaged over the batches that moved it, the others' over all batches.
    """
    if n.min() == 0:
        return net
    weigh = n.sum() / (2 * n)
    flat = np.concatenate([p.ravel() for p in net.parameters()[1:]])
    extra = -(-len(flat) // SIZE)

    def run(batches):
        own, sums = copy.deepcopy(net), [s.copy() for s in seen]
        moved, done = np.zeros(TABLE), 0
        for ids, first, label in batches_of(batches):
            moved[step(own, sums, ids, first, label, weigh[label], rate)] += 1
            done += 1
        out = np.zeros((TABLE + extra, SIZE + 1))
        out[:TABLE, :SIZE], out[:TABLE, SIZE] = (own.table - net.table) * moved[:, None], moved
        rest = np.zeros(extra * SIZE)
        rest[: len(flat)] = np.concatenate([p.ravel() for p in own.parameters()[1:]]) - flat
        out[TABLE:, :SIZE], out[TABLE:, SIZE] = rest.reshape(extra, SIZE) * done, done
        return out

    total = summed(rows, run, TABLE + extra, SIZE + 1)
    move = (total[:, :SIZE] / np.maximum(total[:, SIZE:], 1)).astype(np.float32)
    out, at, rest = copy.deepcopy(net), 0, move[TABLE:].ravel()
    out.table += move[:TABLE]
    for p in out.parameters()[1:]:
        p += rest[at : at + p.size].reshape(p.shape)
        at += p.size
    return out


@dataclass
class Model:
    """The net, the languages' model, and by language the logit that becomes LIMIT (``""``: any other)."""

    net: Net
    languages: language_id.Model
    thresholds: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Logits and the languages told from the texts (``und``: none)."""
        logit = self.net.logits(*word_ids(texts))
        texts = texts.to_pylist()
        known = [bool(t and language_id.LETTER(t)) and bool(self.languages.languages) for t in texts]
        told = iter(self.languages.decode(language_id.features([t for t, k in zip(texts, known, strict=True) if k]))[0].tolist() if any(known) else [])
        return logit, [self.languages.languages[next(told)] if k else "und" for k in known]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Scores (0 to 1) and the languages."""
        logit, names = self.judge(texts)
        least = np.array([self.thresholds.get(n, self.thresholds.get("", 0.0)) for n in names])
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit - least) + math.log(LIMIT / (1 - LIMIT)), -30, 30))), names


def threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between two logits at which the weighted F1 is best; among equals the widest gap."""
    order = np.argsort(-logit, kind="stable")
    z, y, w = logit[order], label[order], weight[order]
    hit, out = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / np.maximum(out + (w * y).sum(), 1e-9)
    gap = np.append(z[:-1] - z[1:], 0.0)
    f1[gap == 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = best[gap[best].argmax()]
    return float((z[at] + z[min(at + 1, len(z) - 1)]) / 2)


def calibrated(model: Model, rows: DataFrame, least: int = 25) -> Model:
    """Thresholds over all rows (text, toxic) and, where a language has ``least`` of each label, over its own.

    Every row is scored and counted by language, label and logit, the last in steps of 1 / STEPS up to MOST either way, so what is collected is bounded.
    """

    def run(batches):
        for batch in slices(batches, 256):
            logit, names = model.judge(batch["text"])
            at = np.round(np.clip(logit, -MOST, MOST) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch["toxic"], pa.array(at)], ["told", "toxic", "at"])

    counts = rows.select("text", "toxic").mapInArrow(run, "told string, toxic int, at int").groupBy("told", "toxic", "at").count().orderBy("told", "toxic", "at").collect()
    told, label = np.array([r["told"] for r in counts]), np.array([r["toxic"] for r in counts])
    logit, n = np.array([r["at"] for r in counts]) / STEPS, np.array([float(r["count"]) for r in counts])
    for name in ["", *sorted(set(told.tolist()))]:
        at = np.flatnonzero((told == name) | (name == ""))
        need = 1 if name == "" else least
        if min(n[at][label[at] == 1].sum(), n[at][label[at] == 0].sum()) >= need:
            model.thresholds[name] = threshold(logit[at], label[at], n[at])
    return model


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text, mod 3; the documents at 1 are held out. A null doc_id counts as 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_words: int = 50_000, aside: int = 5) -> Model:
    """Learn from all whole texts with a label in folds 0 and 2, but one in ``aside`` (told by a hash of doc_id), which the thresholds are fitted on.

    Counts of words come from all of them. The net is first fitted in the driver to about ``sample`` rows of each label (at most twice that, texts of
    up to ``most_words`` words), drawn by a hash of doc_id, as is the languages' model; then it is trained on all rows, a share in each task (``taught``).
    A doc_id with several labels counts as toxic if one says so, one with several texts is learned with one of them.
    """
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold() != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("text").isNotNull())
    one = texts.join(labelled, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("s")).select("doc_id", "toxic", "s.text", "s.lang")
    learn = written(one.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(aside)) == 0), "labelled")
    counts = {(r["aside"], r["toxic"]): r["count"] for r in learn.groupBy("aside", "toxic").count().collect()}
    n = np.array([counts.get((False, y), 0) for y in (0, 1)])
    own = learn.filter("not aside").select("text", "toxic")
    held = summed(own, lambda batches: holders(batches_of(batches)).T, TABLE, 2).T
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, n[1]))).otherwise(min(1.0, sample / max(1, n[0])))
    chosen = learn.filter("not aside").filter(draw < limit).orderBy(F.xxhash64("doc_id")).limit(4 * sample)

    def prepare(batches):
        for batch in slices(batches, 256):
            ids, first = word_ids(batch["text"])
            x = language_id.features(batch["text"].to_pylist())
            rows = [(a, b, c, ids[first[d] : first[d + 1]].tobytes(), language_id.packed(x[d])) for d, (a, b, c) in enumerate(zip(*(batch[n].to_pylist() for n in ("doc_id", "toxic", "lang")), strict=True)) if first[d + 1] - first[d] <= most_words]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "toxic", "lang", "ids", "x"])

    # in the order of doc_id, one row after the other: the driver holds words and half floats once
    prepared = chosen.mapInArrow(prepare, "doc_id long, toxic int, lang string, ids binary, x binary").orderBy("doc_id")
    ids, x, label, langs = [], np.zeros((chosen.count(), language_id.FEATURES), np.float16), [], []
    for r in prepared.toLocalIterator():
        language_id.unpack(r["x"], x[len(ids)])
        ids.append(np.frombuffer(bytes(r["ids"]), np.uint16).reshape(-1, 1 + len(BEGINNINGS)))
        label.append(r["toxic"])
        langs.append(r["lang"])
    x, label, known = x[: len(ids)], np.array(label, np.int64), [i for i, v in enumerate(langs) if v is not None]
    languages = language_id.train(x[known], [langs[i] for i in known])
    net, seen = train(ids, label, held, n)
    del x, ids
    return calibrated(Model(taught(own, net, seen, n), languages), learn.filter("aside"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The input's rows with held_out, toxic_lang (told from the text), score (0 to 1) and predicted (1 if score >= LIMIT).

    Whole texts are used, and nothing else. Columns of the input with these names are replaced.
    """
    new = {"toxic_lang": "string", "score": "double"}
    docs = docs.drop("held_out", "predicted", *new)

    def run(batches):
        for batch in slices(batches, 256):
            score, names = model.score(batch["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *new])

    schema = type(docs.schema)(list(docs.schema.fields))
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema).withColumn("held_out", fold() == 1).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
