"""Language ID with error-correcting output codes.

Every language has a codeword of bits; one binary classifier over hashed byte n-grams predicts each bit.
A text's margins are compared with all codewords by a loss that weights each bit by how well its classifier told
that language in training; the nearest codeword wins, and a small lead is flagged as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import slices

FEATURES = 4096
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 0x20
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
LETTER = regex.compile(r"\p{L}").search
PIECE = 1 << 20


def _counts(text: bytes) -> np.ndarray:
    """Hashed counts of byte 2- and 3-grams; A-Z lower-cased, other ASCII than letters made a blank."""
    out = np.zeros(FEATURES)
    for at in range(0, len(text), PIECE):
        b = FOLD[np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + 2), at)].astype(np.uint32)
        for n in (2, 3):
            last = min(PIECE, len(b) - n + 1) if len(text) - at > PIECE else len(b) - n + 1
            if last > 0:
                h = b[:last] * np.uint32(0x9E3779B1) + np.uint32(n)
                for j in range(1, n):
                    h = (h ^ b[j : last + j]) * np.uint32(0x85EBCA6B)
                out += np.bincount(h >> np.uint32(20), minlength=FEATURES)
    return out


def features(texts: list[str | None]) -> np.ndarray:
    x = np.sqrt(np.stack([_counts((t or "").encode()) for t in texts]))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


def packed(row: np.ndarray) -> bytes:
    """A row of features as the places and half floats of those that are not 0."""
    half = row.astype(np.float16)
    at = np.flatnonzero(half)
    return at.astype(np.uint16).tobytes() + half[at].tobytes()


def unpack(data: bytes, row: np.ndarray) -> None:
    """The same back, into a row of zeros."""
    n = len(data) // 4
    row[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float16, n, 2 * n)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all different splits of up to 7 languages, else the best of random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        return 2.0 * bits[(bits[:, 0] == 1) & (bits.sum(axis=1) < n)].T - 1
    rng, width = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    draws = [np.sign(rng.random((n, width)) - 0.5) for _ in range(64)]

    def closest(code: np.ndarray) -> float:
        same = code @ code.T
        np.fill_diagonal(same, -width)
        return same.max()

    return min(draws, key=closest)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the exponentiated losses, and the lead over the next."""
        loss = self.losses(x)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
        p /= p.sum(axis=1, keepdims=True)
        ranked = np.sort(p, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
        return loss.argmin(axis=1), ranked[:, -1], lead


def train(x: np.ndarray, labels: list[str], epochs: int = 30, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Model:
    """Logistic classifiers of all bits together, by AdaGrad over shuffled batches. x may be of half floats: a batch at a time is widened."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = np.array([languages.index(v) for v in labels], int)
    target = code[y].astype(np.float32)
    share = 1.0 / np.maximum(1, np.bincount(y, minlength=len(languages)))[y] * len(y) / max(1, len(languages))
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if code.shape[1] else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            xi = x[i].astype(np.float32)
            g = -(target[i] / (1 + np.exp(np.clip(target[i] * (xi @ w + b), -30, 30)))) * share[i, None].astype(np.float32) / len(i)
            dw, db = xi.T @ g + decay * w, g.sum(axis=0)
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    margin = [x[at : at + 1024].astype(np.float32) @ w + b for at in range(0, len(x), 1024)]
    right = np.concatenate([*margin, np.zeros((0, code.shape[1]), np.float32)]) * target > 0
    trust = np.stack([right[y == i].mean(axis=0) for i in range(len(languages))]) if languages else np.ones((0, 0))
    return Model(languages, code.astype(np.float32), w, b, (trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32))


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text, mod 5; the documents at 0 are held out. A null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, sample: int = 6000, few: int = 5) -> Model:
    """Learn from whole texts of at most about ``sample`` labelled documents outside fold 0, and of every language.

    Each language gives about the same number of rows, ``few`` at least or all it has, drawn by a hash of doc_id and text; rows alike in both
    are drawn once. At most twice ``sample`` rows, or twice ``few`` a language where that is more, of FEATURES half floats reach the driver, and
    a count for each language.
    """
    labelled = docs.select("text", "lang", F.xxhash64("doc_id", "text", F.lit(11)).alias("h"), fold().alias("fold")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != 0))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return train(np.zeros((0, FEATURES), np.float32), [])
    each = max(few, sample // len(counts))
    sample = max(sample, few * len(counts))
    # languages of few rows are drawn whole; only the others need a limit of their own
    shares = {lang: each / n for lang, n in counts.items() if n > 2 * each}
    limits = F.create_map(*[x for lang, share in shares.items() for x in (F.lit(lang), F.lit(share))]) if shares else F.create_map().cast("map<string,double>")
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.filter(draw < F.coalesce(limits[F.col("lang")], F.lit(1.0))).groupBy("h", "lang").agg(F.first("text").alias("text")).orderBy("h", "lang").limit(2 * sample).select("text", "lang")

    def count(batches):
        for batch in slices(batches, 256):
            x = features(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([packed(r) for r in x], pa.binary())], ["lang", "x"])

    # in the order of (h, lang), one row after the other: the driver holds the half floats once
    x, labels = np.zeros((2 * sample, FEATURES), np.float16), []
    for r in chosen.mapInArrow(count, "lang string, x binary").toLocalIterator():
        unpack(r["x"], x[len(labels)])
        labels.append(r["lang"])
    return train(x[: len(labels)], labels)


def predict(docs: DataFrame, model: Model, lead: float = 0.1) -> DataFrame:
    """The input's rows with held_out, lang_pred, score (0 to 1) and ambiguous.

    lang_pred is a learned language; ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. ambiguous: the nearest codeword leads the next by less than ``lead``, or und. Whole texts are used; lang,
    source and doc_id are not. Columns of the input with these names are replaced.
    """
    new = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    docs = docs.drop("held_out", *new)

    def run(batches):
        for batch in slices(batches):
            texts = batch["text"]
            known = [bool(t is not None and LETTER(t)) and bool(model.languages) for t in texts.to_pylist()]
            langs, scores, unclear = ["und"] * len(known), [0.0] * len(known), [True] * len(known)
            at = np.flatnonzero(known)
            for lo in range(0, len(at), 256):
                rows = at[lo : lo + 256]
                best, score, ahead = model.decode(features(pc.take(texts, pa.array(rows)).to_pylist()))
                for i, j, s, a in zip(rows.tolist(), best.tolist(), score.tolist(), ahead.tolist(), strict=True):
                    langs[i], scores[i], unclear[i] = model.languages[j], s, a < lead
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())], [*batch.schema.names, *new])

    schema = type(docs.schema)(list(docs.schema.fields))
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema).withColumn("held_out", fold() == 0)
