"""Ranked lexical search over bit-sliced Bloom signatures, exact.

A document's signature holds its terms, each at every level of occurrences that it reaches (once or more, twice or more, ...). Signatures of
documents of like size lie in a block as bit slices: slice b is the bitmap of the documents whose signature has bit b.

1. ``signatures`` builds the blocks from the texts alone, for any queries.
2. The slices of a term and level, joined by AND, are the documents that may hold the term so often: never too few. Sums of these bitmaps, weighted
   by the terms, give each document an upper bound of its score, with its own length (``bounds``).
3. The documents of highest bound are scored from their texts. A query's k-th best exact score is a safe threshold.
4. All documents whose bound reaches it are scored from their texts, so nothing is lost; the rest are proven to be out.

Texts null: no terms. Rows that share a doc_id, or have none, are documents of their own. Queries are taken in chunks of a bounded number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import LOWER, MUL2, U, Words, bounded, mix, slices, written

#: Bytes that end a term: ASCII without letters and digits.
GAP = np.zeros(256, bool)
GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Least occurrences of each level, bits of a signature that stand for one of its elements, bits set for an element.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256])
WIDTH, HASHES = 12, 4
#: Documents and bytes of signatures in a block.
ROWS, BLOCK_BYTES = 4096, 2 << 20
SCALE = 1_000_000_000


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(SMALL))


def bits_of(terms: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
    """The bits (n, HASHES) of elements (hash of a term, level) in a signature of ``width`` bits."""
    h = mix(terms + (levels + 1).astype(U) * U(MUL2))
    step = mix(h ^ U(MUL2)) | U(1)
    return ((h[:, None] + np.arange(HASHES, dtype=U) * step[:, None]) % U(width)).astype(np.int64)


# ------------------------------------------------------------------------------------ the index

INDEX = "width int, h array<long>, doc_id array<long>, n array<long>, slices binary, with_terms long, terms long"
_LONGS = pa.list_(pa.int64())
INDEX_SCHEMA = pa.schema([("width", pa.int32()), ("h", _LONGS), ("doc_id", _LONGS), ("n", _LONGS), ("slices", pa.binary()), ("with_terms", pa.int64()), ("terms", pa.int64())])


def _row(width: int, held: list) -> pa.RecordBatch:
    h, ids, n, rows = (list(x) for x in zip(*held, strict=True))
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=width)
    cut = np.packbits(np.ascontiguousarray(bits.T), axis=1).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([width, h, ids, n, cut, len(n), sum(n)], INDEX_SCHEMA.types, strict=True)], schema=INDEX_SCHEMA)


def signatures(docs: DataFrame) -> DataFrame:
    """Blocks of bit slices of the documents (doc_id, text) that have terms, written into the shared folder.

    ``h`` names a document by a hash of doc_id and text: documents found are read again by it, and any further document of the
    same hash is just scored too. A signature's width follows its elements, in powers of two, so bits stay sparse.
    """

    def run(batches):
        open_: dict[int, list] = {}
        for batch in slices(batches):
            words = Words(batch["text"], lower=True, gap=GAP)
            h, ids = batch["h"].to_pylist(), batch["doc_id"].to_pylist()
            for d in np.flatnonzero(np.diff(words.first)).tolist():
                terms, tf = np.unique(words.hash[words.first[d] : words.first[d + 1]], return_counts=True)
                reached = np.searchsorted(LEVELS, tf, side="right")
                n = int(reached.sum())
                width = WIDTH << max(4, (n - 1).bit_length())
                level = np.arange(n) - np.repeat(np.cumsum(reached) - reached, reached)
                row = np.zeros(width, bool)
                row[bits_of(np.repeat(terms, reached), level, width)] = True
                held = open_.setdefault(width, [])
                held.append((h[d], ids[d], int(tf.sum()), np.packbits(row).tobytes()))
                if len(held) >= ROWS or len(held) * width >= 8 * BLOCK_BYTES:
                    yield _row(width, open_.pop(width))
        for width, held in open_.items():
            yield _row(width, held)

    return written(_named(docs).mapInArrow(run, INDEX), "signatures")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")


# ------------------------------------------------------------------------------------ queries


class Vocabulary:
    """Terms of a chunk of queries, found in batches of words by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        words = Words(pa.array(terms, pa.string()), lower=True, gap=GAP)
        order = np.argsort(words.hash, kind="stable")
        self.hash, self.sorted, self.number = words.hash, words.hash[order], order
        self.raw = [np.frombuffer(t.encode(), np.uint8) for t in terms]

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) for each word that is a term of the vocabulary, in the order of words."""
        if not self.terms or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = (np.searchsorted(self.sorted, words.hash, side=s) for s in ("left", "right"))
        word = np.repeat(np.arange(len(words.hash)), right - left)
        term = self.number[np.arange(len(word)) + np.repeat(left - np.cumsum(right - left) + (right - left), right - left)]
        size = words.end - words.start
        good = size[word] == np.array([len(x) for x in self.raw])[term]
        word, term = word[good], term[good]
        good = np.zeros(len(word), bool)
        lengths = size[word]
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            kinds, inverse = np.unique(term[at], return_inverse=True)
            table = np.stack([self.raw[k] for k in kinds.tolist()])
            good[at] = (LOWER[words.data[words.start[word[at]][:, None] + np.arange(n)]] == table[inverse]).all(axis=1)
        return word[good], term[good]

    def counted(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) of a batch, in that order."""
        word, term = self.found(words)
        text = np.searchsorted(words.first, word, side="right") - 1
        key, n = np.unique(text * max(1, len(self.terms)) + term, return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), n


@dataclass
class Queries:
    """A chunk of queries: for each the numbers of its terms; the terms' weights; documents with terms and all their terms."""

    vocabulary: Vocabulary
    asked: list[np.ndarray]
    weight: np.ndarray
    n_docs: int
    n_terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        if 90 * int(n.max(initial=0)) * self.n_docs >= 1 << 63:
            return np.array([10 + 90 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        return 10 + 90 * n * self.n_docs // max(1, self.n_terms)


def part(tf, m):
    """What tf occurrences in a document of length m count."""
    return SCALE * tf // (1000 * tf + 8 * m)


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Documents that hold each term, over all documents."""

    def run(batches):
        total = np.zeros(len(vocabulary.terms), np.int64)
        for batch in slices(batches):
            _, term, _ = vocabulary.counted(Words(batch["text"], lower=True, gap=GAP))
            total += np.bincount(term, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(len(vocabulary.terms), np.int64)
    for r in docs.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def bounds(block: dict, q: Queries) -> np.ndarray:
    """Upper bounds (query, document of the block), as integers: at least the scores, 0 where no term can be."""
    n, width = np.array(block["n"], np.int64), block["width"]
    rows = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
    m, out, before = q.length(n), np.zeros((len(q.asked), len(n)), np.int64), np.zeros(len(n), np.int64)
    alive = np.arange(len(q.weight))
    for level in range(len(LEVELS)):
        bits = bits_of(q.vocabulary.hash[alive], np.full(len(alive), level), width)
        may = np.bitwise_and.reduce([rows[bits[:, j]] for j in range(HASHES)])
        held = may.any(axis=1)
        alive = alive[held]
        if not len(alive):
            break
        may = np.unpackbits(may[held], axis=1, count=len(n)).astype(np.float64)
        place = np.full(len(q.weight), -1)
        place[alive] = np.arange(len(alive))
        most = part(int(LEVELS[level + 1]) - 1, m) if level + 1 < len(LEVELS) else np.full(len(n), SCALE // 1000)
        for i, terms in enumerate(q.asked):
            at = place[terms]
            if len(terms := terms[at >= 0]):
                out[i] += (q.weight[terms] @ may[at[at >= 0]]).astype(np.int64) * (most - before)
        before = most
    return out


def probes(index: DataFrame, q: Queries, each: int) -> DataFrame:
    """(q, h) of the ``each`` documents of highest bound of every query."""

    def run(batches):
        best: list[list] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in q.asked]
        for batch in slices(batches, 1):
            block = batch.to_pylist()[0]
            ub, h = bounds(block, q), np.array(block["h"], np.int64)
            for i, (value, name) in enumerate(best):
                at = np.flatnonzero(ub[i])
                at = at[np.argpartition(-ub[i][at], each)[:each]] if len(at) > each else at
                value, name = np.concatenate([value, ub[i][at]]), np.concatenate([name, h[at]])
                keep = np.argsort(-value, kind="stable")[:each]
                best[i] = [value[keep], name[keep]]
        of = np.repeat(np.arange(len(best)), [len(v) for v, _ in best])
        value, name = (np.concatenate([b[k] for b in best]) if best else np.zeros(0, np.int64) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(name, pa.int64()), pa.array(value, pa.int64())], ["q", "h", "bound"])

    found = index.select("width", "h", "n", "slices").mapInArrow(run, "q int, h long, bound long")
    return found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "h"))).filter(F.col("at") <= each).select("q", "h")


def reaching(index: DataFrame, q: Queries, least: np.ndarray) -> DataFrame:
    """(q, h) of all documents whose bound is at least the query's threshold."""

    def run(batches):
        for batch in slices(batches, 1):
            block = batch.to_pylist()[0]
            of, at = np.nonzero(bounds(block, q) >= least[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.array(block["h"], np.int64)[at], pa.int64())], ["q", "h"])

    return index.select("width", "h", "n", "slices").mapInArrow(run, "q int, h long")


def rescored(docs: DataFrame, wanted: DataFrame, q: Queries) -> DataFrame:
    """(q, doc_id, score) of the wanted (q, h), from the whole texts; scores above 0 only."""
    wanted = written(wanted.distinct(), "wanted")
    few = bounded(wanted) is not wanted
    asked = wanted.groupBy("h").agg(F.collect_list("q").alias("qs"))
    named = _named(docs).join(F.broadcast(asked) if few else asked, "h").select("doc_id", "text", "qs")

    def run(batches):
        for batch in slices(batches, 256):
            words = Words(batch["text"], lower=True, gap=GAP)
            text, term, tf = q.vocabulary.counted(words)
            m = q.length(np.diff(words.first))
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = []
            for d, (doc_id, qs) in enumerate(zip(batch["doc_id"].to_pylist(), batch["qs"].to_pylist(), strict=True)):
                counts = np.zeros(len(q.weight), np.int64)
                own = slice(at[d], at[d + 1])
                counts[term[own]] = q.weight[term[own]] * part(tf[own], m[d])
                out += [(i, doc_id, s) for i in qs if (s := int(counts[q.asked[i]].sum())) > 0]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["q", "doc_id", "score"])

    return named.mapInArrow(run, "q int, doc_id long, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weigh(texts: list[str | None], docs: DataFrame, n_docs: int, n_terms: int) -> Queries:
    """A chunk of queries with the weights that the documents give their terms; terms that no document holds are left out."""
    lists = [list(dict.fromkeys(terms_of(t))) for t in texts]
    vocabulary = Vocabulary(sorted({t for x in lists for t in x}))
    df = frequencies(docs, vocabulary)
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    return Queries(vocabulary, [np.array([number[t] for t in x if weight[number[t]]], np.int64) for x in lists], weight, n_docs, n_terms)


def search(docs: DataFrame, items: DataFrame, k: int = 10, chunk: int = 1000, each: int = 32, index: DataFrame | None = None) -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score; all, if fewer.

    Equal scores go by ascending doc_id, nulls last. Rows of items that share an item_id are searched one by one. ``chunk`` items at a time
    are held by the driver and the tasks, with their terms. ``index``: signatures made before from the same documents.
    """
    index = signatures(docs) if index is None else index
    n_docs, n_terms = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    rows = items.select(F.col("item_id"), F.col("text")).toLocalIterator()
    out = None
    while (taken := list(islice(rows, chunk))) or out is None:
        q = weigh([r["text"] for r in taken], docs, n_docs, n_terms)
        least = np.ones(len(taken), np.int64)
        sure = _ranked(rescored(docs, probes(index, q, max(each, k)), q), k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        for r in sure.filter(F.col("n") == k).collect():
            least[r["q"]] = r["score"]
        best = _ranked(rescored(docs, reaching(index, q, least), q), k)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(taken)], "q int, item_id " + items.schema["item_id"].dataType.simpleString())
        best = best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
