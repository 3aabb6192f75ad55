"""Substring dedup by relative Lempel-Ziv parsing against the blocks of all documents.

Every document is a reference. Its text is cut at anchors: an anchor is the run of ``block`` words with the
least hash in some window of ``window`` words, so equal windows have equal anchors, and about one word in seven is
one. A reference block goes from an anchor to the end of the next one.

1. ``listed`` lists the anchors of every bucket of documents; reducers by hash tell which occur more than once.
2. ``blocks`` lists the blocks between such anchors with their places; reducers answer with the first
   place of each: (document, word).
3. A document is parsed greedily: a factor (reference document, position, length) goes on while the next
   block's first place is the next one of the same reference. All windows inside a factor repeat.
4. At factor boundaries, and where a factor is too short to hold a window, the windows whose anchor is known are
   checked one by one: reducers tell by a 96-bit fingerprint whether a window is the first with these words.
   So a window that hangs over two factors of different references is judged by itself, as the rule demands.

The lists that travel are packed hashes, one row for each pair of bucket and hash partition that has any,
so there are never more rows than hashes. A bucket sends each hash once, so no group grows with a common
passage, and a partition holds the hashes of a fixed number of buckets.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import MUL, MUL2, U, Words, blob, bucketed, deal, mix, release

ANCHORS, BLOCKS, WINDOWS = 1, 2, 3
#: a, b: hash; doc, at: first place in the bucket.
SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])
SENT_DDL = "part int, bucket int, a binary, b binary, doc binary, at binary"
#: bits: one for each hash sent; doc, at: first place of each hash whose bit is set (blocks only).
BACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])
BACK_DDL = "bucket int, kind int, part int, bits binary, doc binary, at binary"
OUT_DDL = "doc_id long, n_words long, n_removed long, n_factors long, kept_text string"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_factors", pa.int64()), ("kept_text", pa.string())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the first minimum of each ``width`` consecutive values."""
    at, value, have = np.arange(len(x), dtype=np.int32), x, 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        value = np.where(take, right, left)
        have += step
    return at


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each different pair (in the order of pairs), and each entry's number among them."""
    order = np.lexsort((b, a))  # stable: equal pairs stay in the order of their places
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class _Parse:
    """One bucket's documents in the order of their places: windows, anchors and blocks."""

    def __init__(self, docs: pa.Table, window: int, block: int, parts: int):
        release()
        self.docs = docs.take(pc.sort_indices(docs, [("place", "ascending")]))
        self.places = self.docs["place"].to_numpy()
        self.words = w = Words(self.docs["text"])
        w.start = w.end = None  # not needed here
        self.parts, self.window, self.block = parts, window, block
        self.h = w.grams(block)
        self.starts = np.flatnonzero(w.whole(window)).astype(np.int32)
        low = _sliding_min(self.h, window - block + 1)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        chosen = np.zeros(len(self.h), bool)
        chosen[low] = True
        self.anchors = np.flatnonzero(chosen)
        self.anchor_of = (np.cumsum(chosen, dtype=np.int32) - 1)[low] if len(low) else low
        self.anchor_doc = np.searchsorted(w.first, self.anchors, "right") - 1
        self.keys, self.key_of, n = np.unique(self.h[self.anchors] & ~U(1), return_inverse=True, return_counts=True)
        self.twice = n > 1

    def place_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word within it, of words of the bucket."""
        doc = np.searchsorted(self.words.first, word, "right") - 1
        return self.places[doc], (word - self.words.first[doc]).astype(np.int32)

    def sent(self, bucket: int, a: np.ndarray, b: np.ndarray | None = None, word: np.ndarray | None = None, doc_only: bool = False) -> pa.Table:
        """Hashes by partition, each with the place of its word."""
        order, bound = deal(a & ~U(1), self.parts)
        doc, at = self.place_of(word) if word is not None else (None, None)
        rows = []
        for part in np.flatnonzero(np.diff(bound)).tolist():
            x = order[bound[part] : bound[part + 1]]
            rows.append((part, bucket, blob(a[x]), None if b is None else blob(b[x]), None if doc is None else blob(doc[x]), None if at is None or doc_only else blob(at[x])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT.types, strict=True)], schema=SENT) if rows else SENT.empty_table()

    def answers(self, back: dict, kind: int, a: np.ndarray):
        """Bits of the hashes sent, and for blocks the first places, in the order of ``a``."""
        order, bound = deal(a & ~U(1), self.parts)
        bits, doc, at = np.zeros(len(a), bool), np.zeros(len(a) if kind == BLOCKS else 0, np.int64), np.zeros(len(a) if kind == BLOCKS else 0, np.int32)
        for part in np.flatnonzero(np.diff(bound)).tolist():
            x = order[bound[part] : bound[part + 1]]
            b, d, p = back[kind, part]
            own = np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)).astype(bool)
            bits[x] = own
            if kind == BLOCKS:
                doc[x[own]], at[x[own]] = np.frombuffer(d, np.int64), np.frombuffer(p, np.int32)
        return bits, doc, at

    def find_blocks(self, known: np.ndarray) -> None:
        """Blocks between neighbouring anchors that are both known; ``first``: one of each different block."""
        near = (self.anchor_doc[1:] == self.anchor_doc[:-1]) & known[:-1] & known[1:]
        left = np.flatnonzero(near)
        self.begin = self.anchors[left]
        self.gap = self.anchors[left + 1] - self.begin
        # the runs at both ends and in the middle hold every word of the block
        ends, middle, last = (self.h[self.begin + x] for x in (0, self.gap // 2, self.gap))
        self.block_a = mix(ends * U(MUL) + middle * U(MUL2) + last + self.gap.astype(U))
        self.block_b = (mix(ends + middle * U(MUL) + last * U(MUL2)) >> U(32)).astype(np.uint32)
        self.first, self.number = _unique(self.block_a, self.block_b)

    def factors(self, later: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each factor, parsed greedily from the first places of the blocks."""
        doc, at = self.place_of(self.begin)
        own_doc, own_at = doc[self.first], at[self.first]
        doc1, at1 = np.where(later, ref_doc, own_doc)[self.number], np.where(later, ref_at, own_at)[self.number]
        refers = (doc1 != doc) | (at1 != at)
        goes_on = np.zeros(len(self.begin) + 1, bool)
        goes_on[1:-1] = refers[1:] & refers[:-1] & (self.begin[:-1] + self.gap[:-1] == self.begin[1:]) & (doc1[1:] == doc1[:-1]) & (at1[1:] == at1[:-1] + self.gap[:-1])
        head, tail = np.flatnonzero(refers & ~goes_on[:-1]), np.flatnonzero(refers & ~goes_on[1:])
        return self.begin[head], self.begin[tail] + self.gap[tail] + self.block

    def parse(self, back: dict) -> None:
        """Factors that hold a window, and ``inside``: the windows that lie in one."""
        self.known = self.answers(back, ANCHORS, self.keys)[0][self.key_of]
        self.find_blocks(self.known)
        head, end = self.factors(*self.answers(back, BLOCKS, self.block_a[self.first]))
        whole = end - head >= self.window
        self.head, self.end = head[whole], end[whole]
        self.inside = self.runs(self.head, self.end - self.window + 1)[self.starts]

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Flags of the words in [start, end) of any pair."""
        n = len(self.words.hash) + 1
        depth = np.bincount(start, minlength=n) - np.bincount(end, minlength=n)
        return np.cumsum(depth, out=depth)[:-1] > 0

    def boundary(self) -> None:
        """Windows to check one by one, and ``window_first``: one of each different fingerprint."""
        self.checked = self.starts[self.known[self.anchor_of] & ~self.inside]
        self.window_a = self.words.grams(self.window)[self.checked]
        self.window_b = (self.words.grams(self.window, MUL2)[self.checked] >> U(32)).astype(np.uint32)
        self.window_first, self.window_number = _unique(self.window_a, self.window_b)


def _answered(back: pa.Table) -> dict:
    return {(k, p): (b, d, a) for k, p, b, d, a in zip(*(back[c].to_pylist() for c in ("kind", "part", "bits", "doc", "at")), strict=True)}


def _joined(col: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    each = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return np.concatenate(each), np.cumsum([0, *(len(x) for x in each)])


def _reply(table: pa.Table, kind: int, flags: np.ndarray, bound: np.ndarray, doc: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.Table:
    each = [slice(a, b) for a, b in zip(bound[:-1], bound[1:], strict=True)]

    def set_only(x: np.ndarray | None) -> pa.Array:
        return pa.array([None if x is None else blob(x[s][flags[s]]) for s in each], pa.binary())

    bits = pa.array([blob(np.packbits(flags[s])) for s in each], pa.binary())
    return pa.Table.from_arrays([table["bucket"].combine_chunks(), pa.array([kind] * len(each), pa.int32()), table["part"].combine_chunks(), bits, set_only(doc), set_only(at)], schema=BACK)


def _which_repeat(table: pa.Table) -> pa.Table:
    """Anchors that occur more than once: in two buckets, or twice in one (lowest bit)."""
    release()
    values, bound = _joined(table["a"], U)
    order = np.argsort(values & ~U(1), kind="stable")
    key = values[order] & ~U(1)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    flags = np.empty(len(key), bool)
    flags[order] = same[1:] | same[:-1]
    return _reply(table, ANCHORS, flags | (values & U(1)).astype(bool), bound)


def _first_places(table: pa.Table) -> pa.Table:
    """For each block or window: is there an earlier place in another bucket? For blocks, the first one."""
    release()
    a, bound = _joined(table["a"], U)
    b, doc = _joined(table["b"], np.uint32)[0], _joined(table["doc"], np.int64)[0]
    # a bucket sends a hash once, and a document lies in one bucket, so places differ by document
    order = np.lexsort((doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    later = np.empty(len(order), bool)
    later[order] = ~new
    if table["at"].null_count:
        return _reply(table, WINDOWS, later, bound)
    at = _joined(table["at"], np.int32)[0]
    head = np.empty(len(order), np.int64)
    head[order] = order[new][np.cumsum(new) - 1]
    return _reply(table, BLOCKS, later, bound, doc[head], at[head])


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 8, carry: tuple[str, ...] = (), verbatim: bool = False, bucket_bytes: int = 3 << 20, buckets_per_part: int = 3) -> DataFrame:
    """Remove words that an earlier passage of ``window`` words covers.

    Words are maximal runs without ASCII white space, taken unchanged. A window is removed if the
    same words start earlier: in a smaller doc_id, or earlier in the same document. Windows
    are judged on the input.

    Returns one row for each input row: doc_id, n_words, n_removed, n_factors (parsed factors of ``window`` words or more),
    kept_text (kept words joined by one space). Null or empty text: no words, empty kept_text. Rows that share a doc_id count as
    one after the other in the order of a hash of their texts; a null doc_id comes before all others. Other
    columns are not read, whatever their names, but those in ``carry`` are returned too. With ``verbatim`` a
    text that loses nothing stays as it is. An empty table gives an empty result.

    ``bucket_bytes`` bounds the text in one task's group, apart from a longer single text; ``buckets_per_part`` sets how many
    buckets' worth of hashes one reducer group holds. Larger values for larger executors mean fewer, longer messages.
    """
    if window - block > 2 * block - 1:
        raise ValueError("a window must be shorter than three blocks")
    docs = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"carry_{c}") for c in carry])
    out_ddl = ", ".join([OUT_DDL, *(f"carry_{c} {docs.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)])
    rows, n = bucketed(docs, bucket_bytes)
    parts = max(1, math.ceil(n / buckets_per_part))

    def listed(key, table):
        p = _Parse(table, window, block, parts)
        return p.sent(key[0].as_py(), p.keys | p.twice)

    def blocks(key, table, back):
        if not len(table) or not len(back):
            return SENT.empty_table()
        p = _Parse(table, window, block, parts)
        p.find_blocks(p.answers(_answered(back), ANCHORS, p.keys)[0][p.key_of])
        return p.sent(key[0].as_py(), p.block_a[p.first], p.block_b[p.first], p.begin[p.first])

    def windows(key, table, back):
        if not len(table) or not len(back):
            return SENT.empty_table()
        p = _Parse(table, window, block, parts)
        p.parse(_answered(back))
        p.boundary()
        return p.sent(key[0].as_py(), p.window_a[p.window_first], p.window_b[p.window_first], p.checked[p.window_first], doc_only=True)

    def cover(key, table, back):
        if not len(table):
            return pa.table({**{f.name: pa.array([], f.type) for f in OUT}, **{f"carry_{c}": table[f"carry_{c}"] for c in carry}})
        p = _Parse(table, window, block, parts)
        w, answered = p.words, _answered(back)
        gone, n_factors = np.zeros(len(w.hash), bool), np.zeros(w.n, np.int64)
        if len(p.keys):
            p.parse(answered)
            p.boundary()
            again = np.ones(len(p.checked), bool)
            again[p.window_first] = p.answers(answered, WINDOWS, p.window_a[p.window_first])[0]
            again = p.checked[again]
            gone = p.runs(np.concatenate([p.head, again]), np.concatenate([p.end, again + window]))
            n_factors = np.bincount(np.searchsorted(w.first, p.head, "right") - 1, minlength=w.n)
        keep = ~gone
        n_kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
        texts, data = [], w.data.tobytes()
        for i in range(w.n):
            words = data[w.off[i] : w.off[i + 1]].split()
            if n_kept[i + 1] - n_kept[i] < len(words):
                words = compress(words, keep[w.first[i] : w.first[i + 1]])
            elif verbatim:
                texts.append(data[w.off[i] : w.off[i + 1]])
                continue
            texts.append(b" ".join(words))
        n_words = np.diff(w.first)
        own = pa.Table.from_arrays([p.docs["doc_id"].combine_chunks(), pa.array(n_words), pa.array(n_words - np.diff(n_kept)), pa.array(n_factors), pa.array(texts, pa.binary()).cast(pa.string())], schema=OUT)
        for c in carry:
            own = own.append_column(f"carry_{c}", p.docs[f"carry_{c}"])
        return own

    # one plan: its exchanges of the text and of the lists are reused, so each is written once
    by_bucket = rows.groupBy("bucket")
    repeats = by_bucket.applyInArrow(listed, SENT_DDL).groupBy("part").applyInArrow(_which_repeat, BACK_DDL)
    found = by_bucket.cogroup(repeats.groupBy("bucket")).applyInArrow(blocks, SENT_DDL)
    known = repeats.unionByName(found.groupBy("part").applyInArrow(_first_places, BACK_DDL))
    checked = by_bucket.cogroup(known.groupBy("bucket")).applyInArrow(windows, SENT_DDL)
    firsts = checked.groupBy("part").applyInArrow(_first_places, BACK_DDL)
    return by_bucket.cogroup(known.unionByName(firsts).groupBy("bucket")).applyInArrow(cover, out_ddl).withColumnsRenamed({f"carry_{c}": c for c in carry})


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
