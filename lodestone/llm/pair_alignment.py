"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tokenizer A is a byte-level BPE file (``tokenizers`` JSON), B a sentencepiece BPE model. Both encode a space and the text. Byte offsets at which
tokens of both end cut the tokens into groups; an A and a B token occurrence are linked if they share a group.

* Documents are gathered in blocks. For each id pair that a block links there is a posting: a compressed bitmap of the block's documents (a bit
  set, or a list of places where that is shorter), and multiplicity planes: plane k holds bit k of (links - 1) for each document of the bitmap.
* Partial postings of a block (batches of texts, pieces of a long text) are merged: bitmaps by OR, planes by adding what they stand for.
* Popcounts of a block's bitmaps are its document counts, weighted popcounts of its planes its link counts. Blocks hold different documents, so
  a pair's corpus-wide count is the sum over blocks, which Spark aggregates before it shuffles; bitmaps are never gathered by pair.
* The counts go back to the blocks, and the postings return them to their documents, weighted by the planes.

Texts are cut before each space between two characters that are no white space: neither tokenizer has a token over such a place. What a segment
becomes is found once while it is remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import release, slices, written

MARK = "▁"
#: Segments that are remembered, and characters of them; characters of text handled at once; documents and bytes of text in a block.
SEGMENTS, SEGMENT_CHARS = 3 << 16, 1 << 22
PIECE = 1 << 20
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 12 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
#: How tokenizers of GPT-2's kind split a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A. Raises ValueError for files that aren't plain byte-level BPE with merges in the order of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in spec.get("added_tokens", ()) if t["special"]}}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or made != sorted(set(made)) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files with merges in the order of ids are supported")
        byte = byte_of_character()
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for word, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in word)
        self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={}).encode_ordinary


class Pieces:
    """Tokenizer B. Raises ValueError for models whose pieces may span a space, or that change the text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names) or self.library.encode(" a", out_type=str)[0][:1] != MARK:
            raise ValueError("only models whose pieces begin at spaces, with a space added in front, are supported")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each with the space that the model adds."""
        return self.library.encode(texts, num_threads=1)


@cache
def tokenizers_of(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


class Segments:
    """What segments become: their groups as text, counts, and linked pairs with the number of links."""

    def __init__(self, a: ByteLevel, b: Pieces, most: int = SEGMENTS):
        self.a, self.b, self.size_b, self.most = a, b, len(b.bytes), most
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        # decimals with what may follow them: in a group, after its A ids, after its B ids, at the end of a segment
        self.comma_a, self.bar_a = (np.array([f"{i}{end}" for i in range(len(a.bytes))], object) for end in ",|")
        self.comma_b, self.semi_b, self.bare_b = (np.array([f"{i}{end}" for i in range(len(b.bytes))], object) for end in (",", ";", ""))
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.counts = np.zeros((0, 4), np.int32)  # tokens of A, of B, groups, links
        self.spoilt, self.edge = np.zeros(0, bool), np.zeros(0, bool)  # bytes differ; begins or ends with white space, or is empty
        self.first = np.zeros(1, np.int64)  # pairs of segment s: first[s]:first[s + 1]
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep what was used more than once since the last time, up to half of what may be remembered."""
        keep = np.flatnonzero(self.used > 1)
        names = list(self.code)
        keep = keep[np.argsort(-self.used[keep], kind="stable")][: self.most // 2]
        keep = keep[np.cumsum(np.array([len(names[i]) for i in keep.tolist()], np.int64)) <= SEGMENT_CHARS // 2] if len(keep) else keep
        at, n = self.places(keep)
        self.code = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.groups, self.chars = [self.groups[i] for i in keep.tolist()], sum(map(len, self.code))
        self.counts, self.spoilt, self.edge = self.counts[keep], self.spoilt[keep], self.edge[keep]
        self.first, self.pair, self.times = np.concatenate([[0], np.cumsum(n)]), self.pair[at], self.times[at]
        self.used = np.zeros(len(keep), np.int64)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of these segments are, one segment after another, and how many each has."""
        n = self.first[codes + 1] - self.first[codes]
        return np.repeat(self.first[codes] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n

    def learn(self, texts: list[str]) -> None:
        """Segments that aren't known yet, each standing behind a space."""
        edge = [not s or s[0].isspace() or s[-1].isspace() for s in texts]
        inner = [s for s, e in zip(texts, edge, strict=True) if not e]
        ids_b = self.b.encode(texts)
        count_b = np.array([len(x) for x in ids_b], np.int64)
        flat_b = np.array([i for x in ids_b for i in x], np.int64)
        size = np.array([len(s.encode()) + 1 for s in texts], np.int64)
        # segments without white space at their edges can be encoded in one go
        at_inner, joined = np.flatnonzero(~np.array(edge)), self.a.encode("".join([" " + s for s in inner]))
        ends = np.cumsum(self.length_a[joined])
        of = at_inner[np.searchsorted(np.cumsum(size[at_inner]), ends)] if len(joined) else np.zeros(0, np.int64)
        apart = {i: self.a.encode(" " + texts[i]) for i in np.flatnonzero(edge).tolist()}
        flat_a = np.concatenate([np.array(joined, np.int64), *[np.array(x, np.int64) for x in apart.values()]])
        of_a = np.concatenate([of, *[np.full(len(x), i) for i, x in apart.items()]]).astype(np.int64)
        order = np.argsort(of_a, kind="stable")
        flat_a, of_a = flat_a[order], of_a[order]
        of_b = np.repeat(np.arange(len(texts)), count_b)
        spoilt = self._spoilt(texts, flat_a, of_a, flat_b, of_b, size)
        flat_a, of_a = flat_a[~spoilt[of_a]], of_a[~spoilt[of_a]]
        flat_b, of_b = flat_b[~spoilt[of_b]], of_b[~spoilt[of_b]]
        begins = np.concatenate([[0], np.cumsum(np.where(spoilt, 0, size))])
        end_a, end_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        at = np.searchsorted(end_b, end_a)
        common = end_a[end_b[np.minimum(at, len(end_b) - 1)] == end_a] if len(end_b) else end_b
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        of_group = np.searchsorted(begins[1:], common)
        n = len(texts)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        counts = np.zeros((n, 4), np.int32)
        counts[:, 0], counts[:, 1], counts[:, 2] = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_group, minlength=n)
        counts[:, 3] = np.bincount(of_group, weights=in_a * in_b, minlength=n)
        pair, times, of_pair = self._linked(flat_a, group_a, flat_b, group_b, of_group)
        self._texts(flat_a, group_a, flat_b, group_b, of_group, n)
        for s in texts:
            self.code[s] = len(self.code)
            self.chars += len(s)
        self.counts = np.concatenate([self.counts, counts])
        self.spoilt, self.edge = np.concatenate([self.spoilt, spoilt]), np.concatenate([self.edge, edge])
        self.used = np.concatenate([self.used, np.zeros(n, np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of_pair, minlength=n))])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times.astype(np.int32)])

    def _spoilt(self, texts, flat_a, of_a, flat_b, of_b, size) -> np.ndarray:
        """Segments whose tokens of A or B, joined, are not the segment behind a space."""
        whole = "".join([" " + s for s in texts]).encode()
        out = np.zeros(len(texts), bool)
        for flat, of, tokens in ((flat_a, of_a, self.a.bytes), (flat_b, of_b, self.b.bytes)):
            if b"".join([tokens[i] for i in flat.tolist()]) != whole:
                at = np.searchsorted(of, np.arange(len(texts) + 1))
                ids, begins = flat.tolist(), np.concatenate([[0], np.cumsum(size)]).tolist()
                for s in range(len(texts)):
                    out[s] |= b"".join([tokens[i] for i in ids[at[s] : at[s + 1]]]) != whole[begins[s] : begins[s + 1]]
        return out

    def _linked(self, flat_a, group_a, flat_b, group_b, of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of each segment and their links: within a group, the occurrences of an A id times those of a B id."""
        key_a, n_a = np.unique(group_a * len(self.a.bytes) + flat_a, return_counts=True)
        key_b, n_b = np.unique(group_b * self.size_b + flat_b, return_counts=True)
        ga, gb = key_a // len(self.a.bytes), key_b // self.size_b
        kinds_b = np.bincount(gb, minlength=len(of_group))
        first_b = np.concatenate([[0], np.cumsum(kinds_b)])
        repeat = kinds_b[ga]
        left = np.repeat(np.arange(len(key_a)), repeat)
        right = first_b[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        pair = (key_a % len(self.a.bytes))[left] * self.size_b + (key_b % self.size_b)[right]
        return _summed(of_group[ga[left]], pair, n_a[left] * n_b[right])

    def _texts(self, flat_a, group_a, flat_b, group_b, of_group, n: int) -> None:
        """The groups of each segment as text: ids of A and of B group by group."""
        in_a, in_b = np.bincount(group_a, minlength=len(of_group)), np.bincount(group_b, minlength=len(of_group))
        at_a = np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(flat_b)) + np.cumsum(in_a)[group_b]
        words = np.empty(len(flat_a) + len(flat_b), object)
        last_a, last_b = np.ones(len(flat_a), bool), np.ones(len(flat_b), bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        end = np.ones(len(of_group), bool)
        end[:-1] = of_group[1:] != of_group[:-1]
        words[at_a] = np.where(last_a, self.bar_a[flat_a], self.comma_a[flat_a])
        words[at_b] = np.where(last_b, np.where(end[group_b], self.bare_b[flat_b], self.semi_b[flat_b]), self.comma_b[flat_b])
        words = words.tolist()
        bounds = [0, *np.cumsum(np.bincount(of_group, weights=in_a + in_b, minlength=n)).astype(np.int64).tolist()]
        self.groups += ["".join(words[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]

    def codes(self, pieces: list[str]) -> list[np.ndarray]:
        """The segments of each piece of text, by number."""
        parts = [p.split(" ") for p in pieces]
        out = self._numbers(parts)
        if odd := [k for k, x in enumerate(out) if self.edge[x].any()]:
            for k in odd:
                parts[k] = CUT.split(" " + pieces[k])
                parts[k][0] = parts[k][0][1:]
            for k, x in zip(odd, self._numbers([parts[k] for k in odd]), strict=True):
                out[k] = x
        return out

    def _numbers(self, parts: list[list[str]]) -> list[np.ndarray]:
        get = self.code.get
        found = [list(map(get, p)) for p in parts]
        lacking = [k for k, x in enumerate(found) if None in x]
        if new := list(dict.fromkeys([s for k in lacking for s, c in zip(parts[k], found[k], strict=True) if c is None])):
            self.learn(new)
        for k in lacking:
            found[k] = list(map(get, parts[k]))
        return [np.array(x, np.int32) for x in found]


def _summed(major: np.ndarray, minor: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minor, sum of times, major) for each distinct (major, minor), in that order. minor < 2^40, major < 2^24."""
    key = (major.astype(np.uint64) << np.uint64(40)) | minor.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], at) if len(key) else np.zeros(0, np.int64)
    return (key[at] & np.uint64((1 << 40) - 1)).astype(np.int64), total, (key[at] >> np.uint64(40)).astype(np.int64)


# ------------------------------------------------------------------------------------ postings


@dataclass
class Postings:
    """Inverted postings of one block of ``n`` documents.

    pair: sorted pairs; docs: documents of each. Pairs with ``2 * docs > n / 8`` have a bit set (rows of ``bits``, packed), the others a list of
    places (``places``, one after another). planes: bit k of (links - 1) of the documents of all pairs with more than k plane bits (``depth``).
    """

    n: int
    pair: np.ndarray
    docs: np.ndarray
    depth: np.ndarray
    bits: bytes
    places: bytes
    planes: bytes

    @property
    def dense(self) -> np.ndarray:
        return self.docs * 2 > -(-self.n // 8)

    @classmethod
    def merged(cls, n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Postings:
        """From partial postings (place, pair, links): a document's bit is set if any part has it, and links are added up."""
        place, pair, links = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort((pair.astype(np.uint64) << np.uint64(14)) | place.astype(np.uint64), kind="stable")
        place, pair, links = place[order], pair[order], links[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(fresh)
        links = np.add.reduceat(links, at) if len(at) else links
        place, pair = place[at], pair[at]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        docs = np.diff(np.concatenate([first, [len(pair)]]))
        depth = np.array([int(x).bit_length() for x in (np.maximum.reduceat(links, first) - 1).tolist()] if len(first) else [], np.uint8)
        self = cls(n, pair[first] if len(first) else pair, docs, depth, b"", b"", b"")
        of, dense = np.repeat(np.arange(len(docs)), docs), self.dense
        row = np.cumsum(dense) - 1
        inside = dense[of] if len(of) else np.zeros(0, bool)
        bits = np.zeros((int(dense.sum()), n), bool)
        bits[row[of[inside]], place[inside]] = True
        self.bits, self.places = np.packbits(bits, axis=1).tobytes(), place[~inside].astype(np.uint16).tobytes()
        planes = [np.packbits(((links[(m := depth[of] > k)] - 1) >> k & 1).astype(bool)) for k in range(int(depth.max(initial=0)))]
        self.planes = b"".join(p.tobytes() for p in planes)
        return self

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the pair, place, links) of every document of every pair, in order."""
        dense, width = self.dense, -(-self.n // 8)
        bits = np.unpackbits(np.frombuffer(self.bits, np.uint8).reshape(int(dense.sum()), width), axis=1, count=self.n) if self.n else np.zeros((0, 0), np.uint8)
        row, column = np.nonzero(bits)
        of = np.concatenate([np.flatnonzero(dense)[row], np.repeat(np.flatnonzero(~dense), self.docs[~dense])])
        place = np.concatenate([column, np.frombuffer(self.places, np.uint16).astype(np.int64)])
        order = np.argsort(of, kind="stable")
        of, place = of[order], place[order]
        links, at = np.ones(len(of), np.int64), 0
        for k in range(int(self.depth.max(initial=0))):
            m = self.depth[of] > k
            size = -(-int(m.sum()) // 8)
            links[m] += np.unpackbits(np.frombuffer(self.planes, np.uint8, size, at), count=int(m.sum())).astype(np.int64) << k
            at += size
        return of, place, links


# ------------------------------------------------------------------------------------ jobs

BLOCKS = (
    "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "a array<int>, b array<int>, docs array<int>, links array<long>, depth binary, bits binary, places binary, planes binary"
)
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
BLOCK_SCHEMA = pa.schema(
    [("block", pa.string()), *[(n, _LONGS) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string()))]
    + [("a", _INTS), ("b", _INTS), ("docs", _INTS), ("links", _LONGS), *[(n, pa.binary()) for n in ("depth", "bits", "places", "planes")]]
)


class _Block:
    """Documents of one block as they come in."""

    def __init__(self, segments: Segments, piece: int):
        self.segments, self.piece = segments, piece
        self.ids, self.counts, self.spoilt, self.sha, self.parts, self.bytes = [], [], [], [], [], 0

    def add(self, doc_ids: list, texts: list) -> None:
        """Whole texts, long ones piece by piece."""
        pieces: list[tuple[int, str]] = []
        waiting = 0
        for doc_id, text in zip(doc_ids, texts, strict=True):
            self.ids.append(doc_id)
            self.counts.append(np.zeros(4, np.int64))
            self.spoilt.append(False)
            self.sha.append(None)
            at, text = 0, text or ""
            while at < len(text):
                cut = CUT.search(text, at + self.piece) if len(text) - at > self.piece else None
                to = cut.start() if cut else len(text)
                pieces.append((len(self.ids) - 1, text[at:to]))
                waiting, at = waiting + to - at, to + 1
                if waiting > self.piece:
                    self._take(pieces)
                    pieces, waiting = [], 0
        self._take(pieces)

    def _take(self, pieces: list[tuple[int, str]]) -> None:
        if not pieces:
            return
        s = self.segments
        if len(s.code) > s.most or s.chars > SEGMENT_CHARS:
            s.forget()
        codes = s.codes([p for _, p in pieces])
        groups = s.groups
        for (place, text), x in zip(pieces, codes, strict=True):
            self.bytes += len(text)
            self.counts[place] += s.counts[x].sum(axis=0, dtype=np.int64)
            self.spoilt[place] |= bool(s.spoilt[x].any())
            joined = ";".join([groups[i] for i in x.tolist()]).encode()
            if self.sha[place] is None:
                self.sha[place] = hashlib.sha256(joined)
            else:
                self.sha[place].update(b";" + joined)
        place = np.repeat([p for p, _ in pieces], [len(x) for x in codes])
        code = np.concatenate(codes)
        s.used += np.bincount(code, minlength=len(s.used))
        at, n = s.places(code)
        pair, links, place = _summed(np.repeat(place, n), s.pair[at], s.times[at])
        self.parts.append((place.astype(np.uint16), pair, links.astype(np.int32)))

    def row(self) -> pa.RecordBatch:
        spoilt, n = np.array(self.spoilt, bool), len(self.ids)
        parts = [tuple(x[~spoilt[p[0]]] for x in p) for p in self.parts] if spoilt.any() else self.parts
        post = Postings.merged(n, parts)
        of, _, links = post.members()
        counts = np.array(self.counts).reshape(n, 4) * ~spoilt[:, None]
        sha = ["" if bad or h is None else h.hexdigest() for bad, h in zip(self.spoilt, self.sha, strict=True)]
        total = np.zeros(len(post.pair), np.int64)
        np.add.at(total, of, links)
        values = [uuid.uuid4().hex, self.ids, *counts.T, sha, post.pair // self.segments.size_b, post.pair % self.segments.size_b, post.docs, total, post.depth.tobytes(), post.bits, post.places, post.planes]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK_SCHEMA.types, strict=True)], schema=BLOCK_SCHEMA)


def blocks(docs: DataFrame, a_path: str, b_path: str, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, piece: int = PIECE, segments: int = SEGMENTS) -> DataFrame:
    """The inverted blocks of the documents (doc_id, text), written once into the shared folder.

    A block holds up to ``block_docs`` documents (at most 2^14) and about ``block_bytes`` of text; a longer text has a block of its own, with what came before.
    Texts are handled about ``piece`` characters at a
    time, and up to ``segments`` segments are remembered in a task. Texts that are null, empty, or don't come back from the tokens of A or B are counted with zeros. Rows that share a doc_id, or have none, are rows of their own.
    """

    def run(batches):
        known, rows = Segments(*tokenizers_of(a_path, b_path), segments), min(256, block_docs)
        block = _Block(known, piece)
        for batch in slices(batches, rows):
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(block.ids) + rows > block_docs or block.bytes >= block_bytes:
                yield block.row()
                block = _Block(known, piece)
        if block.ids:
            yield block.row()
        release()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS), "aligned")


def _entries(index: DataFrame) -> DataFrame:
    """A row for each block and pair, with the pair's place in the block."""
    rows = index.select("block", F.posexplode(F.arrays_zip("a", "b", "docs", "links")).alias("at", "p"))
    return rows.select("block", "at", "p.a", "p.b", "p.docs", "p.links")


def pairs(index: DataFrame) -> DataFrame:
    """Every linked id pair of the corpus: a, b, docs (documents that hold it), links (link occurrences)."""
    return _entries(index).groupBy("a", "b").agg(F.sum(F.col("docs").cast("long")).alias("docs"), F.sum("links").alias("links"))


SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scores(index: DataFrame, counted: DataFrame) -> DataFrame:
    """Per document the contract's digest; ``counted``: the pairs of the corpus. The postings of a block return its pairs' counts to its documents."""
    counted = counted.select("a", "b", F.col("docs").alias("total"))
    best = counted.groupBy("a").agg(F.max("total").alias("best"))
    known = counted.join(best, "a").select("a", "b", "total", (F.col("total") == F.col("best")).alias("top"))
    told = _entries(index).select(F.col("block").alias("to"), "at", "a", "b").join(known, ["a", "b"]).select("to", "at", "total", "top")
    arrow = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCORES.split(", "))])

    def returned(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in own.to_pylist():
            n = len(r["doc_id"])
            post = Postings(n, np.array(r["a"]), np.array(r["docs"], np.int64), np.frombuffer(r["depth"], np.uint8), r["bits"], r["places"], r["planes"])
            at = told.column("at").to_numpy()
            total, top = np.zeros(len(post.docs), np.int64), np.zeros(len(post.docs), np.int64)
            total[at], top[at] = told.column("total").to_numpy(), told.column("top").to_numpy()
            of, place, links = post.members()
            count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(count_sum, place, links * total[of])
            np.add.at(n_best, place, links * top[of])
            columns = [r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best, count_sum, r["groups_sha256"]]
            out.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow))
        release()
        return pa.concat_tables(out) if out else arrow.empty_table()

    kept = index.drop("b", "links")
    return kept.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(returned, SCORES)


def align(docs: DataFrame, a_path: str, b_path: str, **sizes: int) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module's text)."""
    index = blocks(docs, a_path, b_path, **sizes)
    return scores(index, written(pairs(index), "pairs"))
