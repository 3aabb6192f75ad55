"""SentencePiece (BPE) encoding and decoding with a prefix table of last tokens.

Merges in a sentencepiece BPE model join any two neighbours whose concatenation is a piece, best score
first, leftmost first among equals. So an encoding cut after any of its tokens is the
encoding of that prefix, and a sequence of pieces is an encoding exactly if each piece encodes to
itself and each neighbouring pair stays a pair. Hence every prefix has one last token:

* an Aho-Corasick automaton over the pieces lists the pieces that end at each character;
* a piece is the prefix's last token if it fits behind the last token of what precedes it: no merge over
  their border comes before the merges that made the two, which a walk down both pieces' splits tells;
* the ids are read off backwards from the end of the table.

Time is linear in the text's length. A text is cut where no piece can span (before a word mark that
follows anything else, and between letters and other characters), and the ids of segments that come again
are remembered in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from lodestone.llm.shared import slices

MARK = "▁"
#: Segments and pairs in one generation of the caches, the longest segment that is remembered, and slots of the marks of
#: segments seen once.
CACHE = 1 << 17
PAIRS = 1 << 17
SEGMENT = 64
SEEN = 1 << 20
#: A letter, as the patterns of re see it.
LETTER = r"[^\W\d_]"
NORMAL, USER, UNUSED = 1, 4, 5


class Codec:
    """Encoder of one model file. Raises ValueError for models other than plain BPE with byte fallback."""

    def __init__(self, path: str, cached: int = CACHE):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        plain = trained.model_type == 2 and trained.byte_fallback and not trained.treat_whitespace_as_suffix
        if not plain or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.dummy = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.byte = [next(i for i, p in enumerate(model.pieces) if p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.pieces = [p.piece for p in model.pieces]
        self.size = [len(p) for p in self.pieces]
        self.own = list(range(len(self.pieces)))
        self.decimal = [str(i) for i in range(len(self.pieces))]
        # the two parts whose merge made a piece, -1 for characters; a piece's place in the order of merges
        self.left, self.right, self.rank = ([-1] * len(self.pieces) for _ in range(3))
        order = sorted(self.score, key=lambda p: -self.score[p])
        for at, piece in enumerate(order):
            self.rank[self.ids[piece]] = at
        # pieces that a walk can't judge: of one score with another, made before one of their parts, or made of such
        self.odd = [False] * len(self.pieces)
        for x, y in zip(order, order[1:], strict=False):
            if self.score[x] == self.score[y] and min(len(x), len(y)) > 1:
                self.odd[self.ids[x]] = self.odd[self.ids[y]] = True
        for piece in sorted(self.ids, key=len):
            i = self.ids[piece]
            parts, made = self._merged(piece)
            if parts == [piece]:
                self.automaton.add_word(piece, i)
                if made:
                    self.left[i], self.right[i] = (self.ids[x] for x in made)
                    self.odd[i] = self.odd[i] or any(self.odd[x] or self.left[x] >= 0 and self.rank[x] >= self.rank[i] for x in (self.left[i], self.right[i]))
        self.automaton.make_automaton()
        self.segments = re.compile(self._pattern()).findall
        # two generations each: a full one becomes the older, so what is frequent stays known
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.pairs_before: dict[int, bool] = {}
        self.seen = bytearray(SEEN)
        self.cached = cached

    def _pattern(self) -> str:
        """Segments that no piece spans. Every character of a text lies in one."""
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            return "(?s).+"
        letter = re.compile(LETTER).fullmatch
        mixed = any(a != MARK and bool(letter(a)) != bool(letter(b)) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False))
        return f"(?s){MARK}*[^{MARK}]+|{MARK}+$" if mixed else f"(?s){MARK}*(?:{LETTER}+|(?:(?!{LETTER})[^{MARK}])+)|{MARK}+$"

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges of the model, step by step, and the last of them: for single pieces and pairs of pieces only."""
        made = None
        parts = list(text)
        following = [*range(1, len(parts)), -1]
        previous = list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (score := self.score.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (-score, left, right, parts[left], parts[right]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, a, b = heapq.heappop(heap)
            if parts[left] != a or parts[right] != b or following[left] != right:
                continue
            parts[left], parts[right], made = a + b, "", (a, b)
            following[left] = following[right]
            if following[right] >= 0:
                previous[following[right]] = left
            offer(previous[left], left)
            offer(left, following[left])
        return [p for p in parts if p], made

    def _known_pair(self, a: int, b: int) -> bool:
        fits = self.pairs_before.get(pair := a << 32 | b)
        if fits is None:
            fits = self._fits(a, b)
        if len(self.pairs) >= PAIRS:
            self.pairs, self.pairs_before = {}, self.pairs
        self.pairs[pair] = fits
        return fits

    def _fits(self, a: int, b: int) -> bool:
        """Does piece a stay apart from a piece b behind it?

        The parts at the border are followed from the whole pieces down: two of them would merge if their merge comes
        before the one that takes either of them up. Equal merges come from left to right.
        """
        pieces, ids, rank, left, right = self.pieces, self.ids, self.rank, self.left, self.right
        whole, until = (a, b), 1 << 60
        odd = self.odd[a] or self.odd[b]
        while not odd:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None:
                if odd := self.odd[joined]:
                    break
                if rank[joined] < until:
                    return False
            if left[a] >= 0 and (left[b] < 0 or rank[a] > rank[b]):
                until, a = rank[a], right[a]
            elif left[b] >= 0:
                until, b = rank[b] + 1, left[b]
            else:
                return True
        texts = [pieces[x] for x in whole]
        return self._merged("".join(texts))[0] == texts

    def _table(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment from its prefix table; -1: a character without a piece, which joins with nothing."""
        n = len(segment)
        last, size, known = [-1] * (n + 1), self.size, self.pairs.get
        for end, piece in self.automaton.iter(segment):
            if last[end + 1] < 0:
                at = end + 1 - size[piece]
                if at == 0:
                    last[end + 1] = piece
                elif (before := last[at]) >= 0:
                    fits = known(before << 32 | piece)
                    if fits or fits is None and self._known_pair(before, piece):
                        last[end + 1] = piece
                elif segment[at - 1] not in self.ids:
                    last[end + 1] = piece
        ids: list[int] = []
        while n:
            piece = last[n]
            if piece < 0:
                ids += [self.byte[b] for b in reversed(segment[n - 1].encode())]
                n -= 1
            else:
                ids.append(self.own[piece])
                n -= size[piece]
        ids.reverse()
        return tuple(ids)

    def _segment(self, segment: str) -> tuple[int, ...]:
        ids = self.known_before.get(segment)
        again = ids is not None
        if not again:
            ids = self._table(segment)
            # a segment is remembered when it comes again: a mark of one byte tells
            slot, mark = (h := hash(segment)) % SEEN, h >> 40 & 0xFF or 1
            again = self.seen[slot] == mark
            self.seen[slot] = mark
        if again and len(segment) <= SEGMENT:
            if len(self.known) >= self.cached:
                self.known, self.known_before = {}, self.known
            self.known[segment] = ids
        return ids

    def forget(self) -> None:
        """Drop what is remembered: Python workers live on after a task, and their memory with them."""
        self.known, self.known_before, self.seen = {}, {}, bytearray(SEEN)
        self.pairs, self.pairs_before = {}, {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text. Null: empty."""
        if not text:
            return []
        fresh = self._segment
        return list(chain.from_iterable([self.known.get(s) or fresh(s) for s in self.segments(self.dummy + text.replace(" ", MARK))]))

    def listed(self, ids: list[int]) -> str:
        """The ids as decimals joined by commas."""
        return ",".join([self.decimal[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of the input, the ids of every whole text (``piece_ids``), and whether they decode to it.

    Null and empty texts have no ids. ``model_path`` is a file that every executor has. Columns of the input with
    the names piece_ids and decodes are replaced.
    """
    kept = docs.drop("piece_ids", "decodes")

    def run(batches):
        c = codec(model_path)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [c.encode(x) for x in texts]
            same = [c.decode(i) == (x or "") for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [*batch.schema.names, "piece_ids", "decodes"])
        c.forget()

    return kept.mapInArrow(run, type(docs.schema)(list(kept.schema.fields)).add("piece_ids", T.ArrayType(T.IntegerType())).add("decodes", "boolean"))


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encode_texts`` with ``decoded``, the text that the ids stand for. Null ids: empty."""

    def run(batches):
        c = codec(model_path)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("piece_ids")).to_pylist()
            yield batch.append_column("decoded", pa.array([c.decode(x or []) for x in ids], pa.string()))

    return encoded.drop("decoded").mapInArrow(run, type(encoded.schema)(encoded.drop("decoded").schema.fields).add("decoded", "string"))


DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them.

    One row for each input row; a null text counts as empty. Ids and text stay inside the task.
    """

    def run(batches):
        c = codec(model_path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = c.encode(text.as_py())
                rows.append((doc_id, len(ids), hashlib.sha256(c.listed(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), DIGEST.types, strict=True)] if rows else [pa.array([], t) for t in DIGEST.types], schema=DIGEST)
        c.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST_DDL)
