"""Pair alignment of two tokenizers against the libraries and loops over whole documents."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import pair_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = [" lead", "trail ", "  two  spaces  ", " ", "\n", "\t x", "a\x1c b\x00c", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "it's 'll we'd 3.14 -- ?!", "aaaaaaaaaaaaa" * 40, "漢字かな交じり文 🙂🙂 x", "  nbsp　wide", "é" * 300]


def loop(rows):
    """(doc_id, text) to digests, one document at a time."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = pair_alignment.byte_of_character()
    docs, held = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], collections.Counter()))
            continue
        ends = [set(np.cumsum([len(x) for x in bs]).tolist()) for bs in (bytes_a, bytes_b)]
        groups, links = [], collections.Counter()
        group = ([], [])
        at, i, j = 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            group = ([], [])
            for ids, bs, side in ((ids_a, bytes_a, 0), (ids_b, bytes_b, 1)):
                k, upto = (i, at) if side == 0 else (j, at)
                while upto < end:
                    group[side].append(ids[k])
                    upto += len(bs[k])
                    k += 1
                i, j = (k, j) if side == 0 else (i, k)
            at = end
            groups.append(group)
            links.update((x, y) for x in group[0] for y in group[1])
        held.update(links.keys())
        docs.append((doc_id, groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), n_best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held, collections.Counter(p for _, _, links in docs for p in links.elements())


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("piece,block_docs,segments", [(1 << 20, 1 << 13, 3 << 16), (64, 16, 50)])
def test_alignment(spark, docs, corpus, piece, block_docs, segments):
    """Whole texts, pieces of long texts, several blocks, a small memory of segments; rows that share an id or have none."""
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab cd' \n\té漢▁9.🙂") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    more = [(None if i % 5 == 0 else i % 3, t) for i, t in enumerate(SPECIAL + odd)]
    both = docs.select("doc_id", "text", "bucket", "copies").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"bucket": F.lit(1), "copies": F.lit("x")}))
    want, held, linked = loop([*corpus, *more])
    index = pair_alignment.blocks(both.repartition(3), A, B, block_docs=block_docs, piece=piece, segments=segments)
    counted = pair_alignment.pairs(index)
    got = [tuple(r) for r in pair_alignment.scores(index, counted).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r.a, r.b): (r.docs, r.links) for r in counted.collect()} == {p: (n, linked[p]) for p, n in held.items()}


def test_no_documents(empty):
    assert pair_alignment.align(empty, A, B).count() == 0


def test_postings_come_back():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300):
        parts = []
        want = collections.Counter()
        for _ in range(3):  # parts of the same documents: OR of bitmaps, sum of links
            place, pair, links = rng.integers(0, n, 400), rng.integers(0, 40, 400) ** 2, rng.integers(1, 9, 400)
            parts.append((place, pair, links))
            for p, q, m in zip(place.tolist(), pair.tolist(), links.tolist(), strict=True):
                want[q, p] += m
        post = pair_alignment.Postings.merged(n, parts)
        of, place, links = post.members()
        assert {(int(post.pair[i]), int(p)): int(m) for i, p, m in zip(of, place, links, strict=True)} == want
        assert post.docs.tolist() == [sum(q == x for q, _ in want) for x in post.pair.tolist()]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        pair_alignment.ByteLevel(public_tokenizers.path("word_bpe_49k.json"))
