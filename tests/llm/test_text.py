"""Tokeniser, language ID, quality, mixing and chat formatting."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from paths import DATA
from pyspark.sql import functions as F

from lodestone.llm import chat_format, language_id, piece_codec, quality, source_mixing
from lodestone.llm.shared import Words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_the_library(library):
    codec = piece_codec.Codec(MODEL, cached=50)
    rng = random.Random(2)
    letters = "abcdefghij  \n\t▁éßñ中文日本🙂\u0000​.,0123456789ABCthe ingtion"
    texts = ["", " ", "   a", "a  ", "▁", "▁▁ a", "x" * 3000, " " * 3000, "ab" * 2000, "<s></s><0x0A>", "<unk>", "日本語" * 400]
    for _ in range(3000):
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
        texts.append("".join(rng.choice(codec.pieces) for _ in range(rng.randint(1, 10))))
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t), repr(t[:80])
        assert codec.decode(ids) == library.decode(library.encode(t))
    assert codec.encode(None) == []


def test_codec_queries(docs, corpus, empty, library):
    want = {}
    for i, t in corpus:
        ids = library.encode(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in piece_codec.digest(docs, MODEL).collect()} == want
    rows = piece_codec.decode_ids(piece_codec.encode_texts(docs, MODEL), MODEL)
    for r in rows.collect():
        assert r.piece_ids == library.encode(r.text or "") and r.decoded == library.decode(r.piece_ids) and r.decodes == (r.decoded == (r.text or "")) and r.copies == "x"
    assert piece_codec.digest(empty, MODEL).count() == 0 and piece_codec.encode_texts(empty, MODEL).count() == 0


def test_words_split_like_bytes():
    import pyarrow as pa

    texts = [None, "", " a  b\tc\r\n", "é\u00a0x y", "A b A", "q" * 5000]
    w = Words(pa.array(texts))
    assert [w.first[i + 1] - w.first[i] for i in range(len(texts))] == [len((t or "").encode().split()) for t in texts]
    assert w.hash[w.first[4]] == w.hash[w.first[4] + 2] != w.hash[w.first[4] + 1]


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = language_id.fit(table, sample=1200)
    got = language_id.predict(table, model).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs, empty):
    few = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)], "doc_id long, text string, lang string")
    model = language_id.fit(few)
    odd = spark.createDataFrame([(None, "the dog"), (1, None), (2, ""), (3, "12 34 !!"), (4, "漢字"), (5, "the the and " * 20000)], "doc_id long, text string").withColumn("score", F.lit("own"))
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in language_id.predict(odd, model).collect()}
    assert got[1][:2] == got[2][:2] == got[3][:2] == ("und", 0.0) and got[None][0] == "en" and got[None][2] and got[5][0] == "en" and got[4][0] in ("de", "en")
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    assert language_id.fit(few.filter("lang = 'en'")).decode(np.zeros((1, language_id.FEATURES), np.float32))[0][0] == 0


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    v = np.where(rng.random((20000, 5)) < right, good[:, None], ~good[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = quality.ABSTAIN
    patterns, n = np.unique(quality.pattern_of(v), return_counts=True)
    model = quality.estimate(quality.votes_of(patterns, 5), n)
    found = model.chance[1, :, 1] / (model.chance[1, :, 0] + model.chance[1, :, 1])
    assert np.abs(found - right).max() < 0.03 and abs(model.prior - 0.8) < 0.02


def test_quality_on_labels_and_edges(spark, docs, corpus, empty):
    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    got = quality.score(table, sample=800).join(labels, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in got) / len(got) > 0.95
    assert all(r.keep for r in got if r.quality == 1)
    mine = {r.doc_id: r for r in quality.score(docs).collect()}
    assert len(mine) == len(corpus) and all(mine[i].score == 0 and not mine[i].keep for i, t in corpus if not (t or "").split())
    assert quality.score(empty).count() == 0


def loop_mix(rows, max_epochs, budget, entropy, seed="mix"):
    """rows: (doc_id, source, tokens)."""
    tokens = defaultdict(int)
    for _, s, n in rows:
        tokens[s] += n
    p = {s: n / sum(tokens.values()) for s, n in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def limit(a):
        w = weights(a)
        ratio = [w[s] / p[s] for s in p]
        return max(ratio) * (budget / sum(tokens.values()) if budget else 1 / min(ratio)) <= max_epochs

    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if limit(mid) else (mid, hi)
    a = hi
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        good = -sum(x * math.log(x) for x in weights(mid).values()) >= entropy * math.log(len(p))
        lo, hi = (mid, hi) if good else (lo, mid)
    w = {s: round(x * 1e9) for s, x in weights(max(a, lo)).items()}
    need = max(tokens[s] / w[s] for s in w)
    out = {}
    for s in tokens:
        b = w[s] * budget // 10**9 if budget else max(tokens[s], math.floor(w[s] * need))
        whole, rest, upto = b // tokens[s], b % tokens[s], 0
        for h, i, n in sorted((hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), i, n) for i, t, n in rows if t == s):
            upto += n
            out[i] = (n, w[s], whole + (upto <= rest))
    return out


@pytest.mark.parametrize("budget,digits", [(None, 1), (None, 3), (6000, 2)])
def test_mixing(docs, corpus, empty, budget, digits):
    rows = [(i, f"s{i % 3}" if i % 7 else None, max(1, len((t or "").encode().split()))) for i, t in corpus]
    got = source_mixing.mix(docs, entropy=0.9, max_epochs=3, budget=budget, digits=digits)
    assert {r.doc_id: (r.n_tokens, r.weight_ppb, r.copies) for r in got.collect()} == loop_mix(rows, 3, budget, 0.9)
    if budget is None:
        assert got.filter("copies < 1").count() == 0
    assert source_mixing.realised(got).count() == got.agg(F.sum("copies")).first()[0]
    assert source_mixing.mix(empty).count() == 0


@pytest.mark.parametrize("budget,entropy", [(None, 0.9), (6000, 0.9), (6000, None)])
def test_many_sources_are_mixed_alike(docs, empty, budget, entropy):
    """Sources beyond the number whose sizes meet in one row: summed by jobs, joined by shuffle, with the same rows."""
    few = source_mixing.mix(docs, entropy=entropy, max_epochs=3, budget=budget, digits=2)
    many = source_mixing.mix(docs, entropy=entropy, max_epochs=3, budget=budget, digits=2, most_sources=3)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect()))
    assert source_mixing.mix(empty, entropy=0.9, most_sources=0).count() == 0


def test_mixing_refuses_what_it_cannot_do(docs):
    with pytest.raises(ValueError):
        source_mixing.mix(docs, budget=10**9, max_epochs=2.0)


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo 🙂"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 5, None, "who"), (None, None, "bob", "first"), (3, 700, "ann", "late"), (3, 2, "", "early")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("own")).withColumn("run", F.lit(1))
    got = defaultdict(list)
    for r in chat_format.perspectives(df).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (None, "bob"), (3, "ann"), (3, "unknown")}
    for (conv, who), rows in got.items():
        rows.sort(key=lambda r: r.char_start)
        whole = "".join(r.rendered for r in rows)
        mine = sorted(((t if t is not None else -1, s or "unknown", x or "") for c, t, s, x in turns if c == conv))
        assert len(rows) == len(mine)
        for r, (_, s, x) in zip(rows, mine):
            assert whole[r.char_start :].startswith(r.rendered)
            if s == who:
                assert r.role == "assistant" and whole[r.mask_start : r.mask_end] == x + "<|im_end|>"
            else:
                assert r.mask_start is None and r.role == ("system" if s == "system" else "user") and r.name == (None if s == "system" else s)
    assert chat_format.perspectives(df.limit(0)).count() == 0


def test_quality_votes_and_labels_equal_loops(spark, docs, corpus):
    """Votes by loops over each text, and posteriors by loops over the counted patterns, at the registered setting."""

    def three(bad, good):
        return quality.BAD if bad else quality.GOOD if good else quality.ABSTAIN

    def pattern(text):
        raw = (text or "").encode()
        w = [x for x in raw.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if x]
        n = max(1, len(w))
        if not w:
            v = [quality.ABSTAIN] * 5 + [quality.BAD]
        else:
            letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw) / len(raw)
            symbols = sum(chr(b) in "#$%&*|@^~<>{}[]\\_=+" for b in raw) / n
            variety = len(set(w)) / n / min(1, 3 * n**-0.15)
            repeats = sum(a == b for a, b in zip(w, w[1:])) / n
            size = sum(map(len, w)) / n
            v = [three(letters < 0.65, letters > 0.75), three(symbols > 0.3, symbols < 0.05), three(variety < 0.3, variety > 0.5), three(repeats > 0.2, repeats < 0.05), three(size < 2 or size > 12, 3 < size < 9), three(len(w) < 5, len(w) >= 50)]
        return sum(x * 3**i for i, x in enumerate(v))

    got = {r.doc_id: r for r in quality.score(docs).collect()}
    want = {i: pattern(t) for i, t in corpus}
    assert {i: r.votes for i, r in got.items()} == want
    patterns, n = np.unique(list(want.values()), return_counts=True)
    model = quality.estimate(quality.votes_of(patterns, 6), n.astype(float))
    for i, r in got.items():
        good, bad = model.prior, 1 - model.prior
        for j, v in enumerate(quality.votes_of(np.array([want[i]]), 6)[0]):
            good, bad = good * model.chance[1, j, v], bad * model.chance[0, j, v]
        assert abs(r.weak_label - good / (good + bad)) < 1e-9


def test_learned_accuracies_follow_the_labels(spark):
    """At the registered setting, each labeller's estimated votes by class lie near those counted with true labels."""
    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id", "left").select("text", "quality").toPandas()
    v = quality.votes(Words(pa.array(table["text"].tolist(), pa.string())))
    patterns, n = np.unique(quality.pattern_of(v), return_counts=True)
    model = quality.estimate(quality.votes_of(patterns, 6), n.astype(float))
    for c in (0, 1):
        own = v[(table["quality"] == c).to_numpy()]
        true = np.stack([np.bincount(own[:, j], minlength=3) / len(own) for j in range(6)])
        assert np.abs(model.chance[c] - true).mean() < 0.06


def test_language_decoding_equals_loops(spark, docs, corpus):
    few = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 40)], "doc_id long, text string, lang string")
    model = language_id.fit(few)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, t in corpus:
        if not any(ch.isalpha() for ch in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = language_id.features([t])[0].astype(float)
        losses = []
        for code, trust in zip(model.code, model.trust):
            margins = [sum(x[f] * model.weights[f, b] for f in np.flatnonzero(x)) + model.bias[b] for b in range(len(code))]
            losses.append(sum(w * math.log1p(math.exp(-m * c)) for w, m, c in zip(trust, margins, code)))
        shares = [math.exp(-4 * (loss - min(losses))) for loss in losses]
        top = max(shares) / sum(shares)
        assert abs(got[i].score - top) < 1e-3
        if sorted(shares)[-2] / sum(shares) < top - 1e-3:
            assert got[i].lang_pred == model.languages[losses.index(min(losses))]


def test_packed_features_come_back():
    x = language_id.features(["some text", "", None, "été " * 50])
    rows = np.zeros(x.shape, np.float16)
    for row, out in zip(x, rows, strict=True):
        language_id.unpack(language_id.packed(row), out)
    assert (rows == x.astype(np.float16)).all()
