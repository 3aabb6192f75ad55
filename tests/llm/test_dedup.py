"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import re

import pytest

from lodestone.llm import jaccard_join, substring_dedup
from lodestone.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            k = tuple(words[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(t):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(x), find(i)) for i, x in sets.items()}


@pytest.mark.parametrize("bucket_bytes", [300, 4000, 1 << 20])
def test_substring_dedup(docs, corpus, bucket_bytes):
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, bucket_bytes=bucket_bytes, buckets_per_part=3))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == repeats(corpus)


def test_carried_columns_and_verbatim_texts(docs, corpus):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, carry=("source", "bucket"), verbatim=True, bucket_bytes=2000).collect()}
    for i, t in corpus:
        assert got[i].source == (f"s{i % 3}" if i % 7 else None) and got[i].bucket == 1
        if not got[i].n_removed:
            assert got[i].kept_text == (t or "")


def test_repeated_and_null_ids(spark):
    long = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(False, 30, 30), (False, 30, 30), (True, 0, 0), (True, 30, 0)]
    near = sorted((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect() if r.doc_id is not None)
    assert near == [(5, 5), (5, 5)]


@pytest.mark.parametrize("bucket_bytes,block", [(300, 3), (1 << 20, 512)])
def test_jaccard_join(docs, corpus, bucket_bytes, block):
    got = jaccard_join.near_duplicates(docs, bucket_bytes=bucket_bytes, buckets_per_part=3, block=block)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == groups(corpus)


def test_threshold_is_exact(spark):
    """Sets of 7 with 6 shared n-grams: 6 / 8 is exactly 75 percent; one less is not."""
    a = [f"a{i}" for i in range(11)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:10], "z"])), (3, " ".join([*a[:9], "y", "y2"]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in groups(rows).items()} and got[2] == 1


@pytest.mark.parametrize("bucket_bytes", [50, 1 << 20])
def test_rows_without_id_carry_links(spark, bucket_bytes):
    """1 and 3 are linked only through a row without doc_id; rows that share a doc_id are judged row by row."""
    w = [f"w{i}" for i in range(28)]
    a, b, c = " ".join(w), " ".join([*w[:26], "p", "q"]), " ".join(["r", "s", *w[2:26], "p", "q"])
    assert groups([(1, a), (2, b), (3, c)])[3][1] == 1 and groups([(1, a), (3, c)])[3][1] == 3
    other = " ".join(f"o{i}" for i in range(9))
    rows = [(1, a), (None, b), (None, b), (3, c), (5, a + " more"), (5, other), (None, other + " end"), (7, "alone"), (None, "also alone"), (None, None)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=bucket_bytes)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got.collect())
    assert got == sorted([(1, 24, 1), (0, 24, 1), (0, 24, 1), (3, 24, 1), (5, 25, 1), (5, 5, 5), (0, 6, 5), (7, 1, 7), (0, 1, 0), (0, 0, 0)])


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = dict((r.node, r.component) for r in connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 52: 50}
