"""Stages of the pipeline on rows that share a doc_id or have none."""

import collections
import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def _text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def shared_rows():
    """A hot doc_id with unrelated texts, copies under other ids, null ids with and without copies, texts without words."""
    near = _text(1) + " tail"
    rows = [(7, _text(i)) for i in range(100, 120)]
    rows += [(3, _text(1)), (7, near), (7, _text(2)), (9, _text(2)), (None, _text(2))]
    rows += [(None, _text(3)), (None, _text(3)), (None, _text(4)), (None, None), (None, None), (7, " "), (7, " ")]
    rows += [(8, _text(5)), (8, _text(5)), (8, _text(5) + " b"), (8, _text(5) + " a")]
    return rows


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL).repartition(3)


def test_near_duplicates_judges_rows_not_ids(spark, shared_rows):
    import corpus_pipeline as p
    from test_dedup import groups

    component = groups(list(enumerate(t for _, t in shared_rows)))
    best = {}
    for at, (i, t) in enumerate(shared_rows):
        best.setdefault(component[at][1], []).append((i is None, i or 0, t or "", at))
    want = collections.Counter(shared_rows[min(x)[3]] for x in best.values())
    got = p.without_near_duplicates(spark, _docs(spark, shared_rows), "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert sum(r.doc_id == 7 for r in got) == 23 and sum(r.doc_id is None for r in got) == 4


def test_later_stages_keep_rows_of_a_shared_id(spark):
    import corpus_pipeline as p

    passage = _text(50, 30)
    rows = [(7, _text(i)) for i in range(200, 230)] + [(7, "a " + passage), (7, "b " + passage), (None, "c " + passage), (None, _text(6)), (8, "d " + passage)]
    got = p.without_repeated_passages(spark, _docs(spark, rows), "")
    cut = {(7, "a " + passage): "a", (7, "b " + passage): "b", (8, "d " + passage): "d"}  # a null doc_id comes first
    want = collections.Counter((i, cut.get((i, t), t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    mixed = p.mixed_sources(spark, got, "")
    assert mixed.columns == p.COLUMNS and collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == want
