"""Registered queries against their SQL, and the pipeline against its stages' rules."""

import collections

import pytest
import sentencepiece
from paths import DATA

from lodestone.llm import queries

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def test_pipeline(spark):
    """Brute force over the stages' own rules; the language stage is taken from its operator."""
    import corpus_pipeline as p
    from test_dedup import WORD, groups, repeats
    from test_text import MODEL, loop_mix

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id: r.asDict() for r in p.known_language(spark, docs, SMALL).collect()}
    assert len(kept) >= 0.98 * docs.count() and all(r["lang"] for r in kept.values())
    near = groups([(i, r["text"]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    cut = repeats([(i, r["text"]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if not cut[i][1] or cut[i][1] < cut[i][0]}
    mix = loop_mix([(i, r["source"], max(1, cut[i][0] - cut[i][1])) for i, r in kept.items()], 1.5, None, 0.98)
    want = collections.Counter({i: m[2] for i, m in mix.items()})
    got = p.run(spark, SMALL).collect()
    assert collections.Counter(r.doc_id for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in got:
        words = WORD.findall(library.decode(r.piece_ids))
        assert r.decodes and len(words) == cut[r.doc_id][0] - cut[r.doc_id][1] and r.n_tokens == len(r.piece_ids)
        if not cut[r.doc_id][1]:
            assert r.piece_ids == library.encode(kept[r.doc_id]["text"])
