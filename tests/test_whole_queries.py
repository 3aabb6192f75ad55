"""Audit queries run over the whole job: what caps, subsets and prefixes would leave out is there."""

from paths import DATA

from lodestone.plans import registry
from lodestone.plans.fixtures import ALL_CLASSES

SMALL = f"{DATA}/sf0.001"


def test_whole_jobs(spark):
    q = registry.QUERIES
    assert q["p7_injection_hits"](spark, SMALL).groupBy("path").count().filter("count > 3").count() > 0
    found = q["f7_located_snippets"](spark, SMALL)
    assert found.filter("found_at <> cast(split_part(claim_id, ':', -1) as int)").count() > 0
    assert found.filter("found_to > found_at").count() > 0
    assert q["j4_visited_functions"](spark, SMALL).filter("visited").count() > 0
    assert q["u5_reseeded_cells"](spark, SMALL).select("attack_class").distinct().count() == len(ALL_CLASSES)
