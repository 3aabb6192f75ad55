"""What must not be done twice: plans of the queries that were too slow on large tables."""

import re

from paths import DATA

from lodestone.operators import detect
from lodestone.plans import registry, registry_more, registry_rest  # noqa: F401 (they register their queries)

SMALL = f"{DATA}/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    return len(re.findall(r"(?m)^[ +:|-]*Relation ", planned(df)))


def test_a_baseline_makes_each_report_row_once(spark):
    df = registry.QUERIES["u2_k8_baseline_rows"](spark, SMALL)
    assert planned(df).count("get_json_object") == 1


def test_long_methods_are_left_to_the_compiler(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    registry.QUERIES["p3_rule_hits"](spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_snippets_are_sought_in_lines_squeezed_before(spark):
    assert "regexp_replace(array_join" not in planned(registry.QUERIES["f7_located_snippets"](spark, SMALL))


def test_requests_read_the_findings_once_for_each_use(spark):
    assert scans(registry.QUERIES["j13_resolved"](spark, SMALL)) <= 4


def test_results_meet_their_few_rules_where_they_are(spark):
    assert "broadcast" in planned(registry.QUERIES["s9_round_trip"](spark, SMALL))


def test_a_pattern_is_tried_only_where_its_look_up_finds_something(spark):
    assert "Contains(" in planned(registry.QUERIES["f3_masked_lines"](spark, SMALL))


def test_every_pattern_without_a_look_up_is_a_long_token():
    """masked() leaves such patterns to the search for tokens."""
    assert [label for label, _, _ in detect.SECRETS if label not in detect.NEEDED] == ["aws_secret_key"]
    assert re.search(detect.TOKEN, "Ab1/+=" * 7)
