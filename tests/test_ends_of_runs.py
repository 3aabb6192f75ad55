"""Ends of runs, empty reports, and coverage out of a stream of reads."""

import pytest

from lodestone.operators import gate, runs
from lodestone.sources import sinks
from lodestone.streaming import reads, spend

KEY = "file_id string, name string, start_line int, end_line int"


@pytest.fixture
def functions(spark):
    return spark.createDataFrame([("a", "f", 1, 10), ("a", "g", 250, 900), ("b", "f", 1, 10), ("c", "k", 5, 4)], KEY)


def test_functions_read(spark, functions):
    log = spark.createDataFrame([("a", 10, 10), ("a", 600, 600), ("a", 1, 3), ("b", 11, 400), ("b", 5, 2), (None, 1, 5), ("b", None, 5), ("c", 1, 9)], "file_id string, start_line int, end_line int")
    got = reads.functions_read(log, functions)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "f", 1, 10), ("a", "g", 250, 900)]
    assert reads.functions_read(log.limit(0), functions).isEmpty() and reads.functions_read(log, functions.limit(0)).isEmpty()


def test_functions_read_in_a_stream(spark, functions, tmp_path):
    """Later batches tell only of functions not read before."""
    ddl = "file_id string, start_line int, end_line int"
    for i, row in enumerate([("a", 1, 2), ("a", 9, 9), ("b", 3, 3)]):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spend.event_stream(spark, str(tmp_path / "log"), ddl, files_per_trigger=1)
    told = reads.functions_read(stream, functions).writeStream.format("parquet").outputMode("append")
    told.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "f", 1, 10), ("b", "f", 1, 10)]


def test_fail_closed(spark):
    f = spark.createDataFrame([(1, "high", "new"), (2, "low", "new"), (3, "critical", "false_positive"), (4, "high", "suppressed"), (5, "medium", None), (6, None, "new")], "ord int, severity string, status string")
    assert {r.ord: r.gate for r in gate.fail_closed(f).collect()} == {1: "reportable", 2: "dropped", 3: "dropped", 4: "dropped", 5: "reportable", 6: "dropped"}


def test_finalised_again_gives_the_same(spark):
    from paths import DATA

    from lodestone.plans.fixtures import derived

    f = derived(spark, f"{DATA}/sf0.001", "findings").limit(300).selectExpr("*", "array(cast(ord as string)) as evidence").cache()
    rows = [sorted(map(str, runs.finalised(f, None, None, 0.0).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and runs.finalised(f.limit(0), None, None, 0.0).isEmpty()


def test_empty_report_replaces_an_earlier_one(spark, tmp_path):
    path = str(tmp_path / "report")
    spark.createDataFrame([("{}",)], "json string").write.text(f"{path}/findings")
    sinks.write_empty_report(spark, path, "no files")
    assert spark.read.text(f"{path}/findings").isEmpty()
    assert [tuple(r) for r in spark.read.schema("findings int, coverage double, note string").json(f"{path}/head").collect()] == [(0, 0.0, "no scan performed: no files")]
