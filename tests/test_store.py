"""The stored ledger: versions, runs that die, two writers, older layouts."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.sources import store
from lodestone.sources.store import Broken, Conflict, Store


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "ledger")


def files_of(spark, *rows):
    return spark.createDataFrame(rows, "path string, sha256 string")


def test_versions(spark, root):
    s = Store(spark, root)
    assert s.current().number == 0 and s.current().tables == {}
    first = s.commit({"files": files_of(spark, ("a", "1"), ("b", "2"))}, s.current(), {"phase": "index"})
    second = s.update("files", lambda old: ledger.upserted(old, files_of(spark, ("b", "3"), ("c", "4")), "path"))
    assert (first.number, second.number, s.current()) == (1, 2, second)
    assert sorted(map(tuple, s.read("files").collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert sorted(map(tuple, s.read("files", first).collect())) == [("a", "1"), ("b", "2")]  # readers keep what they began with
    assert second.checkpoint == {"phase": "index"}
    s.set_checkpoint("hunt", 2, "h")
    again = Store(spark, root).current()
    assert again.checkpoint == {"phase": "hunt", "pass_no": 2, "config_hash": "h"} and again.tables == second.tables


def test_a_run_that_dies_before_the_pointer(spark, root, monkeypatch):
    s = Store(spark, root)
    s.commit({"files": files_of(spark, ("a", "1"))}, s.current())
    monkeypatch.setattr(s, "_point", lambda version: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.update("files", lambda old: old.limit(0))
    after = Store(spark, root)
    assert after.current().number == 1 and after.read("files").count() == 1
    # or while it writes the pointer
    with open(f"{root}/versions/{2:012d}.json", "w") as f:
        f.write('{"number": 2, "tab')
    assert after.current().number == 1 and after.read("files").count() == 1


def test_two_writers(spark, root):
    one, two = Store(spark, root), Store(spark, root)
    seen = one.commit({"files": files_of(spark, ("a", "1"))}, one.current())
    one.commit({"files": files_of(spark, ("b", "1"))}, seen)
    with pytest.raises(Conflict):
        two.commit({"files": files_of(spark, ("c", "1"))}, seen)
    calls = []

    def change(old):
        if not calls:  # another writer comes between this one's reading and writing
            one.update("files", lambda f: f.unionByName(files_of(spark, ("d", "1"))))
        calls.append(1)
        return old.unionByName(files_of(spark, ("e", "1")))

    two.update("files", change)
    assert len(calls) == 2 and sorted(r.path for r in one.read("files").collect()) == ["b", "d", "e"]
    with pytest.raises(Conflict):
        two.update("files", lambda old: (one.set_checkpoint("x"), old)[1], tries=1)


def test_keys_are_checked(spark, root):
    s = Store(spark, root)
    with pytest.raises(Broken, match="files has 2 rows"):
        s.commit({"files": files_of(spark, ("a", "1"), ("a", "2"))}, s.current())
    assert s.current().number == 0
    s.commit({"findings": spark.createDataFrame([(1, None), (2, None), (3, "k")], "id int, dedup_key string")}, s.current())
    assert s.read("findings").count() == 3  # rows without a key are not compared


def test_older_layouts(spark, root):
    """Layouts 1 and 3 side by side: defaults for what came later, one row for each key."""
    s = Store(spark, root)
    spark.createDataFrame([(1, "k", "high"), (2, "k", "low"), (3, None, "low"), (4, None, "low"), (5, "q", "low")], "id int, dedup_key string, severity string").write.parquet(f"{root}/data/f1")
    spark.createDataFrame([(1, 10)], "id int, input_tokens int").write.parquet(f"{root}/data/c1")
    spark.createDataFrame([(2, 20, 7)], "id int, input_tokens int, cache_read_tokens bigint").write.mode("append").parquet(f"{root}/data/c1")
    spark.createDataFrame([(1, 0, "xss", 3, 9)], "file_id int, chunk_index int, attack_class string, chunk_start int, chunk_end int").write.parquet(f"{root}/data/l3")
    tables = {"findings": {"folder": "data/f1", "layout": 1}, "llm_calls": {"folder": "data/c1", "layout": 1}, "cells": {"folder": "data/l3", "layout": 3}}
    s.files.mkdirs(s._path("versions"))
    with open(f"{root}/versions/{1:012d}.json", "w") as f:
        json.dump({"number": 1, "tables": tables, "checkpoint": None}, f)
    want = {
        "findings": {(1, "k", "high", None, None, None, None), (3, None, "low", None, None, None, None), (4, None, "low", None, None, None, None), (5, "q", "low", None, None, None, None)},
        "llm_calls": {(1, 10, 0, 0), (2, 20, 7, 0)},
        "cells": {(1, 0, "xss", 3, 9)},
    }
    names = {"findings": ["id", "dedup_key", "severity", "symbol", "cited_snippet", "base_severity", "base_confidence"], "llm_calls": ["id", "input_tokens", "cache_read_tokens", "cache_write_tokens"], "cells": ["file_id", "chunk_index", "attack_class", "chunk_start", "chunk_end"]}
    for t, rows in want.items():
        assert set(map(tuple, s.read(t).select(names[t]).collect())) == rows and s.read(t).count() == len(rows)
    version = s.migrate()
    assert version.number == 2 and {x["layout"] for x in version.tables.values()} == {store.LAYOUT}
    for t, rows in want.items():
        assert set(map(tuple, s.read(t).select(names[t]).collect())) == rows
    assert s.migrate().number == 2
    s.update("findings", lambda f: f.withColumn("base_confidence", F.lit(0.5)))
    assert {r.base_confidence for r in s.read("findings").collect()} == {0.5}
