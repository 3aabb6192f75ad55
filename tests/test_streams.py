"""Leases and the kill switch as streams: against loops, restarted from the checkpoint, replayed."""

import datetime
import random
import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.operators import costs
from lodestone.streaming import guard, leases

EVENTS = "cell string, ts double, event_id long, kind string, owner string, settled string, at timestamp"


@pytest.fixture(autouse=True)
def timers(spark):
    for k, v in leases.STREAM_CONF.items():
        spark.conf.set(k, v)
    yield
    for k in leases.STREAM_CONF:
        spark.conf.unset(k)


def put(spark, rows, folder):
    """One file, later than those before it."""
    df = spark.createDataFrame(rows, EVENTS.removesuffix(", at timestamp")).withColumn("at", F.timestamp_seconds("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def run(spark, folder):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = leases.lease_changes(events, ttl=100.0, most=3).writeStream.outputMode("update")
    q.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()


def test_leases(spark, tmp_path):
    """Several batches, stopped and started again: the same as one loop over all events, and expiry told by timers."""
    rng, folder, ts = random.Random(6), str(tmp_path), 1000.0
    files, n = [], 0
    for _ in range(6):
        rows = []
        for _ in range(40):
            ts, n = ts + rng.choice([1, 5, 40]) + 0.5, n + 1
            rows.append((f"c{rng.randint(0, 6)}", ts, n, rng.choice(["claim", "claim", "renew", "settle", "odd"]), rng.choice("xy"), rng.choice([None, "FAILED", "SHALLOW"])))
        files.append(rows)
    files.append([("last", ts + 1e6, n + 1, "claim", "x", None)])
    want, cells = {}, {}
    for c, t, i, kind, by, settled in (e for rows in files for e in rows):
        cell = cells.get(c, ("PENDING", None, None, 0))
        if cell[0] == "IN_PROGRESS" and cell[2] < t:  # run out: claimable, still the holder's until someone takes over
            cell = ("EXPIRED", *cell[1:])
        state, owner, expires, attempts = cell
        ok = kind == "claim" and state != "IN_PROGRESS" and state != "ANALYZED" and attempts < 3 or kind in ("renew", "settle") and owner == by
        if ok:
            cell = {"claim": ("IN_PROGRESS", by, t + 100, attempts + 1), "renew": ("IN_PROGRESS", owner, t + 100, attempts), "settle": (settled or "ANALYZED", None, None, attempts)}[kind]
        want[i], cells[c] = (ok, *cell[1:]), cell
    for k, rows in enumerate(files):
        put(spark, rng.sample(rows, len(rows)), f"{folder}/in")
        if k in (1, 4, 6):
            run(spark, folder)
    out = spark.read.parquet(f"{folder}/out").collect()
    assert {r.event_id: (r.accepted, r.holder, r.expires, r.attempts) for r in out if r.event_id is not None} == want
    expired = [r for r in out if r.kind == "expire"]
    assert expired and all(r.state == "EXPIRED" and r.ts == r.expires for r in expired) and len({(r.cell, r.expires) for r in expired}) == len(expired)
    # after the last event all leases but its own have run out
    held = {c for c, x in cells.items() if x[2] is not None and c != "last"}
    assert held <= {r.cell for r in expired}


def test_cells_share_state(spark, tmp_path):
    """Many cells in few buckets: each cell as if alone, each lease told once, when the watermark has passed its end; state by bucket, not by cell."""
    rng, folder, n, wm, cells, want, due = random.Random(3), str(tmp_path), 0, 0.0, {}, {}, set()
    for k in range(4):
        rows = []
        for _ in range(150):
            n += 1
            rows.append((rng.choice([None, *(f"c{i}" for i in range(80))]), 1000.0 + 50 * k + rng.randint(1, 50), n, rng.choice(["claim"] * 4 + ["renew", "settle"]), rng.choice("xy"), "FAILED"))
        put(spark, rows, f"{folder}/in")
        for c, t, i, kind, by, settled in sorted(rows, key=lambda e: e[1:3]):
            ok, cells[c] = leases.step(cells.get(c, ("PENDING", None, None, 0)), t, kind, by, settled, 25.0, 99)
            want[i] = (ok, *cells[c])
        for done in ([wm], [wm, max(e[1] for e in rows)])[k == 3]:  # at the end a batch without rows follows
            for c, (state, owner, expires, attempts) in list(cells.items()):
                if state == "IN_PROGRESS" and expires < done:
                    cells[c] = ("EXPIRED", owner, expires, attempts)
                    due.add((c, expires, k + (done != wm)))
        wm = max(e[1] for e in rows)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def started(buckets):
        q = leases.lease_changes(events, ttl=25.0, most=99, buckets=buckets).writeStream.outputMode("update").foreachBatch(lambda df, b: df.withColumn("batch", F.lit(b)).write.mode("append").parquet(f"{folder}/out"))
        q = q.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    q = started(5)
    out = spark.read.parquet(f"{folder}/out").collect()
    assert {r.event_id: (r.accepted, r.state, r.holder, r.expires, r.attempts) for r in out if r.event_id is not None} == want
    told = [(r.cell, r.expires, r.batch) for r in out if r.kind == "expire"]
    assert len(told) == len(due) > 30 and set(told) == due
    assert len(cells) == 81 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    put(spark, [(f"c{i}", 2000.0, n + i, "claim", "x", None) for i in range(1, 80)], f"{folder}/in")
    with pytest.raises(StreamingQueryException, match="written with 5 buckets, not 6"):
        started(6)


def test_lease_holds_at_its_end(spark, tmp_path):
    """As for a claim, a lease that ends just at the last event has not run out; one that ends a millisecond earlier has."""
    folder, end = str(tmp_path), 1704153600.172
    put(spark, [(f"c{ms}", end - 100 + ms / 1000, 10 + ms, "claim", "x", None) for ms in (-1000, -2, -1, 0, 1, 2)] + [("last", end, 99, "settle", "x", None)], f"{folder}/in")
    run(spark, folder)
    assert {r.cell for r in spark.read.parquet(f"{folder}/out").filter("kind = 'expire'").collect()} == {"c-1000", "c-2", "c-1"}


def calls_of(spark, folder, costs_of):
    start = datetime.datetime(2024, 1, 1)
    for k, each in enumerate(costs_of):
        rows = [(100 * k + i, start + datetime.timedelta(hours=100 * k + i), c) for i, c in enumerate(each)]
        spark.createDataFrame(rows[::-1], "id long, ts timestamp, cost double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    return spark.readStream.schema("id long, ts timestamp, cost double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_ceiling(spark, tmp_path):
    folder = str(tmp_path)
    stream = calls_of(spark, folder, [[1.0] * 5, [1.0, None, 2.0], [3.0, 1.0, 1.0, 9.0], [1.0] * 4])
    state = guard.guarded(stream, f"{folder}/out", f"{folder}/cp", 13.0, availableNow=True)
    crossing = costs.first_over(costs.running(spark.read.parquet(f"{folder}/in").fillna(0.0)), 13.0).first()
    assert (state["reason"], state["total"], state["calls"], state["last_id"]) == ("ceiling", 13.0, 11, crossing["id"])
    passed = sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect())
    assert passed == [0, 1, 2, 3, 4, 100, 101, 102, 200, 201, 202]
    more = calls_of(spark, folder, [[]] * 5 + [[1.0]])
    assert guard.guarded(more, f"{folder}/out", f"{folder}/cp", 13.0, availableNow=True) == state
    assert spark.read.parquet(f"{folder}/out").count() == 11  # it stays stopped
    with pytest.raises(RuntimeError, match=guard.STOPPED):
        guard.let_through(spark.read.parquet(f"{folder}/in"), 99, f"{folder}/out", f"{folder}/cp", 13.0, None, time.time)


def test_replayed_batch_and_restart(spark, tmp_path):
    folder = str(tmp_path)
    stream = calls_of(spark, folder, [[1.0, 1.0], [1.0, 1.0]])
    state = guard.guarded(stream, f"{folder}/out", f"{folder}/cp", 5.0, availableNow=True)
    assert (state["reason"], state["total"], state["calls"]) == (None, 4.0, 4)
    shutil.rmtree(f"{folder}/cp/commits")  # as if it had died before the last commit: the last batch comes again
    stream = calls_of(spark, folder, [[], [], [0.5, 0.5, 7.0]])
    state = guard.guarded(stream, f"{folder}/out", f"{folder}/cp", 5.0, availableNow=True)
    assert (state["reason"], state["total"], state["calls"], state["last_id"]) == ("ceiling", 5.0, 6, 201)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == [0, 1, 100, 101, 200, 201]


def test_deadline(spark, tmp_path):
    folder, ticks = str(tmp_path), iter([1.0, 2.0, 30.0, 31.0, 32.0])
    stream = calls_of(spark, folder, [[1.0], [1.0], [1.0], [1.0]])
    state = guard.guarded(stream, f"{folder}/out", f"{folder}/cp", 0.0, deadline=10.0, clock=lambda: next(ticks), availableNow=True)
    assert (state["reason"], state["total"], state["calls"]) == ("deadline", 2.0, 2)
    assert spark.read.parquet(f"{folder}/out").count() == 2
