"""The kill switch: a stream of priced calls that ends itself at a cost ceiling or a deadline, and stays ended."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.costs import first_over, running

STATE = "batch long, total double, calls long, reason string, last_ts timestamp, last_id long"
STOPPED = "the kill switch is on"


def state_of(spark: SparkSession, checkpoint: str, before: int | None = None) -> dict:
    """The guard's state after the last batch (before batch ``before``): total cost, calls let through, reason (null while it runs)."""
    path = f"{checkpoint}/guard"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    none = {"batch": -1, "total": 0.0, "calls": 0, "reason": None, "last_ts": None, "last_id": None}
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return none
    rows = spark.read.schema(STATE).json(f"{path}/*")
    last = (rows if before is None else rows.filter(F.col("batch") < before)).orderBy(F.desc("batch")).first()
    return last.asDict() if last else none


def let_through(calls: DataFrame, batch: int, path: str, checkpoint: str, ceiling: float, deadline: float | None, clock: Callable[[], float]) -> str | None:
    """One batch: calls up to the one that reaches the ceiling go to ``path``; the state of the batch is kept beside the checkpoint. Gives the reason to stop, if there is one.

    A batch that is run again finds the state before it and writes the same files anew, so no call counts twice.
    """
    spark = calls.sparkSession
    state = state_of(spark, checkpoint, batch)
    if state["reason"]:
        raise RuntimeError(f"{STOPPED}: {state['reason']}")
    if deadline is not None and clock() >= deadline:
        passed, after = calls.limit(0), state | {"reason": "deadline"}
    else:
        run = running(calls.withColumn("cost", F.coalesce("cost", F.lit(0.0)))).withColumn("so_far", F.col("so_far") + state["total"])
        over = first_over(run, ceiling).first() if ceiling > 0 else None
        passed = run.filter((F.col("ts") < over["ts"]) | (F.col("ts") == over["ts"]) & (F.col("id") <= over["id"])) if over else run
        sums = passed.agg(F.coalesce(F.max_by("so_far", F.struct("ts", "id")), F.lit(state["total"])).alias("total"), F.count("*").alias("calls"), F.max(F.struct("ts", "id")).alias("x")).first()
        last = sums["x"] or {"ts": state["last_ts"], "id": state["last_id"]}
        after = {"total": sums["total"], "calls": state["calls"] + sums["calls"], "reason": "ceiling" if over else None, "last_ts": last["ts"], "last_id": last["id"]}
    passed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    spark.createDataFrame([(batch, *(after[n] for n in ("total", "calls", "reason", "last_ts", "last_id")))], STATE).coalesce(1).write.mode("overwrite").json(f"{checkpoint}/guard/{batch:012d}")
    return after["reason"]


def guarded(calls: DataFrame, path: str, checkpoint: str, ceiling: float, deadline: float | None = None, clock: Callable[[], float] = time.time, poll: float = 0.2, **trigger) -> dict:
    """Run a stream of calls (id, ts, cost) until it ends, the ceiling is reached (0: none) or the deadline has come; the guard's last state.

    The call that reaches the ceiling is the last to be let through, in the batch in which it comes; then the query is stopped. A later start finds the
    state and does not begin. Calls are summed in the order of (ts, id) within a batch, and batches as they come. ``trigger``: as for a stream, for
    instance availableNow=True.
    """
    spark = calls.sparkSession
    if state_of(spark, checkpoint)["reason"]:
        return state_of(spark, checkpoint)

    reasons: list[str] = []  # told by the batches themselves: their files may be being written anew

    def each(batch: DataFrame, n: int) -> None:
        if reason := let_through(batch, n, path, checkpoint, ceiling, deadline, clock):
            reasons.append(reason)

    query = calls.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    try:
        while not query.awaitTermination(poll):
            if reasons:
                query.stop()
    except StreamingQueryException as e:
        if STOPPED not in str(e):
            raise
    return state_of(spark, checkpoint)
