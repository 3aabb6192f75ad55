"""Token and cost accounting over model calls, and the dry-run projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["input", "output", "cache_read", "cache_write"]


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` of each call; missing or zero cache prices fall back to the input price, unknown models cost nothing.

    The prices are a configured table with one row for each model.
    """
    p = prices.withColumn("p_cache_read", F.when(F.col("p_cache_read") > 0, F.col("p_cache_read")).otherwise(F.col("p_input"))).withColumn("p_cache_write", F.when(F.col("p_cache_write") > 0, F.col("p_cache_write")).otherwise(F.col("p_input")))
    cost = sum((F.col(f"{k}_tokens") / 1e6 * F.coalesce(f"p_{k}", F.lit(0.0)) for k in KINDS[1:]), F.col("input_tokens") / 1e6 * F.coalesce("p_input", F.lit(0.0)))
    return calls.join(p, "model_id", "left").withColumn("cost", cost).drop(*[f"p_{k}" for k in KINDS])


def totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model, by role and in all, in one pass."""
    sums = [F.count("*").alias("calls"), *[F.sum(f"{k}_tokens").alias(f"{k}_tokens") for k in KINDS], F.sum("cost").alias("cost")]
    return calls.groupingSets([[F.col("model_id")], [F.col("role")], []], "model_id", "role").agg(*sums)


def _summed_up(calls: DataFrame, sums: dict[str, Column], by: list[str], slot: str) -> DataFrame:
    """Running sums of columns within ``by`` in the order of (ts, id).

    Two levels: sums of time slots are accumulated first, so that rows are ordered within their slot only.
    """
    c = calls.withColumn("slot", F.window("ts", slot)["start"])
    key = [*by, "slot"]
    by_slot = c.groupBy(key).agg(*[F.sum(x).alias(f"in_{n}") for n, x in sums.items()])
    earlier = Window.partitionBy(by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = by_slot.select(*key, *[F.coalesce(F.sum(f"in_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in sums])
    within = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({f"so_far_{n}": F.sum(x).over(within) for n, x in sums.items()}).join(by_slot, key)
    return c.withColumns({f"so_far_{n}": F.col(f"so_far_{n}") + F.col(f"base_{n}") for n in sums}).drop("slot", *[f"base_{n}" for n in sums])


def running(calls: DataFrame, slot: str = "1 day") -> DataFrame:
    """Running cost in the order of (ts, id)."""
    return _summed_up(calls, {"cost": F.col("cost")}, [], slot).withColumnRenamed("so_far_cost", "so_far")


def first_over(run: DataFrame, ceiling: float) -> DataFrame:
    """First call at or over the ceiling (no row if it is never reached)."""
    return run.filter(F.col("so_far") >= ceiling).agg(F.min(F.struct("ts", "id")).alias("x")).filter("x is not null").select("x.ts", "x.id")


def mismatches(calls: DataFrame) -> DataFrame:
    off = (F.col("cost") > 0) & (F.abs(F.col("reported") - F.col("cost")) > F.greatest(F.lit(0.01), 0.25 * F.col("cost")))
    return calls.agg(F.count_if(off).alias("mismatches"), F.count("*").alias("calls"))


def cumulative_by(calls: DataFrame, who: str, slot: str = "1 day") -> DataFrame:
    """Running calls, tokens and cost for each value of ``who``, by step; a frequent value is spread over its time slots."""
    sums = {"step": F.lit(1), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "cost": F.col("cost")}
    return _summed_up(calls, sums, [who], slot).select("id", who, *[F.col(f"so_far_{n}").alias(n) for n in sums])


def budget_verdict(elapsed: Column, cost: Column, passes: Column, max_time: float, max_cost: float, max_passes: int) -> Column:
    return F.when(elapsed >= max_time, "max_time").when(cost >= max_cost, "max_cost").when(passes >= max_passes, "max_passes")


def projection(n_cells: DataFrame, p_in: float, p_out: float, workers: int = 8) -> DataFrame:
    """Calls, tokens, cost and minutes of a run over ``n_cells`` (one row, column n_cells)."""
    calls = F.col("n_cells") + F.floor(F.col("n_cells") * 0.1 * 2).cast("long")
    tokens = F.col("calls") * 6000
    out = n_cells.withColumn("calls", calls).withColumn("tokens", tokens)
    out = out.withColumn("cost", F.round(F.col("tokens") * 0.85 / 1e6 * p_in + F.col("tokens") * 0.15 / 1e6 * p_out, 2))
    return out.withColumn("minutes", F.round(F.col("n_cells") * 8.0 / workers / 60, 1))


def systemic_failure(outcomes: DataFrame, workers: int) -> DataFrame:
    """One row: dominant failure class and whether the first pass failed as a whole."""
    by_kind = outcomes.filter("state = 'FAILED'").groupBy("kind").count()
    top = by_kind.agg(F.max(F.struct("count", "kind")).alias("x"), F.coalesce(F.sum("count"), F.lit(0)).alias("failed"))
    done = outcomes.agg(F.count_if(F.col("state").isin("ANALYZED", "SHALLOW")).alias("done"))
    least = max(5, workers)
    bad = (F.col("done") == 0) & (F.col("failed") >= least) & (F.col("x.count") >= least) & (F.col("x.count") >= 0.7 * F.col("failed"))
    return top.join(done).select("failed", F.col("x.kind").alias("kind"), F.coalesce(bad, F.lit(False)).alias("systemic"))


def blended_price(roles: DataFrame, judges: list[str], fallback: float = 15.0) -> DataFrame:
    """Weighted input and output price of the roles (role, p_input, p_output, billing) that do the work.

    Hunting weighs 1, each judge 0.1; without judges validation weighs 0.2. Free models cost nothing; unpriced ones the
    fallback, which also stands for no priced role at all.
    """
    weight = F.when(F.col("role") == "hunt", 1.0).otherwise(0.0)
    for j in judges:
        weight = weight + F.when(F.col("role") == j, 0.1).otherwise(0.0)
    if not judges:
        weight = weight + F.when(F.col("role") == "validate", 0.2).otherwise(0.0)
    unpriced = (F.col("p_input") <= 0) & (F.col("p_output") <= 0)

    def price(c: str) -> Column:
        return F.when(F.col("billing") == "free", 0.0).when(unpriced, fallback).otherwise(F.col(c))

    r = roles.select(weight.alias("w"), price("p_input").alias("i"), price("p_output").alias("o")).filter("w > 0")
    return r.agg(F.coalesce(F.sum(F.col("w") * F.col("i")) / F.sum("w"), F.lit(fallback)).alias("p_input"), F.coalesce(F.sum(F.col("w") * F.col("o")) / F.sum("w"), F.lit(fallback)).alias("p_output"))


def shared_judges(judges: DataFrame) -> DataFrame:
    """Judges (ord, role, model_id) that share a model with an earlier one: (model_id, first_role, role)."""
    w = Window.partitionBy("model_id").orderBy("ord")
    j = judges.withColumn("first_role", F.first("role").over(w)).withColumn("nth", F.row_number().over(w))
    return j.filter("nth > 1").select("model_id", "first_role", "role")


def unpriced_models(roles: DataFrame) -> DataFrame:
    """Metered models (role, model_id, p_input, p_output, billing) in use without a price, and the roles that use them."""
    r = roles.filter("billing <> 'free' and coalesce(p_input, 0) <= 0 and coalesce(p_output, 0) <= 0")
    return r.groupBy("model_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
