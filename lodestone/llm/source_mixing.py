"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (equal weights) and 1 (natural weights).
The exponent is bisected: the largest that keeps the mix's entropy at a target, or the smallest
that keeps every source within a repetition limit, whichever is larger. Weights become whole token budgets.

A source's budget is realised as block permutations: its documents lie in the order of a seeded hash, in
blocks named by the hash's first digits. It gives whole passes, then the start of another: whole blocks while
they fit, and documents of the block at the cut while they fit. So cutting needs sums of blocks,
never all documents of a source in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
PARTS = 1_000_000_000
STEPS = 40


def _mixed(shares: Column, a: Column) -> Column:
    """Weights of an array of shares at exponent a."""
    powers = F.transform(shares, lambda p: F.pow(p, a))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _entropy(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def _bisect(shares: Column, good_above: bool, good) -> Column:
    """Exponent at the edge of ``good``, which holds above (or below) some exponent in [0, 1]."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(state, _):
        middle = (state["lo"] + state["hi"]) / 2
        up = ~good(_mixed(shares, middle)) if good_above else good(_mixed(shares, middle))
        return F.struct(F.when(up, middle).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return found["hi"] if good_above else found["lo"]


def _exponent(sizes: DataFrame, n: int, total: int, entropy: float | None, max_epochs: float, budget: int | None) -> float:
    """The exponent from all sources' sizes in one row."""
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("tokens", "src"))).alias("each"))
    shares = F.transform("each", lambda x: x["tokens"] / F.lit(total))

    def within(q: Column) -> Column:
        """Does no source repeat more than the limit? Ratio of weight to share, times passes over all tokens."""
        ratio = F.transform(F.arrays_zip(q.alias("q"), F.col("shares").alias("p")), lambda x: x["q"] / x["p"])
        passes = F.lit(float(budget) / total) if budget is not None else 1 / F.array_min(ratio)
        return F.array_max(ratio) * passes <= max_epochs

    found = _bisect(F.col("shares"), True, within)
    if entropy is not None:
        found = F.greatest(found, _bisect(F.col("shares"), False, lambda q: _entropy(q) >= entropy * math.log(n)))
    return listed.withColumn("shares", shares).select(found.alias("alpha")).first()[0]


def _exponent_by_jobs(sizes: DataFrame, n: int, total: int, entropy: float | None, max_epochs: float, budget: int | None) -> float:
    """The same exponent for any number of sources: each job sums over the table of sources at 15 exponents, four halvings."""
    shares = cut(sizes.select((F.col("tokens") / F.lit(total)).alias("p")))
    p = F.col("p")

    def within(a: float) -> Column:
        ratio = F.pow(p, F.lit(a - 1))
        passes = float(budget) / total / F.sum(F.pow(p, F.lit(a))) if budget is not None else 1 / F.min(ratio)
        return F.max(ratio) * passes <= max_epochs

    def diverse(a: float) -> Column:
        z = F.sum(F.pow(p, F.lit(a)))
        return F.log(z) - a * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z >= entropy * math.log(n)

    def edge(good, above: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS // 4):
            step = (hi - lo) / 16
            held = shares.agg(*[good(lo + step * i) for i in range(1, 16)]).first()
            below = next((i for i, ok in enumerate(held) if ok == above), 15)
            lo, hi = lo + step * below, lo + step * (below + 1)
        return hi if above else lo

    return max(edge(within, True), 0.0 if entropy is None else edge(diverse, False))


def weights(sizes: DataFrame, entropy: float | None, max_epochs: float, budget: int | None, most_sources: int = 100_000) -> tuple[DataFrame, int, int]:
    """(src, tokens, weight_ppb, budget) for each source of ``sizes`` (src, tokens), the number of sources and of tokens.

    Up to ``most_sources`` sizes meet in one row, where the exponent is bisected; more are summed by jobs, with the same result.
    A weight is at least one billionth.
    """
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if budget is not None and budget > max_epochs * total > 0:
        raise ValueError("the budget is beyond the repetition limit of all sources together")
    find = _exponent if n <= most_sources else _exponent_by_jobs
    alpha = find(sizes, n, total, entropy, max_epochs, budget) if n else 1.0
    rows = sizes.withColumn("power", F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)))
    whole = rows.agg(F.sum("power")).first()[0]
    rows = rows.withColumn("weight_ppb", F.greatest(F.lit(1), F.round(F.col("power") / F.lit(whole) * PARTS)).cast("long"))
    if budget is not None:
        granted = F.floor(F.col("weight_ppb").cast("decimal(38,0)") * budget / PARTS).cast("long")
    else:  # the least budget that gives every source a whole pass
        need = rows.agg(F.max(F.col("tokens") / F.col("weight_ppb"))).first()[0]
        granted = F.greatest(F.col("tokens"), F.floor(F.col("weight_ppb") * F.lit(need)).cast("long"))
    return rows.select("src", "tokens", "weight_ppb", granted.alias("budget")), n, total


def _first_over(blocks: DataFrame, rooms: DataFrame) -> DataFrame:
    """(src, block, room): each source's first block that does not fit as a whole, and the tokens it may give."""
    ordered = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("room") - F.col("until") + F.col("in_block")
    over = blocks.withColumn("until", F.sum("in_block").over(ordered)).join(rooms, "src").filter("until > room")
    return over.groupBy("src").agg(F.min(F.struct("block", left.alias("room"))).alias("at")).select("src", "at.block", "at.room")


def mix(docs: DataFrame, entropy: float | None = None, max_epochs: float = 4.0, budget: int | None = None, seed: str = "mix", digits: int | None = None, most_sources: int = 100_000) -> DataFrame:
    """The input's rows with n_tokens, weight_ppb (the source's weight in billionths), copies and block.

    n_tokens counts words (runs without ASCII white space), at least 1, so documents without text are mixed
    too. ``entropy`` is the share of the greatest possible entropy to keep; ``max_epochs`` limits how often a source may
    repeat; ``budget`` is the number of tokens to give out. Without one, it is the least that gives every source a
    whole pass: then every document has a copy. Otherwise copies may be 0. ``block`` is the place in a pass.

    A null source is a source of its own. Ties of the seeded hash of doc_id (repeated or null ids) go by
    n_tokens, then by text. Columns of the input with the new names are replaced. An empty table gives an
    empty result. ``digits`` (hex digits of a block's name) follows the number of rows if not given. Any number of
    sources is allowed: the plan of those that hold at least 1 / ``most_sources`` of the tokens (so at most that many) is broadcast.
    """
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, docs.count() / 512), 16)))
    docs = docs.drop("n_tokens", "weight_ppb", "copies", "block")
    named = docs.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    named = named.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    named = named.withColumn("block", F.substring("__h", 1, digits))
    n_tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("long")

    # the documents' tokens are counted once for the plan; what follows reads the blocks' sums
    blocks = cut(named.groupBy(F.col("__src").alias("src"), "block").agg(F.sum(n_tokens).alias("in_block")))
    sizes = blocks.groupBy("src").agg(F.sum("in_block").alias("tokens"))
    plan, n, total = weights(sizes, entropy, max_epochs, budget, most_sources)
    plan = cut(plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("room", F.col("budget") - F.col("whole") * F.col("tokens")))
    # the cut, first among groups of blocks, then among the blocks of one group
    cuts = plan.select("src", "room")
    group = F.substring("block", 1, digits // 2)
    groups = blocks.groupBy("src", group.alias("block")).agg(F.sum("in_block").alias("in_block"))
    cuts = _first_over(groups, cuts).withColumnRenamed("block", "group")
    cuts = _first_over(blocks.withColumn("group", group).join(cuts, ["src", "group"], "left_semi").drop("group"), cuts.select("src", "room"))
    plan = plan.drop("room").join(cuts, "src").select(F.col("src").alias("__src"), "tokens", "weight_ppb", F.col("whole").alias("__whole"), F.col("block").alias("__cut"), F.col("room").alias("__room"))

    large = plan.filter(F.col("tokens") >= total / most_sources).drop("tokens") if n > most_sources else plan.drop("tokens")
    joined = named.join(F.broadcast(large), "__src")
    if n > most_sources:
        others = plan.filter(F.col("tokens") < total / most_sources).drop("tokens")
        joined = joined.unionByName(named.join(F.broadcast(large.select("__src")), "__src", "left_anti").join(others, "__src"))

    def counted(df: DataFrame, more: Column) -> DataFrame:
        return df.withColumn("copies", (F.col("__whole") + more).cast("int")).select(*docs.columns, "n_tokens", "weight_ppb", "copies", "block")

    inside = Window.partitionBy("__src").orderBy("__h", "doc_id", "n_tokens", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = joined.filter(F.col("block") == F.col("__cut")).withColumn("n_tokens", n_tokens).withColumn("__upto", F.sum("n_tokens").over(inside))
    others = joined.filter(F.col("block") != F.col("__cut")).withColumn("n_tokens", n_tokens)
    return counted(others, F.when(F.col("block") < F.col("__cut"), 1).otherwise(0)).unionByName(counted(at_cut, F.when(F.col("__upto") <= F.col("__room"), 1).otherwise(0)))


def realised(mixed: DataFrame) -> DataFrame:
    """One row for each copy of a document in the mix."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
