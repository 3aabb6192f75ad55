"""Exact top-k inner-product search by the three-phase uniform threshold method.

A score is the sum of ``lists`` local scores, one for each slice of the dimensions. Vectors and queries
meet in the cells of a grid of blocks, so no task holds more than a bounded number of them. Both passes multiply
whole blocks, as dense products are cheaper than lookups; the cutoff bounds what is collected and sent.

1. Every block gathers the best ``k`` of each local list and resolves those entries' whole scores. The
   k-th best whole score of a query over all blocks is a safe cutoff: at least k vectors reach it.
2. The cutoff goes to every block with the queries. A vector below ``cutoff / lists`` in every list is
   below the cutoff; the others are collected.
3. A collected entry whose known local scores plus ``cutoff / lists`` for each list it did not reach stay under
   the cutoff is dropped; the scores of the rest are resolved exactly and ranked.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut
from lodestone.llm.vectors import BLOCK, QUERY_BLOCK, matrix_of, meet, slices_of, usable

#: Components of this size are multiplied apart; scores of this size don't fit, below it all sums of the method do; what stands for no cutoff.
BIG, LIMIT = 1 << 23, 1 << 61
NO_CUTOFF = -(1 << 62)
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score long"


def _local_scores(queries: np.ndarray, vectors: np.ndarray, lists: int, scale: float) -> list[np.ndarray]:
    """Integer local scores of each slice of floor(scale * x), for all pairs of rows; products of doubles while those are exact.

    Rows with a component of BIG or more are multiplied apart, with Python's integers: their whole score stands in the first list, with zeros in the
    others. Whole scores beyond LIMIT stand as plus or minus LIMIT.
    """
    with np.errstate(over="ignore"):
        q, v = np.floor(queries * scale), np.floor(vectors * scale)
    big_q, big_v = (np.flatnonzero(np.abs(x).max(axis=1, initial=0) >= BIG) for x in (q, v))
    q[big_q], v[big_v] = 0, 0
    kind = np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 1 << 53 else np.int64
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    local = [(q[:, a:b].astype(kind) @ v[:, a:b].astype(kind).T).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]

    def whole(x: float) -> int:
        return math.floor(x * scale) if math.isfinite(x * scale) else math.floor(x) * math.floor(scale)

    for rows, columns in ((big_q, np.arange(len(v))), (np.setdiff1d(np.arange(len(q)), big_q), big_v)):
        if len(rows) and len(columns):
            left, right = ([[whole(x) for x in r] for r in m.tolist()] for m in (queries[rows], vectors[columns]))
            scores = [[max(-LIMIT, min(LIMIT, sum(map(mul, r, c)))) for c in right] for r in left]
            for at, x in enumerate(local):
                x[np.ix_(rows, columns)] = scores if at == 0 else 0
    return local


def _best(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """Best k entries of each query: highest score, then smaller vec_id. Raises OverflowError if one of them does not fit."""
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    start = np.searchsorted(qid, qid, "left")
    keep = np.arange(len(qid)) - start < k
    if (score[keep] >= LIMIT).any():
        raise OverflowError("scores of these vectors do not fit in 64 bits")
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (qid, vid, score)], schema=FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest integer inner products for each query row, against all rows of ``vectors``.

    Both inputs have vec_id and embedding; components become floor(scale * x). A query's own vec_id is
    no candidate. Null vectors and those with null, NaN or infinite components take no part, nor do vectors of
    another length than the query's. Repeated rows of one vec_id count once. Ties go to the smaller vec_id; with
    fewer than k candidates all are returned. Other columns are not read. An empty table gives an empty
    result. Components of any size are multiplied exactly. Raises OverflowError where a score to be returned is 2^61 or more, or -2^61 or less.

    Returns query_id, rank (from 1), vec_id, score.
    """
    base, asked = cut(usable(vectors)), cut(usable(queries))
    sides = [int(df.agg(F.sum(F.col("dim") * 8 + 16)).first()[0] or 0) for df in (base, asked)]

    def pairs(own, questions, dim):
        """Blocks of both sides: query ids and further values, vector ids, local scores of all pairs."""
        for part in slices_of(questions, query_block):
            q_matrix = matrix_of(part["v"], dim)
            for block_of in slices_of(own, block):
                yield part, block_of["vec_id"].to_numpy(), _local_scores(q_matrix, matrix_of(block_of["v"], dim), lists, scale)

    def gather(own, questions, dim):
        for part, ids, local in pairs(own, questions, dim):
            qid = part["vec_id"].to_numpy()
            top = min(k + 1, len(ids))  # one more, as the query's own vector may be among them
            seen = np.concatenate([np.argpartition(-s, top - 1, axis=1)[:, :top] for s in local], axis=1)
            q, c = np.divmod(np.unique(np.arange(len(qid))[:, None] * len(ids) + seen), len(ids))
            q, c = q[qid[q] != ids[c]], c[qid[q] != ids[c]]
            yield _best(qid[q], ids[c], sum(s[q, c] for s in local), k)

    def collect(own, questions, dim):
        for part, ids, local in pairs(own, questions, dim):
            qid, cutoff = part["vec_id"].to_numpy(), part["cutoff"].to_numpy()
            share = np.floor_divide(cutoff, lists)[:, None]  # an integer score under it is under cutoff / lists
            reached = [s >= share for s in local]
            q, c = np.nonzero(np.logical_or.reduce(reached))
            bound = sum(np.where(r[q, c], s[q, c], share[q, 0] + 1) for r, s in zip(reached, local, strict=True))
            keep = (bound >= cutoff[q]) & (qid[q] != ids[c])
            q, c = q[keep], c[keep]
            score = sum(s[q, c] for s in local)
            keep = score >= cutoff[q]
            yield _best(qid[q[keep]], ids[c[keep]], score[keep], k)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = meet(base, asked, gather, FOUND_DDL, *sides)
    ranked = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    cutoffs = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    known = asked.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NO_CUTOFF)))
    second = meet(base, known, collect, FOUND_DDL, *sides)
    ranked = second.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    fits = F.when(F.abs("score") < LIMIT, F.col("score")).otherwise(F.raise_error(F.lit("scores of these vectors do not fit in 64 bits")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", fits.alias("score"))
