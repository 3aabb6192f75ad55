"""Approximate nearest neighbours by learned partitions.

Fitting uses a bounded sample: its exact neighbour graph is cut into balanced parts, and a small network
learns, from each sample vector, how its neighbours spread over the parts. The index gives every row
to its most probable part; a query is sent to its several most probable parts, and only their vectors are
multiplied with it, exactly. Parts may be of any size: all their vectors are searched, in slices and blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut
from lodestone.llm.vectors import BLOCK, CELL_BYTES, QUERY_BLOCK, matrix_of, slices_of, usable

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int, rows: int = 256) -> np.ndarray:
    """Indexes of the k largest inner products of each row, itself excluded; ``rows`` rows at a time."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(0, k)), np.int32)
    for at in range(0, len(x) if k > 0 else 0, rows):
        score = x[at : at + rows] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        out[at : at + rows] = np.argpartition(score, len(x) - k, axis=1)[:, -k:]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Parts of near equal size that cut few edges: spectral halving, then moves under a size limit."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, int)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    for level in range(int(math.log2(parts))):
        value = rng.standard_normal(n)
        same = part[source] == part[target]
        s, t = source[same], target[same]
        degree = np.bincount(s, minlength=n) + np.bincount(t, minlength=n) + 1.0
        for _ in range(60):  # second eigenvector of the walk within each present part
            value = 0.5 * value + 0.5 * (value + np.bincount(s, value[t], n) + np.bincount(t, value[s], n)) / degree
            value -= (np.bincount(part, value, 1 << level) / np.maximum(1, np.bincount(part, minlength=1 << level)))[part]
            value /= np.sqrt(np.bincount(part, value**2, 1 << level) + 1e-30)[part]
        order = np.lexsort((value, part))
        rank = np.arange(n) - np.searchsorted(part[order], part[order])
        half = np.empty(n, int)
        half[order] = rank * 2 >= np.bincount(part, minlength=1 << level)[part[order]]
        part = 2 * part + half
    size, most = np.bincount(part, minlength=parts), math.ceil(slack * n / parts)
    friends = [[] for _ in range(n)]
    for a, b in zip(source, target, strict=True):
        friends[a].append(b)
        friends[b].append(a)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[friends[i]], minlength=parts) if friends[i] else np.zeros(parts)
            votes = np.where((size < most) | (np.arange(parts) == part[i]), votes, -1)
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; probabilities of the parts for each vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60, rate: float = 3e-3, seed: int = 7) -> Router:
    """Adam on the cross-entropy against soft targets."""
    rng = np.random.default_rng(seed)
    scale = 1 / max(1e-12, float(np.sqrt((x**2).sum(axis=1)).mean()))
    p = [rng.standard_normal((x.shape[1], hidden)) * math.sqrt(2) * scale, np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) / math.sqrt(hidden), np.zeros(target.shape[1])]
    moment, square, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = (dz @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                moment[j] = 0.9 * moment[j] + 0.1 * g
                square[j] = 0.999 * square[j] + 0.001 * g * g
                p[j] = p[j] - rate * (scale if j == 0 else 1) * (moment[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-9)
    return Router(*p)


def fit(sample: np.ndarray, parts: int, neighbours: int = 10) -> Router:
    graph = neighbour_graph(sample, neighbours)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph.reshape(-1)]), 1.0)
    target[np.arange(len(sample)), part] += max(1, graph.shape[1]) / 2
    return train_router(sample, target / target.sum(axis=1, keepdims=True))


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component on, so equal rows score equally."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


@dataclass
class Index:
    """Vectors of one length by part (vec_id, v, part), how many each part holds, and the router that chose the parts."""

    rows: DataFrame
    router: Router
    held: np.ndarray
    dim: int
    probes: int
    least: int

    def visits(self, y: np.ndarray) -> np.ndarray:
        """Which parts each query goes to: its ``probes`` most probable ones, and more while those hold no more than ``least`` vectors."""
        order = np.argsort(-self.router(y), axis=1, kind="stable")
        few = (np.cumsum(self.held[order], axis=1) <= self.least).sum(axis=1) + 1
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(len(self.held))[None, :] < np.maximum(self.probes, few)[:, None], axis=1)
        return out


def build(base: DataFrame, dim: int, n: int, k: int, parts: int | None = None, visit: float = 0.7, sample: int = 8192) -> Index:
    """Fit parts on a bounded sample of ``base`` (vec_id, v) and deal every row to its part."""
    if parts is None:
        parts = min(256, max(16, 1 << round(math.log2(n / 16 + 1))))
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toPandas()
    router = fit(np.stack(chosen["v"].to_numpy()).astype(np.float64), parts)

    def assign(batches):
        for batch in batches:
            part = router(matrix_of(batch["v"], dim)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    kind = base.schema["v"].dataType.simpleString()
    rows = cut(base.select("vec_id", "v").mapInArrow(assign, f"vec_id long, v {kind}, part int"))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most 256 rows
    return Index(rows, router, np.array([counts.get(i, 0) for i in range(parts)]), dim, min(parts, max(2, math.ceil(visit * parts))), k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int | None = None, visit: float = 0.7, sample: int = 8192, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The nearest k found for each query row, by largest inner product in double precision.

    ``sample`` bounds the rows that the partition is fitted on (the least hashes of vec_id). ``parts`` defaults to a power of two near a sixteenth of the number
    of vectors, from 16 to 256; ``visit`` is the share of parts that a query visits (at least 2). While the visited parts hold no more than k
    vectors, a query visits further ones. Queries are sent to the parts that they visit, and to no other.

    Vectors that are null, zero or hold null, NaN or infinite components take no part, nor do vectors of another
    length than the query's; each length has an index of its own, and only lengths that are asked for. A query's own vec_id is no candidate; repeated rows of
    one vec_id count once; ties go to the smaller vec_id. Empty tables give an empty result.

    Returns query_id, rank (from 1), vec_id, score.
    """
    base = cut(usable(vectors, nonzero=True))
    asked = cut(usable(queries, nonzero=True))
    found = vectors.sparkSession.createDataFrame([], FOUND_DDL)
    lengths = base.groupBy("dim").count().join(F.broadcast(asked.groupBy("dim").agg(F.count("*").alias("n_asked"))), "dim")
    for dim, n, n_asked in lengths.orderBy("dim").collect():  # one row for each length of vectors
        index = build(base.filter(F.col("dim") == dim), dim, n, k, parts, visit, sample)
        found = found.unionByName(_search_index(index, asked.filter(F.col("dim") == dim), n_asked, k, block, query_block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_index(index: Index, asked: DataFrame, n_asked: int, k: int, block: int, query_block: int) -> DataFrame:
    """Candidates of every query from the parts that it visits.

    A part of many vectors is dealt over slices, and very many queries over columns: a task meets one slice of one part with one column of the queries that
    visit it.
    """
    size = index.dim * 8 + 16
    slices = [max(1, math.ceil(h * size / CELL_BYTES)) for h in index.held.tolist()]
    columns = max(1, math.ceil(n_asked * size / CELL_BYTES))
    of_part = F.array(*[F.lit(x) for x in slices])[F.col("part")]

    def route(batches):
        for batch in batches:
            visits = index_.visits(matrix_of(batch["v"], index_.dim))
            at = pa.array([np.flatnonzero(v).astype(np.int32) for v in visits], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], at], ["vec_id", "v", "parts"])

    index_ = Index(None, index.router, index.held, index.dim, index.probes, index.least)  # without its table, for the tasks
    kind = asked.schema["v"].dataType.simpleString()
    routed = asked.select("vec_id", "v").mapInArrow(route, f"vec_id long, v {kind}, parts array<int>").select("vec_id", "v", F.explode("parts").alias("part"))
    right = routed.withColumn("slice", F.explode(F.sequence(F.lit(0), of_part - 1))).withColumn("column", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(columns)).cast("int"))
    left = index.rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), of_part).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))

    def rerank(own, questions):
        for question in slices_of(questions, query_block):
            qid, y = question["vec_id"].to_numpy(), matrix_of(question["v"], index_.dim)
            for piece in slices_of(own, block):
                ids, x = piece["vec_id"].to_numpy(), matrix_of(piece["v"], index_.dim)
                rough = y @ x.T
                near = min(k + 1, len(ids))
                worst = np.partition(rough, len(ids) - near, axis=1)[:, len(ids) - near]
                margin = 1e-12 * np.sqrt((y**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
                q, c = np.nonzero(rough >= (worst - margin)[:, None])
                keep = qid[q] != ids[c]
                q, c = q[keep], c[keep]
                for at in range(0, max(1, len(q)), 1 << 18):
                    yield _best(qid[q[at : at + (1 << 18)]], ids[c[at : at + (1 << 18)]], _exact(y[q[at : at + (1 << 18)]], x[c[at : at + (1 << 18)]]), k)

    def cell(own, questions):
        """The best k of each query over one slice of a part."""
        each = pa.Table.from_batches([*rerank(own.sort_by("vec_id"), questions.sort_by("vec_id"))] if len(own) and len(questions) else [], FOUND)
        return pa.Table.from_batches([_best(*(each[c].to_numpy() for c in ("query_id", "vec_id", "score")), k)])

    key = ["part", "slice", "column"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(cell, FOUND_DDL)


def _best(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    keep = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (qid, vid, score)], schema=FOUND)
