"""Helpers that the operators share: tables, lineage cuts, word hashing in Arrow batches,
and the exchange of packed hash lists between document buckets and hash partitions.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MUL = 0x9E3779B97F4A7C15
MUL2 = 0xC2B2AE3D27D4EB4F
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sound_unions(spark: SparkSession) -> None:
    """Turn off partitioning-aware unions for the session: Spark 4.1 may leave rows of one key in several tasks under them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a temporary folder is set on a local master; on a cluster that is an error.
    """
    sound_unions(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lodestone-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(keys: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Keys to join with: broadcast while there are at most ``most`` of them, else joined by shuffle."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches, rows: int = 512):
    """Arrow batches of at most ``rows`` rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give freed Arrow memory back: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- words in Arrow batches


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


_powers: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        for key, base in (("p", MUL), ("i", pow(MUL, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"], _powers["i"]


class Words:
    """Words of a batch of texts: maximal runs without the bytes of ``gap`` (ASCII white space), hashed to 64 bits.

    ``first[d]:first[d + 1]`` are the words of text ``d``; null texts have none.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, gap: np.ndarray = SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, self.n + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off, self.data = off - off[0], data
        inner = np.zeros(len(data) + 1, bool)
        inner[self.off] = True
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(data):
            to = min(len(data), at + CHUNK)
            while to < len(data):
                gaps = np.flatnonzero(gap[data[at:to]] | inner[at:to])
                if len(gaps) and gaps[-1] > 0:
                    to = at + int(gaps[-1])
                    break
                to = min(len(data), to + CHUNK)
            s, e, h = self._hash(data[at:to], inner[at : to + 1], lower, gap)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.first = np.searchsorted(self.start, self.off)

    @staticmethod
    def _hash(data: np.ndarray, inner: np.ndarray, lower: bool, gap: np.ndarray):
        solid = ~gap[data]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:] = ~solid[:-1]
        after[:-1] = ~solid[1:]
        s = np.flatnonzero(solid & (before | inner[:-1]))
        e = np.flatnonzero(solid & (after | inner[1:])) + 1
        power, inverse = _pow_tables(len(data))
        value = (LOWER[data] if lower else data).astype(U)
        value += U(1)
        value *= power[: len(data)]
        total = np.zeros(len(data) + 1, U)
        np.cumsum(value, out=total[1:])
        return s, e, mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(MUL2))

    def grams(self, k: int, base: int = MUL) -> np.ndarray:
        """Hash of the k words from each word on (where the batch has so many)."""
        w = self.hash
        if len(w) < k:
            return w[:0]
        out = w[: len(w) - k + 1].copy()
        for j in range(1, k):
            out *= U(base)
            out += w[j : len(w) - k + 1 + j]
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """For each gram of ``grams(k)``: does it lie within one text?"""
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(max(0, len(self.hash) - k + 1))
        return at + k <= last[: len(at)]


# ------------------------------------------- hash lists between buckets and hash partitions


def bucketed(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Documents with a ``place`` of their own and a bucket number, about ``bucket_bytes`` of text in each bucket.

    The place is the doc_id where each row has one of its own. Else the rows are numbered in the order of doc_id
    (nulls first) and a hash of the text, by ranges that also split equal rows, so no doc_id fills a bucket.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("size"))
    total, most, nameless = ids.agg(F.sum("size"), F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    n = max(1, math.ceil((total or 0) / bucket_bytes))
    if (most or 0) > 1 or nameless:
        order = ["doc_id", F.xxhash64("text"), "nth"]
        ranged = docs.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
        docs = written(ranged.withColumn("place", F.monotonically_increasing_id()), "places")
    else:
        docs = docs.withColumn("place", F.col("doc_id"))
    return docs.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")), n


def deal(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts hashes by their partition, and the partitions' bounds in that order."""
    part = (mix(values) % U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def blob(x: np.ndarray) -> bytes:
    return x.tobytes()
