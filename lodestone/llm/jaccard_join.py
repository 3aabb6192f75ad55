"""Exact Jaccard join of word n-gram sets by prefix trees over globally ordered sets.

1. Every bucket of documents lists the hashes of its n-grams once; reducers by hash add up in
   how many texts each occurs and send back a size class (4 bits). The global order of
   n-grams is (size class, hash): rare ones first.
2. A set can only reach the threshold if that share of it occurs elsewhere. Other documents are
   done: they link with nothing. Equal sets become one class.
3. The first ``n - ceil(threshold * n) + 1`` n-grams of two linked sets, in the global order, share
   one. The classes that hold one n-gram there are its group. Each group has a prefix tree of ordered
   sets; a probe walks it, adding up the overlap of shared paths, and leaves a subtree when the overlap plus what
   remains of either set cannot reach the threshold, or when all of it is linked to the probe already.
4. First every class goes to a few of its largest groups only, in blocks of bounded size, dealt anew for each
   group. That joins most copies. A group is then done if its classes have one label, or met in one tree.
5. Each group left is met in whole: by one tree, or, if it is larger than a block, by a grid of
   trees in which classes of the group's main label need not meet each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected
from lodestone.llm.shared import U, Words, blob, bucketed, cut, deal, mix, release

SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("list", pa.binary())])
SENT_DDL = "part int, bucket int, list binary"
BACK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("levels", pa.binary())])
BACK_DDL = "bucket int, part int, levels binary"
SETS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("grams", pa.binary()), ("levels", pa.binary()), ("prefix", pa.list_(pa.int64()))])
SETS_DDL = "doc_id long, tag long, n_shingles long, set_key binary, grams binary, levels binary, prefix array<long>"
LABELS = pa.schema([("label", pa.int64()), ("root", pa.int64())])


def gram_sets(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with 1 to k - 1 words has one, of all its words."""
    w = Words(texts, lower=True)
    h = w.grams(k)
    out = []
    for i in range(w.n):
        a, e = int(w.first[i]), int(w.first[i + 1])
        if e - a >= k:
            out.append(np.unique(h[a : e - k + 1]))
        elif e > a:
            short = U(e - a)
            for x in w.hash[a:e]:
                short = mix(np.array([short ^ x], U))[0]
            out.append(np.array([short], U))
        else:
            out.append(np.zeros(0, U))
    return out


def _count_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n)).astype(np.int64)


class _Listed:
    """A bucket's distinct n-grams, dealt to hash partitions as 29 bits of hash and 3 of count."""

    def __init__(self, table: pa.Table, k: int, parts: int):
        release()
        self.sets = gram_sets(table["text"], k)
        every = np.concatenate([*self.sets, np.zeros(0, U)])
        self.values, self.inverse, n = np.unique(every, return_inverse=True, return_counts=True)
        self.order, self.bound = deal(self.values, parts)
        low = (mix(self.values ^ U(0x5BD1E995)) & U(0xFFFFFFF8)).astype(np.uint32)
        self.entries = (low | np.minimum(_count_class(n), 7).astype(np.uint32))[self.order]

    def levels(self, back: pa.Table) -> np.ndarray:
        out = np.zeros(len(self.values), np.uint8)
        for part, packed in zip(back["part"].to_pylist(), back["levels"].to_pylist(), strict=True):
            at = self.order[self.bound[part] : self.bound[part + 1]]
            nibbles = np.frombuffer(packed, np.uint8)
            out[at] = np.stack([nibbles >> 4, nibbles & 15], 1).reshape(-1)[: len(at)]
        return out[self.inverse]


def _add_up(table):
    """Size class of every listed hash over all buckets; hashes that fall together count together."""
    lists = [np.frombuffer(x, np.uint32) for x in table["list"].to_pylist()]
    every = np.concatenate(lists)
    order = np.argsort(every & np.uint32(0xFFFFFFF8), kind="stable")
    key, n = every[order] & np.uint32(0xFFFFFFF8), (1 << (every[order] & np.uint32(7))).astype(np.int64)
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    total = np.add.reduceat(n, np.flatnonzero(start)) if len(key) else n
    level = np.empty(len(key), np.uint8)
    level[order] = np.minimum(_count_class(total), 15).astype(np.uint8)[np.cumsum(start) - 1]
    rows, at = [], 0
    for x in lists:
        own = level[at : at + len(x)]
        at += len(x)
        own = np.concatenate([own, np.zeros(len(own) % 2, np.uint8)])
        rows.append(blob(own[0::2] << 4 | own[1::2]))
    return pa.Table.from_arrays([table["bucket"].combine_chunks(), table["part"].combine_chunks(), pa.array(rows, pa.binary())], schema=BACK)


def _needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of a and b n-grams with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Path-compressed tree of ordered sets. Nodes: [grams, children by first gram, shortest and longest whole set, members, component]."""

    def __init__(self, percent: int, parent: list[int], vocabulary: int):
        self.root: list = [np.zeros(0, np.int64), {}, 1 << 60, 0, [], None]
        self.percent, self.parent = percent, parent
        self.mark = np.zeros(vocabulary, bool)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, grams: np.ndarray, size: int, member: int) -> None:
        node, at = self.root, 0
        self._touch(node, size, member)
        while at < len(grams):
            child = node[1].get(int(grams[at]))
            if child is None:
                child = [grams[at:], {}, 1 << 60, 0, [], member]
                node[1][int(grams[at])] = child
                at = len(grams)
            else:
                edge = child[0]
                most = min(len(edge), len(grams) - at)
                differ = np.flatnonzero(edge[:most] != grams[at : at + most])
                same = int(differ[0]) if len(differ) else most
                if same < len(edge):
                    low = [edge[same:], *child[1:]]
                    child[:] = [edge[:same], {int(edge[same]): low}, child[2], child[3], [], child[5]]
                at += same
            self._touch(child, size, member)
            node = child
        node[4].append((member, size))

    def _touch(self, node: list, size: int, member: int) -> None:
        node[2], node[3] = min(node[2], size), max(node[3], size)
        if node[5] is None:
            node[5] = member
        elif node[5] >= 0 and self.find(node[5]) != self.find(member):
            node[5] = -1

    def probe(self, grams: np.ndarray, size: int, member: int) -> None:
        """Join the set's component with those of all members that link with it."""
        self.mark[grams] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, shared, depth = stack.pop()
            _, children, short, long_, members, one = node
            if one is not None and one >= 0 and self.find(one) == self.find(member):
                continue
            if 100 * min(size, long_) < self.percent * max(size, short):
                continue
            if len(node[0]):
                shared += int(self.mark[node[0]].sum())
                depth += len(node[0])
                left = len(grams) - int(np.searchsorted(grams, node[0][-1], "right"))
                # a set below here shares at most what is left of the probe, and of itself
                if shared + min(left, long_ - depth) < _needed(size, short, self.percent):
                    continue
            for other, n in members:
                if shared >= _needed(size, n, self.percent) and self.find(other) != self.find(member):
                    self.parent[self.find(other)] = self.find(member)
            stack += [(child, shared, depth) for child in children.values()]
        self.mark[grams] = False


def _link(sets: list[np.ndarray], levels: list[np.ndarray], sizes: list[int], labels: list[int], percent: int) -> dict[int, int]:
    """For each label of one tree: the least label that links of its sets reach there."""
    values, first, inverse = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, np.concatenate(levels)[first]))] = np.arange(len(values))
    ends = np.cumsum([len(x) for x in sets])
    ranked = [np.sort(rank[inverse[e - len(x) : e]]) for e, x in zip(ends, sets, strict=True)]
    heads: dict[int, int] = {}
    parent = [heads.setdefault(label, i) for i, label in enumerate(labels)]
    tree = PrefixTree(percent, parent, len(values))
    for i, grams in enumerate(ranked):
        tree.probe(grams, sizes[i], i)
        tree.add(grams, sizes[i], i)
    least: dict[int, int] = {}
    for i, label in enumerate(labels):
        root = tree.find(i)
        least[root] = min(label, least.get(root, label))
    return {label: least[tree.find(i)] for i, label in enumerate(labels)}


def _link_groups(table: pa.Table, percent: int) -> pa.Table:
    """Links (label, root) found by the trees of all groups in the table."""
    release()
    table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
    trees = table["tree"].to_numpy()
    bound = np.concatenate([[0], np.flatnonzero(trees[1:] != trees[:-1]) + 1, [len(trees)]]).tolist()
    found = set()
    for a, b in zip(bound, bound[1:], strict=False):
        own = table.slice(a, b - a)
        labels = own["label"].to_pylist()
        if len(set(labels)) > 1:
            sets = [np.frombuffer(x, U) for x in own["grams"].to_pylist()]
            levels = [np.frombuffer(x, np.uint8) for x in own["levels"].to_pylist()]
            found.update(x for x in _link(sets, levels, own["size"].to_pylist(), labels, percent).items() if x[0] != x[1])
    return pa.Table.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=LABELS)


def _links(seats: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (u, v) found by trees. seats: (node, label, tree, small); a small tree shares a task's group with others."""
    seats = cut(seats)
    packs = max(1, math.ceil(seats.filter("small").count() / (2 * block)))
    packed = seats.withColumn("pack", F.when(F.col("small"), F.pmod("tree", F.lit(packs))).otherwise(F.col("tree"))).join(sets, "node")

    def link(table):
        return _link_groups(table, percent)

    found = packed.select("pack", "small", "tree", "node", "size", "grams", "levels", "label").groupBy("pack", "small").applyInArrow(link, "label long, root long")
    return found.select(F.col("label").alias("u"), F.col("root").alias("v"))


def _joined_classes(classes: DataFrame, percent: int, block: int, picks: int) -> DataFrame:
    """(node, label): label is the least node that links reach; nodes that link with nothing have no row.

    classes: (node, size, grams, levels, prefix).
    """
    sets = classes.select("node", "size", "grams", "levels")
    held = classes.select("node", F.explode("prefix").alias("gram"))
    sizes = held.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # n-grams with the same classes are one group
    groups = sizes.filter("n > 1").groupBy("n", "lo", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "n")
    held = cut(held.join(groups, "gram"))

    # a few of the largest groups of every class, in blocks
    order = Window.partitionBy("node").orderBy(F.desc("n"), "gram")
    picked = held.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= picks)
    blocks = F.ceil(F.col("n") / block)
    seats = picked.select("node", F.col("node").alias("label"), F.xxhash64("gram", F.pmod(F.xxhash64("node", "gram"), blocks)).alias("tree"), (F.col("n") < block / 8).alias("small"))
    links = cut(_links(seats, sets, percent, block))
    labels = connected(links).withColumnRenamed("component", "label")

    # groups left: more than one label, and not all together in the tree of one group that each of them picked
    first = picked.filter("nth = 1").select("node", F.when(F.col("n") <= block, F.col("gram")).alias("met"))
    held = held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(first, "node")
    left = held.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("met").alias("met"), F.max("met").alias("met_hi"), F.count("met").alias("n_met"))
    left = left.filter("lo <> hi").select("gram", F.col("met").alias("met_lo"), "met_hi", "n_met")
    held = held.join(left, "gram").filter("not (n_met = n and met_lo = met_hi)").select("gram", "n", "node", "label")
    held = cut(held)
    if held.isEmpty():
        return labels
    whole = held.filter(F.col("n") <= block).select("node", "label", F.col("gram").alias("tree"), (F.col("n") < block / 8).alias("small"))
    links = links.unionByName(_links(whole.unionByName(_grid(held.filter(F.col("n") > block), block // 2)), sets, percent, block))
    return connected(links).withColumnRenamed("component", "label")


def _grid(held: DataFrame, half: int) -> DataFrame:
    """Seats of groups larger than a block: every pair of half blocks has a tree, but pairs of the group's main label."""
    counts = held.groupBy("gram", "label").agg(F.count("*").alias("n_label"), F.first("n").alias("n"))
    main = counts.groupBy("gram").agg(F.max_by("label", F.struct("n_label", "label")).alias("main"), F.max("n_label").alias("n_main"))
    seats = held.join(main, "gram").withColumn("minor", F.col("label") != F.col("main"))
    of_main, of_minor = F.ceil(F.col("n_main") / half), F.ceil((F.col("n") - F.col("n_main")) / half)
    seats = seats.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("minor"), of_minor).otherwise(of_main)))
    # a minor half block meets every half block; one of the main label meets the minor ones
    with_minor = seats.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), of_minor - 1)))
    with_main = seats.filter("minor").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), of_main - 1)))
    mixed = F.xxhash64("gram", F.lit("main"), "own", "other")
    among = F.xxhash64("gram", F.lit("minor"), F.least("own", "other"), F.greatest("own", "other"))
    trees = with_minor.withColumn("tree", F.when(F.col("minor"), among).otherwise(mixed)).unionByName(with_main.withColumn("tree", F.xxhash64("gram", F.lit("main"), "other", "own")))
    return trees.select("node", "label", "tree", F.lit(False).alias("small"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bucket_bytes: int = 3 << 20, buckets_per_part: int = 4, block: int = 512, picks: int = 2, tag: str | None = None) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

    A-Z are lower-cased; words are maximal runs without ASCII white space. A text with fewer than
    ``words`` words is one n-gram; a null text or one without words has none and links with nothing.

    Returns one row for each input row: doc_id, n_shingles, component_id (least doc_id reached by
    links, itself included). A row without doc_id carries links like any other but names no component: it has the least
    doc_id that its links reach, null if they reach none. Rows that share a doc_id are judged row by row, each by the links of
    its own text, so they may be in different components. ``tag`` names a long column that is handed through. Other columns
    are not read, whatever their names; an empty table gives an empty result.

    ``bucket_bytes`` and ``block`` bound what one task group holds; ``picks`` is the number of groups that every class
    goes to first.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"))
    rows, n = bucketed(docs, bucket_bytes)
    parts = max(1, math.ceil(n / buckets_per_part))

    def index(key, table):
        x = _Listed(table, words, parts)
        out = [(i, key[0].as_py(), blob(x.entries[x.bound[i] : x.bound[i + 1]])) for i in range(parts) if x.bound[i + 1] > x.bound[i]]
        return pa.Table.from_pylist([dict(zip(SENT.names, r, strict=True)) for r in out], schema=SENT)

    def describe(key, table, back):
        if not len(table):
            return SETS.empty_table()
        x = _Listed(table, words, parts)
        levels = x.levels(back)
        ids, tags, out, at = table["doc_id"].to_pylist(), table["tag"].to_pylist(), [], 0
        for i, grams in enumerate(x.sets):
            size, own = len(grams), levels[at : at + len(grams)]
            at += size
            common = own > 0
            row = {"doc_id": ids[i], "tag": tags[i], "n_shingles": size}
            if size and 100 * int(common.sum()) >= percent * size:
                order = np.lexsort((grams, own))
                prefix = order[: size - -(-percent * size // 100) + 1]
                row["set_key"] = hashlib.blake2b(blob(grams), digest_size=16).digest()
                row["grams"], row["levels"] = blob(grams[common]), blob(own[common])
                row["prefix"] = grams[prefix[common[prefix]]].astype(np.int64)
            out.append(row)
        return pa.Table.from_pylist(out, schema=SETS)

    by_bucket = rows.groupBy("bucket")
    levels = by_bucket.applyInArrow(index, SENT_DDL).groupBy("part").applyInArrow(_add_up, BACK_DDL)
    sets = cut(by_bucket.cogroup(levels.groupBy("bucket")).applyInArrow(describe, SETS_DDL))

    chosen = sets.filter("set_key is not null")
    classes = chosen.groupBy("set_key").agg(F.min("doc_id").alias("name"), *[F.first(c).alias(c) for c in ("n_shingles", "grams", "levels", "prefix")])
    # a node is a class, numbered as it is stored; rows that share a doc_id may give several classes one name
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumnRenamed("n_shingles", "size"))
    labels = _joined_classes(classes, percent, block, picks)

    named = classes.select("node", "set_key", "name").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    least = named.groupBy("component").agg(F.min("name").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    told = ["doc_id", "n_shingles", "component_id", *(["tag"] if tag else [])]
    alone = sets.filter("set_key is null").withColumn("component_id", F.col("doc_id")).select(told)
    # a class's rows are dealt over slots, as its copies may be very many; those without doc_id by the task that made them
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.withColumn("slot", F.pmod(F.when(F.col("doc_id").isNull(), F.spark_partition_id().cast("long")).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int"))
    dealt = dealt.select("doc_id", "tag", "n_shingles", "set_key", "slot")
    named = dealt.select("set_key", "slot").distinct().join(named, "set_key")
    return alone.unionByName(dealt.join(named, ["set_key", "slot"]).select(told))
