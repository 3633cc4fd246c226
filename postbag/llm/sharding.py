"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that no shard boundary divides. Groups
enter, largest first, the bin with the tightest room that still holds them, found in
a balanced tree. Sizes are whole numbers and groups of one size are interchangeable, and after
one of them the bin that took it is still the tightest while it holds the next; so whole runs of equal
sizes enter at once, and the driver sees a row a distinct size, not a row a group. Which groups of a
size are in which run is a rank made in parallel. A search finds the least capacity that keeps all in the given number of shards."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep
from .ranks import hash_bucket, running_base


class RoomTree:
    """Balanced search tree (a treap) of (room, bin) pairs; finds the least room that is enough."""

    def __init__(self, seed: int = 0):
        self._rng, self._root = random.Random(seed), None

    def _split(self, node, key):
        """Subtrees of the pairs before ``key`` and from it on."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._join(a[2], b)
            return a
        b[1] = self._join(a, b[1])
        return b

    def add(self, room: int, which: int) -> None:
        left, right = self._split(self._root, (room, which))
        self._root = self._join(self._join(left, [(room, which), None, None, self._rng.random()]), right)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room for ``need``."""
        left, right = self._split(self._root, (need, -1))
        if right is None:
            self._root = left
            return None
        node = right
        while node[1] is not None:
            node = node[1]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self._root = self._join(left, rest)
        return node[0]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, count, bin) in order for ``runs`` of (size, count), sizes descending: each unit in the tightest bin that holds
    it, else in a new one. A unit over the capacity gets a bin of its own. None if more than ``most`` bins would open."""
    tree, out, opened = RoomTree(), [], 0
    for size, count in runs:
        while count:
            if (found := tree.take(size)) is None:
                if opened == most:
                    return None
                found = (max(size, capacity), opened)
                opened += 1
            n = min(count, found[0] // size)
            out.append((size, n, found[1]))
            tree.add(found[0] - n * size, found[1])
            count -= n
    return out


def balance(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing into at most ``shards`` bins with nearly the least capacity: growing steps from the
    lower bound up to one that does, and a bisection of the last step, down to a 100,000th."""
    if not runs:
        return []
    total = sum(s * n for s, n in runs)
    low = max(runs[0][0], -(-total // shards))
    best, step = best_fit_decreasing(runs, low, shards), max(1, low // 100_000)
    if best is not None:
        return best
    high = low + step
    while (best := best_fit_decreasing(runs, high, shards)) is None:
        low, step = high, 2 * step
        high = low + step
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        if (found := best_fit_decreasing(runs, middle, shards)) is None:
            low = middle
        else:
            best, high = found, middle
    return best


def plan(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """``balance``, but units over what a shard should hold stay alone, and the rest is packed
    over the other shards with their own mean, so that no oversized unit leaves those uneven."""
    total, left, k, alone = sum(s * n for s, n in runs), [list(r) for r in runs], shards, []
    while left and k > 1 and left[0][0] * k >= total:
        alone.append((left[0][0], 1, len(alone)))
        total, k = total - left[0][0], k - 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    return alone + [(s, n, b + len(alone)) for s, n, b in balance([tuple(r) for r in left], k)]


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``doc_id, text``.

    Size is the UTF-8 bytes of the text (null: none) plus ``overhead``. The law is
    ``bytes``: shard sizes are as near to equal as indivisible groups of equal
    texts (nulls are one group) allow; a group of more than a shard's share has
    a shard to itself. slot counts from 0 without gaps in each shard; grown_shard
    is null under this law. The crc of a null text is that of no bytes, 0.
    Repeated rows are rows of their own, in one shard. An empty table gives no
    rows; with few groups some shards stay empty. Other columns are not read."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = keep(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("").cast("binary")).otherwise(F.unhex(F.md5(text.cast("binary")))).alias("_key"),
        ),
        "sized",
    )
    groups = keep(seen.groupBy("_key").agg(F.count("*").alias("rows"), F.sum("size").alias("total")), "groups")
    runs = [(r["total"], r["n"]) for r in groups.groupBy("total").agg(F.count("*").alias("n")).orderBy(F.desc("total")).collect()]  # a row a distinct size
    of_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, n, shard in plan(runs, shards):
        own = of_size.setdefault(size, [])
        first = own[-1][1] if own else 0
        own.append((first, first + n, shard))
    table = spark.createDataFrame([(size, own) for size, own in of_size.items()], "_size long, _runs array<struct<a:long,b:long,shard:int>>")
    ranked = running_base(groups, ["total"], hash_bucket(["_key"], sum(n for _, n in runs)), ["_key"], F.lit(1), "_rank")
    # a size has at most a run a shard; of many sizes the table is joined, not broadcast
    sized = F.broadcast(table) if len(of_size) <= 50_000 else table
    at = F.element_at(F.filter("_runs", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"])), 1)
    found = ranked.join(sized, F.col("total") == F.col("_size")).select("_key", "rows", at["shard"].alias("shard"))
    # groups of at least a thousandth of all rows are broadcast (there are a thousand at most), so no key of the join is hot
    rows = seen.count()
    found = keep(found, "group-shards")
    discard(spark, groups)
    least = max(2, rows // 1000)
    hot = found.filter(F.col("rows") >= least).select(F.col("_key").alias("_h"), F.col("shard").alias("_hs"))
    wide = seen.join(F.broadcast(hot), F.col("_key") == F.col("_h"), "left")
    key = F.when(F.col("_h").isNull(), F.col("_key")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0")))  # eight bytes meet no digest
    placed = wide.withColumn("_k", key).join(found.filter(F.col("rows") < least).select(F.col("_key").alias("_k"), "shard"), "_k", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.coalesce("_hs", "shard").alias("shard"))
    ranked = running_base(placed, ["shard"], hash_bucket(["doc_id"], rows // shards), ["doc_id", "text_crc32"], F.lit(1), "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
