"""Sharding by best-fit-decreasing bin packing: indivisible groups, largest first, enter the tightest bin that holds them.

Rows with equal texts are one group and share a shard.  The packing itself is sequential, so it must see a bounded number
of items: a group above 1/`fine` of a shard is an item of its own (there are fewer than shards * fine of them); all
lighter groups are hashed into `bundles` items.  Only these items reach the packer; rows find their shard through two
lookups of that bounded size.  A group larger than a shard gets one for itself and the rest is packed evenly into the others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import materialise, small, spread_sums

HEADER = 16


class Treap:
    """Balanced search tree of (remaining capacity, bin): insert, and take the smallest entry not below a bound."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.state = 1

    def _priority(self) -> int:
        self.state = self.state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self.state >> 20

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Entries below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = Treap._split(node[3], key)
            return node, right
        left, node[2] = Treap._split(node[2], key)
        return left, node

    @staticmethod
    def _merge(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = Treap._merge(a[3], b)
            return a
        b[2] = Treap._merge(a, b[2])
        return b

    def add(self, key: tuple) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._priority(), None, None]), right)

    def take_at_least(self, key: tuple) -> tuple | None:
        """Remove and return the smallest entry >= key."""
        left, right = self._split(self.root, key)
        if right is None:
            self.root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]

    def take_largest(self) -> tuple | None:
        node, parent = self.root, None
        if node is None:
            return None
        while node[3] is not None:
            node, parent = node[3], node
        if parent is None:
            self.root = node[2]
        else:
            parent[3] = node[2]
        return node[0]


def best_fit_decreasing(items: list[tuple[str, int]], capacity: int, bins: int | None = None) -> dict[str, int]:
    """Bin of each (name, size).  Largest first (ties by name) into the fullest bin that still holds it.

    Without `bins` a new bin opens when none fits; an item above `capacity` fills a bin of its own.  With `bins`, all of
    them are open from the start, and an item that fits nowhere enters the emptiest bin."""
    tree, placed, opened = Treap(), {}, 0
    if bins is not None:
        for b in range(bins):
            tree.add((capacity, b))
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        found = tree.take_at_least((size, -1))
        if found is None and bins is not None:
            found = tree.take_largest()
        if found is None:
            found, opened = (max(capacity, size), opened), opened + 1
        placed[name] = found[1]
        tree.add((found[0] - size, found[1]))
    return placed


def pack_evenly(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Best fit decreasing into a fixed number of shards of one capacity; items above it take whole shards first."""
    left, alone = sorted(items, key=lambda x: (-x[1], x[0])), []
    total = sum(s for _, s in left)
    while left and len(alone) < shards - 1 and left[0][1] > math.ceil(total / (shards - len(alone))):
        alone.append(left.pop(0))
        total -= alone[-1][1]
    bins = shards - len(alone)
    placed = best_fit_decreasing(left, math.ceil(total / bins), bins) if left else {}
    return {n: b + len(alone) for n, b in placed.items()} | {n: i for i, (n, _) in enumerate(alone)}


def shard(docs: DataFrame, shards: int = 40, fine: int = 64, bundles: int = 8192) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as the empty text (size 16, crc 0) and shares its group.  Repeated rows are rows of their own.
    Slots number a shard's rows from 0 in hash order of (doc_id, crc); an empty table gives an empty result."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = materialise(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + HEADER).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    ))
    groups = materialise(slim.groupBy("digest").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    light = max(1, total // (shards * fine))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("string")
    heavy = F.col("bytes") > light
    items = groups.groupBy(F.when(heavy, F.hex("digest")).otherwise(bundle).alias("item")).agg(F.sum("bytes").alias("bytes"))
    placed = pack_evenly([(r.item, r.bytes) for r in items.toLocalIterator()], shards)  # at most shards * fine + bundles
    table = spark.createDataFrame(list(placed.items()), "item string, shard int")
    alone = table.where(F.length("item") == 32).select(F.unhex("item").alias("digest"), F.col("shard").alias("own"))
    rows = slim.withColumn("item", bundle).join(F.broadcast(alone), "digest", "left")
    rows = rows.join(F.broadcast(table.where(F.length("item") < 32)), "item", "left")
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("own", "shard").alias("shard"), F.lit(1).cast("long").alias("one"))
    stats = small(materialise(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))))
    done = spread_sums(rows, "shard", "one", ["doc_id", "text_crc32"], stats, "slot")
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
