"""Filling fixed-capacity containers with items of varying length.

Method: sum-of-squares online packing. A level array holds how many open
containers are filled to each level; an item goes to the level (or to a new
container) after which the sum of the squared counts is smallest, ties to the
fuller container. Items are dealt by hash to shards of bounded size and every
(container kind, shard) is packed on its own, so no group grows with the data;
each shard leaves a few containers partly filled, which is the price of the cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a shard, about; bounds the memory and the time of one task.
SHARD_ITEMS = 20_000
#: Kinds of containers are parameters, not data: more than this is an error.
MOST_KINDS = 100


class SumOfSquares:
    """Open containers of one capacity; ``put`` returns (container, its fill before)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        top = self.capacity - size
        now = self.levels[: top + 1]
        # change of the sum of squares: one container less at h, one more at h + size
        change = 2 * (self.levels[size:] - now) + 2
        change[now == 0] = np.iinfo(np.int64).max
        if now[top]:  # a container that gets full is no longer counted
            change[top] = 1 - 2 * now[top]
        change[0] = 2 * self.levels[size] + 1 if top else 0
        h = top - int(np.argmin(change[::-1]))
        if h:
            container = self.open[h].pop()
            self.levels[h] -= 1
        else:
            container, self.made = self.made, self.made + 1
        if h + size < self.capacity:
            self.open.setdefault(h + size, []).append(container)
            self.levels[h + size] += 1
        return container, h


def pack_sizes_of(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(container, item, piece from 1, start in the item, size) for (item, size)
    pairs in the given order. An item larger than the capacity is cut into full
    containers and a rest; no other item is divided. An item of size 0 takes no
    room and is put into the first container."""
    packer, rows, empty = SumOfSquares(capacity), [], []
    for item, size in items:
        if size == 0:
            empty.append(item)
            continue
        piece, start = 1, 0
        while size - start > 0:
            part = min(capacity, size - start)
            container, _ = packer.put(part)
            rows.append((container, item, piece, start, part))
            piece, start = piece + 1, start + part
    rows += [(0, item, 1, 0, 0) for item in empty]
    return rows


def pack(items: DataFrame, item: str, size: Column, kinds: DataFrame) -> DataFrame:
    """Every item of ``items`` in a container of every kind.

    items: a row for each item, with its id in column ``item``; repeated ids are
        items of their own. size: its length; null counts as 0.
    kinds: ``container_kind``, ``capacity`` (a parameter table of at most
        ``MOST_KINDS`` rows, read by the driver; null or non-positive capacities
        are left out).
    Result: container_kind, container_id, <item>, piece, item_start, item_tokens.
    An empty table gives no rows; extra columns are pruned.
    """
    sizes = [(r[0], int(r[1])) for r in kinds.select("container_kind", "capacity").limit(MOST_KINDS + 1).collect() if r[1] and r[1] > 0]
    if len(sizes) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    kind = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).cast("bigint").alias("c")) for k, c in sizes])
    sized = (
        items.select(F.col(item).cast("bigint").alias("item"), F.coalesce(size, F.lit(0)).alias("size"))
        .withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard")
    )

    def one(part: pd.DataFrame) -> pd.DataFrame:
        capacity, name, shard = int(part["c"].iloc[0]), part["k"].iloc[0], int(part["shard"].iloc[0])
        part = part.sort_values(["mixed", "item", "size"])
        rows = pack_sizes_of(list(zip(part["item"], part["size"])), capacity)
        found = pd.DataFrame(rows, columns=["container", "item", "piece", "item_start", "item_tokens"])
        found["container_kind"] = name
        found["container_id"] = [f"{name}-{shard:05d}-{c:07d}" for c in found["container"]]
        return found[["container_kind", "container_id", "item", "piece", "item_start", "item_tokens"]]

    return (
        sized.select("item", "size", "shard", F.xxhash64("item", F.lit(7)).alias("mixed"), F.explode(kind).alias("kind_"))
        .select("item", "size", "shard", "mixed", "kind_.k", "kind_.c")
        .groupBy("shard", "k")
        .applyInPandas(
            one, "container_kind string, container_id string, item bigint, piece int, item_start bigint, item_tokens bigint"
        )
        .withColumnRenamed("item", item)
    )
