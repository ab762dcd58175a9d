"""Items that appear together, and how much more often than chance.

Method: heavy-light decomposition. An item is heavy when it fills more than
1/HEAVY of all basket places, so there are at most HEAVY heavy items in each
field. Heavy pairs are counted by popcounts of a dense bit matrix (items x
baskets of a batch), pairs of light items in hash tables, mixed pairs by probing
each basket's heavy items with its light list. Each task adds its counts up before
the shuffle. Items in fewer baskets than the least support cannot take part in
any reported pair and are dropped first, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.sources.tables import checkpointed

#: At most this many heavy items in each field.
HEAVY = 512
#: Items of one block of a large basket; larger baskets are counted block by block.
BLOCK = 1_024
#: Counted pairs a task holds before it hands them on.
HELD = 2_000_000


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of items of the same basket; baskets lie end to end."""
    basket = np.repeat(np.arange(len(sizes)), sizes)
    left, right = [], []
    for d in range(1, int(sizes.max(initial=0))):
        i = np.flatnonzero(basket[:-d] == basket[d:])
        left.append(i)
        right.append(i + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _across(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the i-th runs of two lists of runs, given the runs' sizes."""
    each = np.repeat(b, a)
    left = np.repeat(np.arange(int(a.sum())), each)
    start = np.repeat(np.repeat(np.cumsum(b) - b, a), each)
    inner = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    return left, start + inner


class _Counts:
    """Counts of id pairs (a < b), added up in the task."""

    def __init__(self):
        self.parts: list[pd.DataFrame] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(a):
            both = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": 1 if n is None else n})
            self.parts.append(both.groupby(["a", "b"], sort=False, as_index=False)["n"].sum())
            self.size += len(self.parts[-1])

    def take(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        both = pd.concat(self.parts, ignore_index=True).groupby(["a", "b"], sort=False, as_index=False)["n"].sum()
        self.parts, self.size = [], 0
        return both


def _runs(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in column), np.int64, len(column))
    return sizes, (np.concatenate(column.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64))


def _count_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _Counts()
    for part in parts:
        whole = part[part["same"]]
        if len(whole):
            sizes, light = _runs(whole["light"])
            i, j = _within(sizes)
            counts.add(light[i], light[j])
        crossed = part[~part["same"]]
        if len(crossed):
            sizes, light = _runs(crossed["light"])
            others, other = _runs(crossed["other"])
            i, j = _across(sizes, others)
            counts.add(light[i], other[j])
        headed = part[part["first"]]
        if len(headed):
            sizes, heavy = _runs(headed["heavy"])
            ids, code = np.unique(heavy, return_inverse=True)
            if len(ids):
                bits = np.zeros((len(ids), -(-len(headed) // 64) * 64), bool)
                bits[code, np.repeat(np.arange(len(headed)), sizes)] = True
                words = np.packbits(bits, axis=1).view(np.uint64)
                for k in range(len(ids) - 1):
                    n = np.bitwise_count(words[k] & words[k + 1 :]).sum(axis=1, dtype=np.int64)
                    some = np.flatnonzero(n)
                    counts.add(np.full(len(some), ids[k]), ids[k + 1 :][some], n[some])
        if len(part):
            probed = part[part["same"]]
            sizes, light = _runs(probed["light"])
            heavies, heavy = _runs(probed["heavy"])
            i, j = _across(sizes, heavies)
            counts.add(light[i], heavy[j])
        if counts.size > HELD:
            yield counts.take()
    rest = counts.take()
    if rest is not None:
        yield rest


def pair_counts(baskets: DataFrame, group: str, basket: str, item: str, least: int = 3) -> DataFrame:
    """Pairs of items that share at least ``least`` baskets.

    baskets: ``group``, ``basket``, ``item`` rows; repeated rows count once, rows
        with a null in any of the three are left out, extra columns are pruned.
    Result: group, item_lo, item_hi (by code points), joint, n_lo, n_hi,
        n_baskets (non-empty baskets of the group) and lift = joint * n_baskets /
        (n_lo * n_hi). An empty table gives no rows.
    """
    # written once: every branch below reads it again
    rows = checkpointed(
        baskets.select(F.col(group).alias("g"), F.col(basket).cast("string").alias("k"), F.col(item).alias("item"))
        .where("g is not null and k is not null and item is not null")
        .distinct()
    )
    items = rows.groupBy("g", "item").agg(F.count("*").alias("n"))
    per_group = (
        rows.groupBy("g", "k").agg(F.count("*").alias("places")).groupBy("g").agg(F.count("*").alias("n_baskets"), F.sum("places").alias("places"))
    )
    items = checkpointed(
        items.where(F.col("n") >= least)
        .join(F.broadcast(per_group), "g")  # a row for each field, which are named in the code
        # numbers of rows, kept by the write: no two items share one
        .select("g", "item", "n", F.monotonically_increasing_id().alias("id"), (F.col("n") * HEAVY > F.col("places")).alias("is_heavy"))
    )
    known = F.broadcast(items.where("is_heavy").select("g", "item", "id", F.lit(True).alias("hot")))  # at most HEAVY a field
    light_rows = rows.join(known, ["g", "item"], "left")
    light_items = items.where(~F.col("is_heavy")).select("g", "item", F.col("id").alias("light_id"))
    marked = (
        light_rows.where(F.col("hot").isNull()).join(light_items, ["g", "item"]).select("g", "k", F.col("light_id").alias("id"), F.lit(False).alias("hot"))
        .unionByName(light_rows.where("hot").select("g", "k", "id", "hot"))
    )
    # a basket's light items lie in blocks, so that no task holds more than BLOCK of one basket
    blocks = F.when(F.col("hot"), 0).otherwise(F.pmod("id", F.greatest(F.lit(1), F.ceil(F.col("lights") / BLOCK))).cast("int"))
    sizes = marked.groupBy("g", "k").agg(F.sum((~F.col("hot")).cast("int")).alias("lights"), F.count("*").alias("all"))
    placed = marked.join(sizes.where("all > 1"), ["g", "k"]).withColumn("block", blocks)
    grouped = placed.groupBy("g", "k", "block").agg(
        F.array_sort(F.collect_list(F.when(~F.col("hot"), F.col("id")))).alias("light"),
        F.array_sort(F.collect_list(F.when(F.col("hot"), F.col("id")))).alias("heavy"),
        F.max("lights").alias("lights"),
    )
    small = grouped.where(F.col("lights") <= BLOCK).select(
        "light", "heavy", F.array().cast("array<bigint>").alias("other"), F.lit(True).alias("same"), F.lit(True).alias("first")
    )
    large = grouped.where(F.col("lights") > BLOCK)
    # every pair of blocks of a basket is a row with a key of its own, so that a huge
    # basket's pairs are spread over the tasks; a block may be missing
    last = (F.ceil(F.col("lights") / BLOCK) - 1).cast("int")
    a = large.select("g", "k", F.col("block").alias("i"), F.explode(F.sequence("block", last)).alias("j"), "light")
    b = large.select("g", "k", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("light").alias("other"))
    heads = large.where("block = 0").select("g", "k", F.col("heavy").alias("top"))
    wide = (
        a.join(b, ["g", "k", "i", "j"])
        .select("g", "k", "light", "other", (F.col("i") == F.col("j")).alias("same"), ((F.col("i") == 0) & (F.col("j") == 0)).alias("first"))
        .join(heads, ["g", "k"], "left")  # a basket without heavy items may lack block 0
        .select("light", F.coalesce("top", F.array().cast("array<bigint>")).alias("heavy"), "other", "same", "first")
    )
    counted = small.unionByName(wide).mapInPandas(_count_blocks, "a bigint, b bigint, n bigint")
    joint = counted.groupBy("a", "b").agg(F.sum("n").alias("joint")).where(F.col("joint") >= least)
    names = items.select("g", "item", "n", "id")
    lo = names.select(F.col("id").alias("a"), F.col("g"), F.col("item").alias("x"), F.col("n").alias("nx"))
    hi = names.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n").alias("ny"))
    ordered = F.col("x") < F.col("y")
    return (
        joint.join(lo, "a").join(hi, "b").join(F.broadcast(per_group), "g")
        .select(
            F.col("g").alias(group),
            F.least("x", "y").alias("item_lo"),
            F.greatest("x", "y").alias("item_hi"),
            "joint",
            F.when(ordered, F.col("nx")).otherwise(F.col("ny")).alias("n_lo"),
            F.when(ordered, F.col("ny")).otherwise(F.col("nx")).alias("n_hi"),
            "n_baskets",
        )
        .withColumn("lift", F.col("joint") * F.col("n_baskets") / (F.col("n_lo").cast("double") * F.col("n_hi")))
    )


def above_chance(times: float = 3.0) -> Column:
    """joint * N >= times * n_lo * n_hi, in whole numbers where ``times`` is one."""
    return F.col("joint") * F.col("n_baskets") >= F.lit(int(times) if times == int(times) else times) * F.col("n_lo") * F.col("n_hi")
