"""Splits that keep related records together.

Method: Borůvka-style contraction. Every component takes its least edge to another
component; the taken edges are added to a persisted spanning forest and the
components they join are contracted by pointer jumping, until no edge leaves a
component. The roots are then stratified by size band and dealt systematically to
the splits. Each round is a handful of aggregates (combined before the shuffle)
and joins; parallel edges are merged after each contraction, so an entity that
holds a third of all edges shrinks in the first round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.sources.tables import checkpointed

#: Rounds after which the contraction must have ended (components at least halve).
MOST_ROUNDS = 64


def _jump(parents: DataFrame) -> DataFrame:
    """Roots of a forest of (node, parent); roots point at themselves."""
    for _ in range(MOST_ROUNDS):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = checkpointed(parents.join(up, "parent").select("node", F.col("above").alias("parent")))
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        if parents.join(above, "parent").where("parent <> top").isEmpty():
            return parents
    raise RuntimeError("pointer jumping did not end")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of an undirected graph given as ``a``, ``b`` strings.

    labels: ``node``, ``root`` for every node that has an edge to another node;
        root is the smallest node of its component.
    forest: the edges (``a``, ``b``, a < b) of a spanning forest.
    Loops, repeated edges and edges with a null end are dropped. An empty graph
    gives empty results.
    """
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    # the order of edges: any total order will do; a hash keeps long chains of
    # consecutive ids from being taken one by one
    edges = checkpointed(
        edges.where("a is not null and b is not null and a <> b").select(lo, hi).distinct()
        .withColumn("w", F.struct(F.xxhash64("a", "b").alias("h"), F.col("a").alias("a"), F.col("b").alias("b")))
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    live = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w")
    taken = None
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            break
        ends = live.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("d"), "w"), F.struct(F.col("y").alias("c"), F.col("x").alias("d"), "w"))).alias("e")).select("e.*")
        least = ends.groupBy("c").agg(F.min(F.struct("w", "d")).alias("m")).select("c", "m.w", "m.d")
        least = checkpointed(least)
        chosen = least.select("w.a", "w.b").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        # two components may choose the same edge: the smaller of them is the root
        back = least.select(F.col("c").alias("d"), F.col("d").alias("of_d"))
        hooked = least.join(back, "d", "left").select(
            F.col("c").alias("node"), F.when((F.col("of_d") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("parent")
        )
        roots = _jump(checkpointed(hooked))
        up = roots.select(F.col("node").alias("root"), F.col("parent").alias("new"))
        labels = checkpointed(labels.join(up, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        to_x = roots.select(F.col("node").alias("x"), F.col("parent").alias("nx"))
        to_y = roots.select(F.col("node").alias("y"), F.col("parent").alias("ny"))
        # every live end has an edge, so it has a root
        live = checkpointed(
            live.join(to_x, "x").join(to_y, "y").where("nx <> ny")
            .groupBy(F.least("nx", "ny").alias("x"), F.greatest("nx", "ny").alias("y")).agg(F.min("w").alias("w"))
        )
    else:
        raise RuntimeError("the contraction did not end")
    smallest = labels.groupBy("root").agg(F.min("node").alias("smallest"))
    labels = labels.join(smallest, "root").select("node", F.col("smallest").alias("root"))
    forest = taken if taken is not None else edges.select("a", "b")
    return checkpointed(labels), checkpointed(forest.distinct())


def deal_groups(sizes: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """A common split for each group: ``group_id``, ``records``, ``split``.

    sizes: ``group_id``, ``records``. The groups of a size band (powers of two) lie end
    to end in the order of their hashes, each as long as its records, and the band is
    divided among the splits in proportion to the records that each still lacks; a group
    goes to the split in which its middle lies. Bands are dealt from the largest groups
    to the smallest, so that each makes up for what the larger ones left uneven: shares
    differ from ``proportions`` by less than the smallest groups, unless single groups
    exceed what their split may hold. Places come from sums per hash bucket, so that no
    band is gathered into one task; the driver holds one row for each band and split.
    """
    total = sum(proportions.values())
    if not proportions or total <= 0 or min(proportions.values()) < 0:
        raise ValueError("proportions must be positive")
    placed = sizes.select("group_id", F.greatest(F.col("records"), F.lit(0)).alias("records"), F.xxhash64("group_id").alias("h"))
    placed = placed.withColumn("band", F.floor(F.log2(F.greatest(F.col("records"), F.lit(1)))).cast("int")).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    # 4096 buckets a band at most: the running sums over them are small
    sums = placed.groupBy("band", "bucket").agg(F.sum("records").alias("n"))
    whole = W.partitionBy("band")
    before = sums.select(
        "band", "bucket", F.sum("n").over(whole).alias("all"),
        F.coalesce(F.sum("n").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = F.sum("records").over(W.partitionBy("band", "bucket").orderBy("h", "group_id").rowsBetween(W.unboundedPreceding, 0))
    middle = (F.col("before") + inside - F.col("records") / 2) / F.greatest(F.col("all"), F.lit(1))
    at = checkpointed(placed.join(before, ["band", "bucket"]).select("group_id", "records", "band", middle.alias("middle")))
    bands = [(r.band, r.n) for r in at.groupBy("band").agg(F.sum("records").alias("n")).orderBy(F.desc("band")).collect()]  # at most 64 rows
    every = sum(n for _, n in bands)
    lacking = {name: share / total * every for name, share in proportions.items()}
    split = F.lit(max(proportions, key=proportions.get))
    for band, n in bands:
        order = sorted((x for x in lacking if lacking[x] > 0), key=lambda x: -lacking[x]) or [max(proportions, key=proportions.get)]
        open_, edge, chosen = sum(max(lacking[x], 0.0) for x in order) or 1.0, 0.0, None
        for name in order[:-1]:
            edge += max(lacking[name], 0.0) / open_
            inside = F.col("middle") < edge
            chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
        chosen = F.lit(order[-1]) if chosen is None else chosen.otherwise(order[-1])
        for r in at.where(F.col("band") == band).groupBy(chosen.alias("s")).agg(F.sum("records").alias("n")).collect():
            lacking[r.s] -= r.n
        split = F.when(F.col("band") == band, chosen).otherwise(split)
    return at.select("group_id", "records", split.alias("split"))
