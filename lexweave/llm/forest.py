"""Connected components by union-find forests that are built locally and merged level by level.

Each partition turns its edges into a forest (every node points at the smallest node of its local tree), so a level's
output has at most as many rows as its partitions have distinct nodes. The forests are repartitioned onto fewer
partitions and merged again. A partition never gets more than ``limit`` rows: while a level would need more than one
partition of that size, rounds of star contraction (every node's neighbours are re-hung on the smallest one) shrink the
depth of the forests in the JVM, and the loop ends once no edge changes. No edge is ever brought to the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, partitions_for

LIMIT = 1_000_000  # rows of one partition in a merge


def _local_forest(batches):
    parent: dict[str, str] = {}

    def find(x):
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while (p := parent[x]) != root:
            parent[x] = root
            x = p
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
    child, root = [], []
    for x in parent:
        if (r := find(x)) != x:
            child.append(x)
            root.append(r)
        if len(child) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(child, pa.string()), pa.array(root, pa.string())], ["a", "b"])
            child, root = [], []
    yield pa.RecordBatch.from_arrays([pa.array(child, pa.string()), pa.array(root, pa.string())], ["a", "b"])


def _forest(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_local_forest, "a string, b string")


def _star_round(edges: DataFrame) -> DataFrame:
    """Large star, then small star; both keep the components and bring every node nearer to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written out: against an aggregate, the join of a hub's edges with its least neighbour couldn't be split
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = down.join(least, "a")
    return (
        hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def components(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """edges(a, b) of strings -> (node, root): root is the smallest node of node's component.

    Nodes without an edge don't appear; self-loops and repeated edges are allowed; null ends are dropped. An empty
    table gives an empty one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")
    )
    at = materialize(_forest(edges), "forest")
    n = at.count()
    level = partitions_for(n, max(1, limit // 4))
    while n > limit and level > 1:  # levels of merging: each onto a quarter of the partitions, by the tree's root
        level = max(1, level // 4)
        per = partitions_for(n, limit)
        at = materialize(_forest(at.repartition(max(level, per), "b")), "forest")
        smaller = at.count()
        if level <= per or smaller > 0.9 * n:
            n = smaller
            break
        n = smaller
    if n > limit:  # star contraction until nothing changes
        state = None
        while True:  # every round but the last hangs some node lower, so there is a last one
            at = materialize(_star_round(at), "star")
            now = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
            if state == tuple(now):
                break
            state = tuple(now)
        return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
            at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        )
    at = materialize(_forest(at.coalesce(1)), "forest")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
