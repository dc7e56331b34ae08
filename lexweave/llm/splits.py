"""Problem 3: train, validation and test splits that keep related records together.

Records that share an owner or a document, directly or through other records, form one group (components of the graph
of owner and document keys). Groups are then taken largest first, each into the split furthest below its target.

The greedy choice depends only on the groups' sizes, so the driver runs it on the histogram of sizes. With N records
there are at most sqrt(2N) distinct sizes, which bounds what is collected. Groups of equal size are told apart by their
rank, which is counted in a range-partitioned order: no partition ever holds a whole size class.

Cases: a record with a null or empty owner belongs to its document's group, one without either is a group of its own;
repeated ids count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.keys import name_key, reject_missing
from lexweave.llm.forest import components
from lexweave.session import materialize

TARGETS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def link_nodes(df: DataFrame, owner: str, document: str, *keep: str) -> DataFrame:
    """Each row's nodes: a is 'a:' + owner key, d is 'd:' + document key, null where there is none."""
    key = lambda c, p: F.when(name_key(F.col(c)) != "", F.concat(F.lit(p), name_key(F.col(c))))
    return df.select(*keep, key(owner, "a:").alias("a"), key(document, "d:").alias("d"))


def owner_components(df: DataFrame, owner: str, document: str, **options) -> DataFrame:
    """(node, root) over owner and document nodes."""
    edges = link_nodes(df, owner, document).where("a is not null and d is not null").distinct()
    return components(edges.select("a", F.col("d").alias("b")), **options)


def greedy(sizes: list[tuple[int, int]], targets: dict[str, float] = TARGETS) -> dict[int, list[tuple[str, int]]]:
    """sizes: (size, number of groups). For each size, how many of its groups each split gets, in a fixed order.

    Groups are taken one by one, largest size first, into the split with the largest shortfall (ties: the order of
    targets). A class of many equal groups is dealt in bulk while the outcome is the same as one by one.
    """
    total = sum(s * n for s, n in sizes)
    short = {k: share * total for k, share in targets.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(sizes, reverse=True):
        got = dict.fromkeys(targets, 0)
        while n:
            order = sorted(targets, key=lambda k: -short[k])
            lead = order[0]
            gap = short[lead] - (short[order[1]] if len(order) > 1 else -math.inf)
            take = min(n, max(1, math.floor(gap / size))) if math.isfinite(gap) else n
            if gap < size and n > 4 * len(targets):  # level: whole rounds give every split the same number
                close = [k for k in targets if short[lead] - short[k] < size]
                rest = max((short[k] for k in targets if k not in close), default=-math.inf)
                rounds = n // len(close)
                if math.isfinite(rest):
                    rounds = min(rounds, int((min(short[k] for k in close) - rest) // size))
                if rounds > 1:
                    for k in close:
                        got[k] += rounds - 1
                        short[k] -= (rounds - 1) * size
                    n -= (rounds - 1) * len(close)
                    continue
            got[lead] += take
            short[lead] -= take * size
            n -= take
        out[size] = [(k, c) for k, c in got.items() if c]
    return out


def assign(df: DataFrame, id_col: str, owner: str, document: str, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """(id, group_id, split): one row for each distinct id."""
    reject_missing(df, id_col, owner, document)
    spark = df.sparkSession
    nodes = link_nodes(df.select(F.col(id_col).cast("string").alias("_id"), F.col(owner), F.col(document)), owner, document, "_id")
    rows = nodes.where("_id is not null").select(F.col("_id").alias("id"), "a", "d")
    rows = rows.groupBy("id").agg(F.min("a").alias("a"), F.min("d").alias("d"))
    roots = owner_components(df, owner, document, **options)
    node = F.coalesce("a", "d", F.concat(F.lit("r:"), "id"))
    counted = rows.select("id", node.alias("node"))
    per_node = counted.groupBy("node").agg(F.count("*").alias("n"))
    grouped = materialize(
        per_node.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("group_id")), "groups"
    )
    sized = grouped.groupBy("group_id").agg(F.sum("n").alias("size"))
    ranked = materialize(
        sized.repartitionByRange(F.col("size").desc(), F.col("group_id"))
        .sortWithinPartitions(F.col("size").desc(), "group_id")
        .select("group_id", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")),
        "ranked",
    )
    shares = ranked.groupBy("size", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = [(r[0], r[1]) for r in shares.groupBy("size").agg(F.sum("n")).collect()]  # at most sqrt(2N) rows
    ranges = []
    for size, parts in greedy(histogram, targets).items():
        lo = 0
        for split, n in parts:
            ranges.append((int(size), lo, lo + n, split))
            lo += n
    cuts = spark.createDataFrame(ranges, "size bigint, lo bigint, hi bigint, split string")
    numbered = ranked.join(shares.select("size", "part", "first", "before"), ["size", "part"]).select(
        "group_id", "size", (F.col("before") + F.col("row") - F.col("first")).alias("rank")
    )
    placed = numbered.join(cuts, "size").where("rank >= lo and rank < hi").select("group_id", "split")
    return counted.join(grouped.select("node", "group_id"), "node").join(placed, "group_id").select("id", "group_id", "split")


def related_pairs(df: DataFrame, owner: str, document: str, **options) -> DataFrame:
    """(owner_a, owner_b), smaller first: owners that must share a split because a chain of documents connects them.

    The result itself lists pairs, as its definition asks; the pairing runs within components of owners only.
    """
    roots = owner_components(df, owner, document, **options).where("node like 'a:%'")
    x = roots.select(F.expr("substr(node, 3)").alias("owner_a"), "root")
    y = roots.select(F.expr("substr(node, 3)").alias("owner_b"), "root")
    return x.join(y, "root").where("owner_a < owner_b").select("owner_a", "owner_b")
