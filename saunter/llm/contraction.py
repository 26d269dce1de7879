"""Sums over all subtrees of a forest by parallel tree contraction: rake, compress, re-expand.

A round rakes every leaf into its parent and splices nodes with one child out of their chains:
such a node's child goes up to the node's parent and carries what the node had gathered. Which
nodes of a chain go is told by depths alone: in round r those whose depth has bit r (modulo the
number of bits) while the parent's depth has not, so no two neighbours go at once and a chain of
any length is halved each round. When nothing is left, spliced nodes come back in reverse order:
such a node's sum is its child's and what it had gathered itself.

Rounds grow with the logarithm of the depth and with the nesting of branches, not with the
size. Each is an aggregation by parent (partial sums: a parent with a third of all nodes is a
row a task) and two joins on node numbers, which are unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import Scratch


def subtree_sums(tree: DataFrame, sums: list[str], stage: Scratch) -> DataFrame:
    """(v, sums...): for each node the sums over its subtree, itself included.

    ``tree``: staged rows (v, parent, depth, parent_depth, n_children, sums...) of longs. Roots have a null parent; depths
    grow along each way down; ``n_children`` counts the rows whose parent a node is. An empty tree gives no rows.
    """
    edge = [f"edge_{s}" for s in sums]
    live = tree.select("v", "parent", "depth", "parent_depth", F.col("n_children").alias("k"), *sums, *(F.lit(0).cast("long").alias(e) for e in edge))
    bits = max(1, int(tree.agg(F.max("depth")).first()[0] or 0).bit_length())
    done, spliced, r = [], [], 0
    while not live.isEmpty():
        bit = 1 << (r % bits)
        leaves, inner = live.where("k = 0"), live.where("k > 0")
        raked = live.where("parent is not null").groupBy(F.col("parent").alias("v")).agg(
            F.count_if(F.col("k") > 0).alias("k"), F.min(F.when(F.col("k") > 0, F.col("v"))).alias("child"),
            *(F.coalesce(F.sum(F.when(F.col("k") == 0, F.col(s) + F.col(e))), F.lit(0)).alias(f"raked_{s}") for s, e in zip(sums, edge)))
        now = inner.drop("k").join(raked, "v").withColumns({s: F.col(s) + F.col(f"raked_{s}") for s in sums}).drop(*(f"raked_{s}" for s in sums))
        goes = F.expr(f"k = 1 and parent is not null and depth & {bit} <> 0 and parent_depth & {bit} = 0")
        now = stage(now.withColumn("goes", goes))
        gone = now.where("goes").select(F.col("child").alias("v"), F.col("parent").alias("to"), F.col("parent_depth").alias("to_depth"), *(F.col(s) + F.col(e) for s, e in zip(sums, edge)))
        gone = gone.toDF("v", "to", "to_depth", *(f"add_{s}" for s in sums))
        left = now.where("not goes").drop("child", "goes").join(gone, "v", "left")
        moved = F.col("to").isNotNull()
        new = left.withColumns({"parent": F.coalesce("to", "parent"), "parent_depth": F.when(moved, F.col("to_depth")).otherwise(F.col("parent_depth"))}
                               | {e: F.col(e) + F.coalesce(f"add_{s}", F.lit(0)) for s, e in zip(sums, edge)}).drop("to", "to_depth", *(f"add_{s}" for s in sums))
        # What a spliced node lacks is its child's sum, and what the child's edge carried before it moved.
        held = now.where("not goes").select(F.col("v").alias("child"), *(F.col(e).alias(f"below_{s}") for s, e in zip(sums, edge)))
        record = now.where("goes").join(held, "child").select("v", "child", *((F.col(s) + F.col(f"below_{s}")).alias(s) for s in sums))
        done.append((leaves.select("v", *sums), r))
        spliced.append(record)
        live, r = stage(new.select(*live.columns)), r + 1
    found = [d for d, _ in done]
    for r in range(len(spliced) - 1, -1, -1):
        if spliced[r].isEmpty():
            continue
        known = reduce(DataFrame.union, found[r + 1 :]).toDF("child", *(f"of_{s}" for s in sums))
        back = spliced[r].join(known, "child").select("v", *((F.col(s) + F.col(f"of_{s}")).alias(s) for s in sums))
        found[r] = found[r].union(stage(back))
    return reduce(DataFrame.union, found) if found else tree.select("v", *sums)
