"""Connected components of very large sparse graphs by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a long, b long); a component is named after its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the chains by one jump, and replaces the edges
    by those between the roots. Rounds grow with the logarithm of the longest path. Each is checkpointed, so a lost
    executor repeats one round. NULL ends and loops are ignored; an empty graph gives an empty result.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = cut_lineage(edges)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("low")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("low")))
        hooked = both.groupBy("node").agg(F.min("low").alias("low")).select("node", F.least("node", "low").alias("parent"))
        upper = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = cut_lineage(hooked.join(upper, "parent").select("node", F.col("grand").alias("parent")))
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        edges = cut_lineage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("parent").alias("component"))
    for step in steps[1:]:
        upper = step.select(F.col("node").alias("component"), "parent")
        found = found.join(upper, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return found


def joined_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, component``: the classes of two ways of linking the same rows, taken together.

    Both sides have these columns. Rows are in one class if links of either kind lead from one to the other.
    """
    own = [F.xxhash64(F.lit(side), F.col(f"__{side}")) for side in ("left", "right")]
    rows = left.select("doc_id", "k1", "k2", F.col("component").alias("__left")).distinct()
    rows = rows.join(right.select("k1", "k2", F.col("component").alias("__right")).distinct().hint("merge"), ["k1", "k2"])
    rows = cut_lineage(rows.select("doc_id", "k1", "k2", own[0].alias("a"), own[1].alias("b")))
    found = components(rows.select("a", "b")).withColumnRenamed("node", "a")
    return rows.join(found.hint("merge"), "a").select("doc_id", "k1", "k2", "component")
