"""Clusters of the link graph: findings and decisions that links connect, and whether their outcomes agree.

Connected components by contraction. In each round every node looks at its neighbours and follows
the smallest; the pointers are shortened by doubling until they end in a root; edges are carried over to the
roots, and those inside one root vanish. What is left is a smaller graph of the same components. A chain shrinks
to half or less in a round, so rounds grow with the logarithm of the longest chain. Each round stores its pointers
and its edges in the shared folder, so no plan grows and a lost executor costs a re-read. At the end the pointers
of all rounds are put one behind the other, smallest table first. Shuffle files go when their step is stored.

A node with a third of all edges costs no more than others: smallest neighbours are partial minima, and in the joins
that carry edges over it is the side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclink.sources.scratch import cut_lineage

MAX_ROUNDS = 200


def _stored(df: DataFrame) -> DataFrame:
    return cut_lineage(df, keep_shuffles=False)


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: the end of the way from each node to its smallest neighbour, to that one's, and so on."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    up = _stored(up)
    for _ in range(MAX_ROUNDS):
        next_up = up.select(F.col("node").alias("of"), F.col("root").alias("top"))
        jumped = _stored(up.join(next_up, F.col("root") == F.col("of")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        up = jumped.select("node", "root")
        if not _any(jumped.where("moved")):
            return up
    raise RuntimeError("pointers did not end")


def components(edges: DataFrame) -> DataFrame:
    """node, root for edges (a, b) of nodes of one ordered type; root is the smallest node that can be reached. Loops
    and repeated edges do no harm, edges with a null end are left out. Nodes without edges do not appear."""
    named = edges.where("a IS NOT NULL AND b IS NOT NULL")
    alone = named.where("a = b").select("a").distinct()
    live = _stored(named.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while _any(live):
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError("the graph did not shrink to its components")
        up = _roots(live)
        steps.append(up)
        ends = [up.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root")) for x in "ab"]
        moved = live.join(ends[0], F.col("a") == F.col("a_node")).join(ends[1], F.col("b") == F.col("b_node"))
        moved = moved.where("a_root != b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        live = _stored(moved.distinct())
    if not steps:
        return alone.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("of"), F.col("root").alias("top"))
        found = steps.pop().join(later, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = alone.join(found, alone["a"] == found["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return found.unionByName(alone)


def link_clusters(edges: DataFrame, left: str = "finding_id", right: str = "decision_id") -> DataFrame:
    """The edges with the cluster each is in, stored: cluster_id is the smallest left id of the cluster.

    Nodes are left ids only: a right one ties its left ones to the smallest of them, so its name goes no further. Edges
    are read several times and should be cheap to read."""
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("r")).where("a IS NOT NULL AND r IS NOT NULL")
    least = ends.groupBy(F.col("r").alias("_r")).agg(F.min("a").alias("b"))
    pairs = _stored(ends.join(least, F.col("r") == F.col("_r")).select("a", "b").distinct())
    nodes = components(pairs).select(F.col("node").alias("_node"), F.col("root").alias("cluster_id"))
    return _stored(edges.join(nodes, F.col(left) == F.col("_node")).drop("_node"))


def cluster_summary(clustered: DataFrame, left: str = "finding_id", right: str = "decision_id") -> DataFrame:
    """Per cluster: findings, decisions, links, outcome labels, best score, weighted adverse share, and whether its outcomes
    conflict, for manual review. An edge without a label conflicts with nothing."""
    adverse = F.coalesce((F.col("outcome_label") == "adverse").cast("double"), F.lit(0.0))
    sides = [clustered.groupBy("cluster_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.count(c).alias(name)) for c, name in ((left, "findings"), (right, "decisions"))]
    per_label = clustered.groupBy("cluster_id", "outcome_label").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sum("score").alias("weight"), F.sum(F.col("score") * adverse).alias("adverse")
    )
    out = per_label.groupBy("cluster_id").agg(
        F.sum("n").alias("links"),
        F.array_sort(F.collect_list("outcome_label")).alias("outcomes"),  # one entry per label
        F.max("best").alias("best_score"),
        F.sum("weight").alias("_weight"),
        F.sum("adverse").alias("_adverse"),
    )
    share = F.when(F.col("_weight") > 0, F.col("_adverse") / F.col("_weight")).otherwise(F.lit(0.0))
    out = out.withColumn("weighted_adverse", share).withColumn("conflicting", F.size("outcomes") > 1)
    for side in sides:
        out = out.join(side, "cluster_id")
    return out.select("cluster_id", "findings", "decisions", "links", "outcomes", "best_score", "weighted_adverse", "conflicting")


def finding_clusters(clustered: DataFrame, left: str = "finding_id", right: str = "decision_id") -> DataFrame:
    """Every finding with its cluster, the cluster's size (findings and decisions) and its conflict flag."""
    totals = cluster_summary(clustered, left, right).select("cluster_id", (F.col("findings") + F.col("decisions")).alias("cluster_size"), "conflicting")
    return clustered.select(left, "cluster_id").distinct().join(totals, "cluster_id").select(left, "cluster_id", "cluster_size", "conflicting")
