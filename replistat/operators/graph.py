"""Rounds over edge tables: connected components and greedy elimination.

Every round is a few joins and partial aggregates; the state is written to the checkpoint folder
between rounds so that plans stay short and a lost executor costs one round at most. Only one
number per round (rows still open) comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, unless_large


def _stored(df: DataFrame) -> DataFrame:
    """Written once; joined by merge when it has many rows, as its compressed files would pass for a small table."""
    return unless_large(cut_lineage(df))


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Smallest reachable node per node, column ``component``. ``nodes`` may hold isolated nodes.

    Each round takes the smallest label among the neighbours and then follows labels one hop
    further (pointer jumping), so the number of rounds grows with the logarithm of the diameter.
    Only nodes with an edge take part in the rounds.
    """
    both = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).filter(F.col("_from") != F.col("_to"))
    both = _stored(both.unionByName(both.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))).distinct())
    every = _stored(nodes.select(F.col(node).alias("_node")).distinct())
    first = both.groupBy("_from").agg(F.min("_to").alias("_m"))
    labels = _stored(every.join(first, F.col("_node") == F.col("_from")).select("_node", F.least("_node", "_m").alias("_label")))
    while True:
        known = labels.select(F.col("_node").alias("_n2"), F.col("_label").alias("_l2"))
        near = (
            both.join(known, F.col("_to") == F.col("_n2"))
            .groupBy("_from").agg(F.min("_l2").alias("_m"))
        )
        hooked = labels.join(near, F.col("_node") == F.col("_from"), "left").select(
            "_node", F.col("_label").alias("_old"), F.least("_label", "_m").alias("_new"))
        # pull the smallest label seen by any member to the old root, then jump
        roots = hooked.groupBy("_old").agg(F.min("_new").alias("_root")).select(F.col("_old").alias("_o2"), "_root")
        moved = hooked.join(roots, F.col("_old") == F.col("_o2")).select(
            "_node", "_old", F.least("_new", "_root").alias("_mid"))
        jump = moved.select(F.col("_node").alias("_n3"), F.col("_mid").alias("_l3"))
        done = _stored(moved.join(jump, F.col("_mid") == F.col("_n3")).select(
            "_node", "_old", F.least("_mid", "_l3").alias("_label")))
        open_rows = done.filter(F.col("_label") != F.col("_old")).count()
        labels = done.select("_node", "_label")
        if open_rows == 0:
            linked = labels.select(F.col("_node").alias("_n2"), "_label")
            return every.join(linked, F.col("_node") == F.col("_n2"), "left").select(
                F.col("_node").alias(node), F.coalesce("_label", "_node").alias("component"))


def greedy_losers(edges: DataFrame, a: str, b: str, order: list[str | Column], loser: Column,
                  keep: list[str] = ()) -> DataFrame:
    """Edges resolved by the sequential rule "take edges in order, skip those with a lost end".

    An edge that comes first at both of its ends is safe to resolve; all such edges of a round are
    resolved together and every edge that touches a loser leaves. Returns the resolved edges with
    the column ``loser``; the outcome equals the one-by-one loop over the total order.
    """
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    todo = _stored(edges.withColumn("_rank", rank).withColumn("loser", loser))
    resolved = todo.limit(0)
    while True:
        ends = todo.select(F.col(a).alias("_v"), "_rank").unionByName(todo.select(F.col(b).alias("_v"), "_rank"))
        lead = ends.groupBy("_v").agg(F.min("_rank").alias("_lead"))
        at_a = lead.select(F.col("_v").alias("_va"), F.col("_lead").alias("_la"))
        at_b = lead.select(F.col("_v").alias("_vb"), F.col("_lead").alias("_lb"))
        now = _stored(
            todo.join(at_a, (F.col(a) == F.col("_va")) & (F.col("_rank") == F.col("_la")))
            .join(at_b, (F.col(b) == F.col("_vb")) & (F.col("_rank") == F.col("_lb")))
            .select(*todo.columns))
        resolved = resolved.unionByName(now)
        gone = now.select(F.col("loser").alias("_gone"))
        todo = _stored(
            todo.join(gone, F.col(a) == F.col("_gone"), "left_anti")
            .join(gone, F.col(b) == F.col("_gone"), "left_anti"))
        if todo.isEmpty():
            return resolved.select(a, b, "loser", *keep)


def greedy_kept(nodes: DataFrame, edges: DataFrame, node: str, first: str, second: str) -> DataFrame:
    """Nodes that survive "walk the order, drop a node with an earlier kept neighbour".

    ``edges`` point from the earlier to the later node. A node without an open earlier neighbour is
    kept, its later neighbours are dropped, and both leave; repeat until nothing is open.
    """
    open_edges = _stored(edges.select(F.col(first).alias("_e"), F.col(second).alias("_l")).distinct())
    dropped = open_edges.select(F.col("_l").alias("_d")).limit(0)
    while not open_edges.isEmpty():
        late = open_edges.select(F.col("_l").alias("_x")).distinct()
        leaders = open_edges.join(late, F.col("_e") == F.col("_x"), "left_anti").select(F.col("_e").alias("_k")).distinct()
        out = _stored(open_edges.join(leaders, F.col("_e") == F.col("_k"), "left_semi")
                          .select(F.col("_l").alias("_d")).distinct())
        dropped = dropped.unionByName(out)
        open_edges = _stored(
            open_edges.join(out, F.col("_e") == F.col("_d"), "left_anti")
            .join(out, F.col("_l") == F.col("_d"), "left_anti"))
    return nodes.join(dropped, F.col(node) == F.col("_d"), "left_anti")
