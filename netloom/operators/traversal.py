"""Breadth-first levels, path lengths, topological levels, cycles and components. Loops write each step to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hypergraph import Hypergraph
from .tables import settled


def edges(graph: Hypergraph) -> DataFrame:
    return graph.pins.select("source", "dst").distinct()


def bfs_levels(graph: Hypergraph, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, level) for each node that each start reaches."""
    step = settled(edges(graph))
    seen = front = settled(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("level")))
    level = 0
    while most is None or level < most:
        level += 1
        new = front.join(step, front["node"] == step["source"]).select("start", F.col("dst").alias("node")).distinct()
        front = settled(new.join(seen, ["start", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def average_path_length(graph: Hypergraph, starts: DataFrame) -> DataFrame:
    """One row: the mean distance over reachable ordered pairs from the starts; null if there are none."""
    return bfs_levels(graph, starts).where("level > 0").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("level"), 6).alias("mean_distance"))


def sampled(graph: Hypergraph, k: int, seed: int) -> DataFrame:
    """k nodes, drawn by a hash of their ids."""
    return graph.nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k)


def topological_levels(graph: Hypergraph) -> DataFrame:
    """(node, level): the longest path from a node without inbound pins, by peeling; nodes on or behind a cycle have none."""
    step = settled(edges(graph))
    degree = settled(graph.nodes.join(step.groupBy(F.col("dst").alias("node")).count(), "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("open")))
    out, level = None, 0
    while True:
        ready = settled(degree.where("open = 0").select("node", F.lit(level).alias("level")))
        if ready.isEmpty():
            return out if out is not None else ready
        out = ready if out is None else out.union(ready)
        less = step.join(ready, step["source"] == ready["node"]).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("less"))
        degree = settled(degree.where("open > 0").join(less, "node", "left").select("node", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")))
        level += 1


def has_cycle(graph: Hypergraph) -> DataFrame:
    """One row: whether peeling leaves nodes."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return topological_levels(graph).agg(F.count(F.lit(1)).alias("peeled")).crossJoin(F.broadcast(n)).select((F.col("peeled") < F.col("n")).alias("has_cycle"))


def components(graph: Hypergraph) -> DataFrame:
    """(node, component): the least node that is connected in either direction. Least labels spread, and are looked up at the labelled node."""
    both = settled(edges(graph).union(edges(graph).select("dst", "source")).where("source <> dst").distinct())
    label = settled(graph.nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("source").agg(F.min("component").alias("near"))
        new = label.join(near, label["node"] == near["source"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        hop = label.select(F.col("node").alias("h"), F.col("component").alias("further"))
        new = settled(new.join(hop, F.col("component") == F.col("h")).select("node", F.least("component", "further").alias("component")))
        if new.join(label, "node").where(new["component"] != label["component"]).isEmpty():
            return new
        label = new


def reach(step: DataFrame, nodes: DataFrame, by: str, to: str) -> DataFrame:
    """(node, colour): the greatest colour of the nodes that lead to a node."""
    label = settled(nodes.select("node", F.col("node").alias("colour")))
    while True:
        into = step.join(label, step[by] == label["node"]).groupBy(F.col(to).alias("node")).agg(F.max("colour").alias("more"))
        new = settled(label.join(into, "node", "left").select("node", F.greatest("colour", F.coalesce("more", "colour")).alias("colour")))
        if new.join(label, "node").where(new["colour"] != label["colour"]).isEmpty():
            return new
        label = new


def strong_components(graph: Hypergraph) -> DataFrame:
    """(node, component), the greatest node of the component, by colouring forward and collecting backward."""
    step, left, out = settled(edges(graph)), settled(graph.nodes), None
    while not left.isEmpty():
        colour = reach(step, left, "source", "dst")
        own = step.join(colour.withColumnRenamed("node", "source"), "source").withColumnRenamed("colour", "cs").join(colour.withColumnRenamed("node", "dst"), "dst").where("cs = colour").select("source", "dst")
        own, front = settled(own), settled(colour.where("node = colour"))
        found = front
        while not front.isEmpty():
            back = own.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("source").alias("node"), "colour").distinct()
            front = settled(back.join(found, "node", "left_anti"))
            found = settled(found.union(front))
        part = found.select("node", F.col("colour").alias("component"))
        out = part if out is None else settled(out.union(part))
        left = settled(left.join(found, "node", "left_anti"))
        step = settled(step.join(left.withColumnRenamed("node", "source"), "source", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return out
