"""Degrees and structural statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hypergraph import Hypergraph


def degrees(graph: Hypergraph) -> DataFrame:
    """(node, n_out, n_in, n_touch): hyperedges that leave, pins that enter, and their sum."""
    leave = graph.hyperedges().groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    enter = graph.pins.groupBy(F.col("dst").alias("node")).agg(F.lit(0).cast("long").alias("n_out"), F.count(F.lit(1)).alias("n_in"))
    none = graph.nodes.select("node", F.lit(0).cast("long").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    out = leave.union(enter).union(none).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    return out.withColumn("n_touch", F.col("n_out") + F.col("n_in"))


def overlap(graph: Hypergraph) -> DataFrame:
    """One row: of all pairs of hyperedges, the mean number of shared members; 0 with fewer than two."""
    c = graph.members().groupBy("node").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("shared"))
    e = graph.hyperedges().agg(F.count(F.lit(1)).alias("e"))
    return c.crossJoin(F.broadcast(e)).select(F.when(F.col("e") < 2, 0.0).otherwise(F.round(F.col("shared") / (F.col("e") * (F.col("e") - 1) / 2), 6)).alias("overlap"))


def clustering(graph: Hypergraph, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(node, pairs, closed, coefficient) of each node, or of a seeded sample: pairs of out-neighbours, and those with an edge in either direction."""
    out = graph.pins.where("source <> dst").select("source", "dst").distinct()
    nodes = graph.nodes if sample is None else graph.nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample)
    of = out.join(nodes.withColumnRenamed("node", "source"), "source")
    edge = out.select(F.least("source", "dst").alias("a"), F.greatest("source", "dst").alias("b")).distinct()
    pairs = of.alias("x").join(of.alias("y"), "source").where("x.dst < y.dst").select(F.col("source").alias("node"), F.col("x.dst").alias("a"), F.col("y.dst").alias("b"))
    count = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
    closed = pairs.join(edge, ["a", "b"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("closed"))
    joined = nodes.join(count, "node", "left").join(closed, "node", "left").select("node", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.coalesce("closed", F.lit(0)).cast("long").alias("closed"))
    return joined.withColumn("coefficient", F.when(F.col("pairs") == 0, 0.0).otherwise(F.round(F.col("closed") / F.col("pairs"), 6)))


def statistics(graph: Hypergraph) -> DataFrame:
    """One row of counts and means; edges_count counts sources too."""
    he = graph.hyperedges().agg(F.count(F.lit(1)).alias("hedges_count"), F.sum(F.col("n_dst") + 1).alias("edges_count"), F.sum("n_dst").alias("connections"), F.sum(F.col("weight") * F.col("n_dst")).alias("total_frequency"), F.sum("weight").alias("w"))
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes_count"))
    mean = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return he.crossJoin(F.broadcast(n)).select(
        "nodes_count", "hedges_count", "edges_count", "total_frequency", mean("edges_count", "hedges_count").alias("nodes_per_hedge_mean"), mean("edges_count", "nodes_count").alias("hedges_per_node_mean"),
        mean("hedges_count", "nodes_count").alias("outbound_mean"), mean("connections", "nodes_count").alias("inbound_mean"), mean("w", "hedges_count").alias("frequency_mean"),
    )


def topologically_sorted(graph: Hypergraph) -> DataFrame:
    """One row: whether no pin leads to a smaller id."""
    return graph.pins.agg(F.coalesce(F.min(F.col("dst") >= F.col("source")), F.lit(True)).alias("sorted"))


def top_degrees(graph: Hypergraph, k: int = 5) -> DataFrame:
    return degrees(graph).orderBy(F.desc("n_touch"), "node").limit(k)


def isolated(graph: Hypergraph) -> DataFrame:
    return degrees(graph).where("n_touch = 0").select("node")
