"""Transforms of hypergraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hypergraph import Hypergraph
from .tables import settled


def to_graph(graph: Hypergraph, collapse: bool = False) -> DataFrame:
    """Edges (src, dst, weight), one for each pin, or with the weights of parallel ones summed."""
    edges = graph.pins.select(F.col("source").alias("src"), "dst", "weight")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if collapse else edges


def undirected(graph: Hypergraph) -> DataFrame:
    """Edges (a, b, weight) with a <= b; both directions and parallel edges summed."""
    return graph.pins.groupBy(F.least("source", "dst").alias("a"), F.greatest("source", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def of_parts(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """pins with the parts of their ends: source_part, dst_part. Spark broadcasts the assignment if it is small."""
    to = assignment.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    start = assignment.select(F.col("node").alias("source"), F.col("part").alias("source_part"))
    return graph.pins.join(to, "dst").join(start, "source")


def contract(graph: Hypergraph, assignment: DataFrame, keep_self: bool = False, squish_equal: bool = False) -> DataFrame:
    """Hyperedges (he_id, source, dsts, weight) over parts: each goes to the set of its destinations' parts. Its own part is left out unless keep_self; equal ones can be merged, with summed weights and the least id."""
    to = assignment.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    start = assignment.select(F.col("node").alias("source_node"), F.col("part").alias("source"))
    out = graph.pins.join(to, "dst").groupBy("he_id").agg(F.first("source").alias("source_node"), F.array_sort(F.collect_set("dst_part")).alias("dsts"), F.first("weight").alias("weight"))
    out = out.join(start, "source_node").select("he_id", "source", "dsts" if keep_self else F.array_remove("dsts", F.col("source")).alias("dsts"), "weight").where(F.size("dsts") > 0)  # a row a hyperedge
    return merged(out) if squish_equal else out


def contracted(graph: Hypergraph, assignment: DataFrame) -> Hypergraph:
    """The hypergraph of contract() by pins, without lists of destinations: one row for each hyperedge and part besides the own one."""
    pins = of_parts(graph, assignment).where("source_part <> dst_part").groupBy("he_id", "dst_part").agg(F.first("source_part").alias("source"), F.first("weight").alias("weight"))
    return Hypergraph(assignment.select(F.col("part").alias("node")).distinct(), pins.select("he_id", "source", F.col("dst_part").alias("dst"), "weight"))


def merged(hyperedges: DataFrame) -> DataFrame:
    """Hyperedges with the same source and destinations become one."""
    return hyperedges.groupBy("source", "dsts").agg(F.min("he_id").alias("he_id"), F.sum("weight").alias("weight")).select("he_id", "source", "dsts", "weight")


def squish(graph: Hypergraph) -> DataFrame:
    return merged(graph.listed())


def as_graph(hyperedges: DataFrame, nodes: DataFrame) -> Hypergraph:
    """The hypergraph of (he_id, source, dsts, weight)."""
    return Hypergraph(nodes, hyperedges.select("he_id", "source", F.explode("dsts").alias("dst"), "weight"))


def relabel(graph: Hypergraph, names: DataFrame) -> Hypergraph:
    """New ids for all nodes: names (node, new)."""
    to, start = names.select(F.col("node").alias("dst"), F.col("new").alias("new_dst")), names.select(F.col("node").alias("source"), F.col("new").alias("new_source"))
    pins = graph.pins.join(to, "dst").join(start, "source").select("he_id", F.col("new_source").alias("source"), F.col("new_dst").alias("dst"), "weight")
    return Hypergraph(graph.nodes.join(names, "node").select(F.col("new").alias("node")), pins)


def running(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """df with the sum of value over all rows before, in a total order: prefix sums within ranges and over the ranges' sums, so that no task sees all rows.

    The bounds of the ranges are sampled, so that each evaluation may draw others: rows are dealt once, and written with
    their range's number; both the sums and the rows are read from there. There are as many ranges as shuffle partitions,
    64 at least.
    """
    ranges = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")  # one row a range


def remove_connections(graph: Hypergraph, fraction: float) -> DataFrame:
    """(he_id, removed, kept): of each hyperedge how many destinations go when the lightest connections, a fraction of all, are removed; the hyperedge at the border loses its first ones. Order: weight, id."""
    he = graph.hyperedges()
    target = he.agg(F.floor(F.sum("n_dst") * fraction).alias("target"))
    out = running(he, "n_dst", ["weight", "he_id"], "before").crossJoin(F.broadcast(target))
    gone = F.greatest(F.lit(0), F.least(F.col("n_dst"), F.col("target") - F.col("before")))
    return out.select("he_id", gone.cast("long").alias("removed"), (F.col("n_dst") - gone).cast("long").alias("kept"))


def remove_weight(graph: Hypergraph, fraction: float) -> DataFrame:
    """(he_id, removed, kept) when connections that make up a fraction of the total weight are removed, lightest first. A hyperedge that fits goes whole; of one that doesn't, as many destinations as fit.

    Weights ascend, so that once a single connection doesn't fit none does later: what is removed is a prefix, and a
    hyperedge that loses some is the last to lose any, unless the next have the same weight. The fold over them is exact
    on the prefix sums because a hyperedge that is cut leaves less than one weight of room.
    """
    he = graph.hyperedges().withColumn("total", F.col("weight") * F.col("n_dst"))
    target = he.agg((F.sum("total") * fraction).alias("target"))
    out = running(he, "total", ["weight", "he_id"], "before").crossJoin(F.broadcast(target))
    room = F.col("target") - F.col("before")
    gone = F.when(room <= 0, 0).otherwise(F.least(F.col("n_dst"), F.floor(room / F.col("weight"))))
    return out.select("he_id", gone.cast("long").alias("removed"), (F.col("n_dst") - gone).cast("long").alias("kept"))


def add_hyperedges(graph: Hypergraph, more: DataFrame, add_missing: bool = False) -> Hypergraph:
    """With more pins; nodes that they name are added, or else pins with unknown ends are refused by violations()."""
    pins = graph.pins.unionByName(more.select("he_id", "source", "dst", "weight"))
    nodes = graph.nodes.union(more.select("source")).union(more.select("dst")).distinct() if add_missing else graph.nodes
    return Hypergraph(nodes, pins)
