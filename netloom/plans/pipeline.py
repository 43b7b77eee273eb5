"""Composite pipelines: partition, contract, place, score; each is a row of a registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import partition as P
from ..operators import place as L
from ..operators import scores, stats, transform
from ..operators.hypergraph import Hardware, Hypergraph
from ..operators.order import feed_forward_order, topological_order_without_cycles
from ..operators.tables import settled


@dataclass(frozen=True)
class Pipeline:
    partitioner: str
    placer: str
    orderer: str | None = None

    @property
    def name(self) -> str:
        return f"{self.partitioner}-{self.placer}" if self.orderer is None else f"{self.partitioner}-{self.orderer}-{self.placer}"


#: By the partitioners' and placers' names; force_directed refines a spectral placement.
PARTITIONERS = ("sequential", "greedy", "edge_hiding", "hyperedge_hiding", "swap", "multistart", "similar", "multilevel")
PLACERS = ("hilbert", "spectral", "force_directed", "swarm", "min_distance")
#: Orders of nodes before sequential partitioning, and of parts before they are placed along a curve.
ORDERERS = {"feed_forward": feed_forward_order, "topological": topological_order_without_cycles}
REGISTRY = {p.name: p for p in (*(Pipeline(a, b) for a in PARTITIONERS for b in PLACERS), *(Pipeline("sequential", b, o) for o in ORDERERS for b in PLACERS))}


def ordered(graph: Hypergraph, orderer: str | None) -> tuple[Hypergraph, DataFrame | None]:
    """The graph with its nodes renumbered in an order, and (node, new)."""
    if orderer is None or stats.topologically_sorted(graph).first()[0]:
        return graph, None
    names = settled(ORDERERS[orderer](graph))
    return transform.relabel(graph, names), names


def partitioned(graph: Hypergraph, hw: Hardware, method: str) -> DataFrame:
    if method == "sequential":
        return P.partition_sequential(graph, hw.caps)
    if method == "similar":
        return P.partition_similar(graph, hw.caps)
    if method == "multilevel":
        return P.partition_multilevel(graph, hw.caps)
    return P.partition(graph, hw.caps, method, (192, 193, 194) if method == "multistart" else (192,))


def run(graph: Hypergraph, hw: Hardware, pipeline: Pipeline) -> DataFrame:
    """One record: name, parts, connectivity, and the placement's validity and metrics. The pins are written once, as each step reads them."""
    graph = Hypergraph(settled(graph.nodes), settled(graph.pins))
    own, names = ordered(graph, pipeline.orderer)
    assignment = settled(partitioned(own, hw, pipeline.partitioner))
    if names is not None:
        assignment = settled(assignment.withColumnRenamed("node", "new").join(names, "new").select("node", "part"))
    return placed(graph, hw, assignment, pipeline)


def placed(graph: Hypergraph, hw: Hardware, assignment: DataFrame, pipeline: Pipeline) -> DataFrame:
    """The record of a given partitioning: what comes after it only. The parts of a curve placement are put in order first."""
    small = transform.as_graph(settled(transform.contract(graph, assignment, squish_equal=True)), assignment.select(F.col("part").alias("node")).distinct())
    if pipeline.placer == "hilbert":
        turned, names = ordered(small, pipeline.orderer)
        placement = settled(L.hilbert(turned, hw))
        if names is not None:
            placement = settled(placement.join(names, F.col("part") == F.col("new")).select(F.col("node").alias("part"), "x", "y"))
    else:
        placement = settled(L.place(small, hw, pipeline.placer))
    out = scores.metrics(small, placement, hw, ["energy", "avg_latency", "max_latency", "avg_congestion"])
    cost = scores.connectivity(graph, assignment).select("connectivity")
    count = assignment.agg(F.count_distinct("part").alias("n_parts"))
    valid = scores.partition_validity(graph, assignment, hw).select(F.col("valid").alias("part_valid")).crossJoin(F.broadcast(scores.placement_validity(assignment, placement, hw).select(F.col("valid").alias("placement_valid"))))
    return out.crossJoin(F.broadcast(cost)).crossJoin(F.broadcast(count)).crossJoin(F.broadcast(valid)).select(F.lit(pipeline.name).alias("name"), "n_parts", "connectivity", "part_valid", "placement_valid", *out.columns)  # one row each
