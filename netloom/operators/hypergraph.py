"""The hypergraph: nodes, and pins that tie hyperedges to their destinations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hypergraph:
    """nodes(node); pins(he_id, source, dst, weight): one row for each destination of a hyperedge. Immutable: operators give new ones."""

    nodes: DataFrame
    pins: DataFrame

    def hyperedges(self) -> DataFrame:
        """he_id, source, weight, n_dst."""
        return self.pins.groupBy("he_id").agg(F.first("source").alias("source"), F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n_dst"))

    def listed(self) -> DataFrame:
        """he_id, source, weight, dsts (sorted, without repeats)."""
        return self.pins.groupBy("he_id").agg(F.first("source").alias("source"), F.first("weight").alias("weight"), F.array_sort(F.collect_set("dst")).alias("dsts"))

    def members(self) -> DataFrame:
        """he_id, node, weight: sources and destinations, each node once for a hyperedge."""
        return self.pins.select("he_id", F.col("dst").alias("node"), "weight").union(self.pins.select("he_id", "source", "weight")).distinct()

    def outbound(self, nodes: DataFrame) -> DataFrame:
        """(node, he_id): the hyperedges that leave each of the nodes."""
        return self.pins.join(nodes.select("node"), F.col("source") == F.col("node")).select("node", "he_id").distinct()

    def inbound(self, nodes: DataFrame) -> DataFrame:
        """(node, he_id): the hyperedges that enter each of the nodes."""
        return self.pins.join(nodes.select("node"), F.col("dst") == F.col("node")).select("node", "he_id").distinct()

    def touching(self, nodes: DataFrame) -> DataFrame:
        """(node, he_id): the hyperedges that leave or enter, each once."""
        return self.outbound(nodes).union(self.inbound(nodes)).distinct()

    def with_nodes(self, more: DataFrame) -> Hypergraph:
        """With more nodes (node); known ones aren't repeated."""
        return Hypergraph(self.nodes.union(more.select("node")).distinct(), self.pins)

    def violations(self) -> DataFrame:
        """Rows of pins that name an unknown node or lack a field."""
        known = self.nodes.select(F.col("node").alias("k"))
        bad = self.pins.where("he_id IS NULL OR source IS NULL OR dst IS NULL OR weight IS NULL").withColumn("why", F.lit("null"))
        for end in ("source", "dst"):
            bad = bad.union(self.pins.join(known, F.col(end) == F.col("k"), "left_anti").withColumn("why", F.lit(f"unknown {end}")))
        return bad


@dataclass(frozen=True)
class Caps:
    """At most `nodes` nodes, `axons` distinct hyperedges that enter and `synapses` pins that enter a part; at most `parts` parts."""

    nodes: int
    axons: int
    synapses: int
    parts: int


@dataclass(frozen=True)
class Hardware:
    """A lattice of cores with capacities and costs."""

    neurons_per_core: int
    axons_per_core: int
    synapses_per_core: int
    width: int
    height: int
    energy_per_routing: float = 1.7
    energy_per_wire: float = 3.5
    latency_per_routing: float = 2.1
    latency_per_wire: float = 5.3

    @property
    def cores(self) -> int:
        return self.width * self.height

    @property
    def caps(self) -> Caps:
        return Caps(self.neurons_per_core, self.axons_per_core, self.synapses_per_core, self.cores)
