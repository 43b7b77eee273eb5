"""Scores of partitionings and placements."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hull_cells
from .hypergraph import Hardware, Hypergraph
from .transform import of_parts

MOVES = ((1, 0), (0, 1), (-1, 0), (0, -1))


def connectivity(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """One row: over hyperedges, weight times the parts entered besides the own one."""
    cut = of_parts(graph, assignment).where("source_part <> dst_part").select("he_id", "dst_part", "weight").distinct()
    return cut.agg(F.count(F.lit(1)).alias("cut_pins"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("connectivity"))


def plain_cut(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """One row: total weight of the hyperedges with members in several parts."""
    he = of_parts(graph, assignment).groupBy("he_id").agg(F.max(F.col("source_part") != F.col("dst_part")).alias("cut"), F.first("weight").alias("weight"))
    return he.agg(F.coalesce(F.sum(F.when(F.col("cut"), F.col("weight"))), F.lit(0.0)).alias("cut_weight"), F.coalesce(F.sum(F.col("cut").cast("long")), F.lit(0)).alias("cut_hedges"))


def swap_cost(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """One row: over hyperedges, weight times the parts entered, the own one included."""
    each = of_parts(graph, assignment).select("he_id", "dst_part", "weight").distinct()
    return each.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("swap_cost"))


def part_loads(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """(part, n_nodes, n_axons, n_synapses): nodes, distinct hyperedges and pins that enter."""
    enter = graph.pins.join(assignment.withColumnRenamed("node", "dst"), "dst").groupBy("part", "he_id").agg(F.count(F.lit(1)).alias("n"))
    enter = enter.groupBy("part").agg(F.count(F.lit(1)).alias("n_axons"), F.sum("n").alias("n_synapses"))
    nodes = assignment.groupBy("part").agg(F.count(F.lit(1)).alias("n_nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(enter, "part", "left").select("part", "n_nodes", zero("n_axons"), zero("n_synapses"))


def partition_validity(graph: Hypergraph, assignment: DataFrame, hw: Hardware) -> DataFrame:
    """One row: the number of parts, those that break each capacity, whether ids are contiguous, and whether all is valid."""
    p = part_loads(graph, assignment).agg(
        F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("n_nodes") > hw.neurons_per_core).alias("over_nodes"), F.count_if(F.col("n_axons") > hw.axons_per_core).alias("over_axons"),
        F.count_if(F.col("n_synapses") > hw.synapses_per_core).alias("over_synapses"), ((F.min("part") == 0) & (F.max("part") == F.count(F.lit(1)) - 1)).alias("contiguous"),
    )
    return p.withColumn("valid", F.col("contiguous") & (F.col("n_parts") <= hw.cores) & (F.col("over_nodes") + F.col("over_axons") + F.col("over_synapses") == 0))


def fit_checks(graph: Hypergraph, hw: Hardware) -> DataFrame:
    """One row: the necessary conditions for a hypergraph to fit."""
    inbound = graph.pins.groupBy("dst").count().agg(F.max("count").alias("most"), F.sum("count").alias("total"))
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return inbound.crossJoin(F.broadcast(n)).select(
        (F.col("n") <= hw.cores * hw.neurons_per_core).alias("nodes_fit"), (F.coalesce("most", F.lit(0)) <= hw.axons_per_core).alias("axons_fit"),
        (F.coalesce("total", F.lit(0)) <= hw.cores * hw.synapses_per_core).alias("synapses_fit"), (F.coalesce("most", F.lit(0)) <= hw.synapses_per_core).alias("node_synapses_fit"),
    )


def synaptic_reuse(graph: Hypergraph, assignment: DataFrame) -> DataFrame:
    """One row: arithmetic and geometric mean over all parts of synapses per axon; parts without axons count 0, and in the geometric mean as 1."""
    ratio = part_loads(graph, assignment).select(F.when(F.col("n_axons") > 0, F.col("n_synapses") / F.col("n_axons")).otherwise(0.0).alias("r"))
    return ratio.agg(F.round(F.avg("r"), 6).alias("ar_mean"), F.round(F.exp(F.coalesce(F.sum(F.when(F.col("r") > 0, F.ln("r"))), F.lit(0.0)) / F.count(F.lit(1))), 6).alias("geo_mean"))


def pair_weights(graph: Hypergraph) -> DataFrame:
    """(u, v, weight), u < v: the weights of the hyperedges that enter both."""
    p = graph.pins.select("he_id", "dst", "weight").distinct()
    return p.alias("x").join(p.select("he_id", F.col("dst").alias("v")).alias("y"), "he_id").where("x.dst < y.v").groupBy(F.col("x.dst").alias("u"), F.col("y.v").alias("v")).agg(F.sum("weight").alias("weight"))


def neighbor_weights(graph: Hypergraph) -> DataFrame:
    """(u, v, weight), u < v: the weights of the hyperedges that both are members of."""
    m = graph.members()
    return m.alias("x").join(m.select("he_id", F.col("node").alias("v")).alias("y"), "he_id").where("x.node < y.v").groupBy(F.col("x.node").alias("u"), F.col("y.v").alias("v")).agg(F.sum("weight").alias("weight"))


def routes(graph: Hypergraph, placement: DataFrame) -> DataFrame:
    """pins of a hypergraph over parts with the cores of their ends and their distance: sx, sy, dx, dy, d."""
    start = placement.select(F.col("part").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    end = placement.select(F.col("part").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return graph.pins.join(start, "source").join(end, "dst").withColumn("d", F.abs(F.col("sx") - F.col("dx")) + F.abs(F.col("sy") - F.col("dy")))


def metric_columns(hw: Hardware) -> dict[str, Column]:
    """Energy, latencies and mean congestion as aggregates over routes."""
    energy = F.sum(F.col("weight") * ((F.col("d") + 1) * hw.energy_per_routing + F.col("d") * hw.energy_per_wire))
    delay = (F.col("d") + 1) * hw.latency_per_routing + F.col("d") * hw.latency_per_wire
    return {
        "energy": F.round(F.coalesce(energy, F.lit(0.0)), 3), "avg_latency": F.round(F.coalesce(F.sum(F.col("weight") * delay) / F.sum("weight"), F.lit(0.0)), 6),
        "max_latency": F.round(F.coalesce(F.max(delay), F.lit(0.0)), 6), "avg_congestion": F.round(F.coalesce(F.sum(F.col("weight") * (F.col("d") + 1)), F.lit(0.0)) / hw.cores, 6),
    }


def metrics(graph: Hypergraph, placement: DataFrame, hw: Hardware, names: list[str]) -> DataFrame:
    """One row with the named metrics, in one pass."""
    columns = metric_columns(hw)
    return routes(graph, placement).agg(*[columns[n].alias(n) for n in names])


def compound(graph: Hypergraph, placement: DataFrame, hw: Hardware) -> DataFrame:
    out = metrics(graph, placement, hw, ["energy", "avg_latency"])
    return out.select(F.round(F.col("energy") * F.col("avg_latency"), 0).alias("compound"))


def transit(i: Column, j: Column, dx: Column, dy: Column, most: int) -> Column:
    """Probability that a shortest route over (dx, dy), which turns to either side alike until it is on the target's line, visits the offset (i, j)."""
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(2 * most + 2)])
    at = lambda k: F.get(logs, k.cast("int"))
    choose = lambda n, k: F.exp(at(n) - at(k) - at(n - k) - n * math.log(2))
    along = lambda a, b: F.aggregate(F.sequence(F.lit(0).cast("long"), b), F.lit(0.0), lambda s, k: s + choose(a - 1 + k, k) / 2)
    return F.when((dx == 0) | (dy == 0) | ((i == dx) & (j == dy)), 1.0).when((i < dx) & (j < dy), choose(i + j, i)).when(i == dx, along(dx, j)).otherwise(along(dy, i))


def congestion(graph: Hypergraph, placement: DataFrame, hw: Hardware) -> DataFrame:
    """(x, y, load) of the cores that any route may visit. Routes with equal ends are summed before they are spread over their boxes."""
    r = routes(graph, placement).groupBy("sx", "sy", "dx", "dy").agg(F.sum("weight").alias("weight"))
    ex, ey = F.abs(F.col("dx") - F.col("sx")), F.abs(F.col("dy") - F.col("sy"))
    cells = r.withColumn("ex", ex).withColumn("ey", ey).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ex")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ey"))))
    p = transit(F.col("i"), F.col("j"), F.col("ex"), F.col("ey"), max(hw.width, hw.height))
    x, y = F.col("sx") + F.signum(F.col("dx") - F.col("sx")) * F.col("i"), F.col("sy") + F.signum(F.col("dy") - F.col("sy")) * F.col("j")
    return cells.groupBy(x.cast("long").alias("x"), y.cast("long").alias("y")).agg(F.sum(F.col("weight") * p).alias("load"))


def placement_validity(assignment: DataFrame, placement: DataFrame, hw: Hardware) -> DataFrame:
    """One row: parts, placed parts, those out of bounds, cores taken twice, and whether all is valid."""
    parts = assignment.agg(F.count_distinct("part").alias("n_parts"))
    own = placement.agg(F.count_distinct("part").alias("n_placed"), F.count_if(~F.col("x").between(0, hw.width - 1) | ~F.col("y").between(0, hw.height - 1)).alias("out_of_bounds"), (F.count(F.lit(1)) - F.count_distinct("x", "y")).alias("taken_twice"))
    return own.crossJoin(F.broadcast(parts)).select("n_parts", "n_placed", "out_of_bounds", "taken_twice", ((F.col("n_parts") == F.col("n_placed")) & (F.col("out_of_bounds") == 0) & (F.col("taken_twice") == 0)).alias("valid"))


def locality(graph: Hypergraph, placement: DataFrame, hw: Hardware) -> DataFrame:
    """One row: means over hyperedges of the cores in the convex hull of their members' cores. Equal sets of cores are counted once."""
    ends = graph.pins.select("he_id", F.col("dst").alias("part"), "weight").union(graph.pins.select("he_id", "source", "weight")).distinct().join(placement, "part")
    sets = ends.groupBy("he_id").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("cores"), F.first("weight").alias("weight"))
    sets = sets.groupBy("cores").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))

    @F.pandas_udf("long")
    def cells(xs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in xs:
            yield pd.Series([hull_cells(list(zip(p, q, strict=True)), hw.width, hw.height) for p, q in zip(a, b, strict=True)])

    c = sets.select("n", "w", cells(F.col("cores.x"), F.col("cores.y")).alias("c"))
    total = lambda w, v: F.sum(F.col(w) * v) / F.sum(w)
    return c.agg(*[F.round(v, 6).alias(k) for k, v in {"ar_mean": total("n", F.col("c")), "geo_mean": F.exp(total("n", F.ln("c"))), "ar_mean_weighted": total("w", F.col("c")), "geo_mean_weighted": F.exp(total("w", F.ln("c")))}.items()])


def forces(graph: Hypergraph, placement: DataFrame) -> DataFrame:
    """(part, mx, my, force): what moving a part by one core to each side saves of the potential, the weighted distance (at least 1) to sources and destinations."""
    r = routes(graph, placement)
    ends = r.select(F.col("dst").alias("part"), (F.col("dx") - F.col("sx")).alias("ox"), (F.col("dy") - F.col("sy")).alias("oy"), "weight").union(r.select("source", F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy"), "weight"))
    far = lambda x, y: F.greatest(F.abs(x) + F.abs(y), F.lit(1))
    each = ends.groupBy("part").agg(*[F.sum(F.col("weight") * (far(F.col("ox"), F.col("oy")) - far(F.col("ox") + mx, F.col("oy") + my))).alias(f"f{k}") for k, (mx, my) in enumerate(MOVES)])
    all_parts = placement.select("part").join(each, "part", "left")
    return all_parts.select("part", F.explode(F.array(*[F.struct(F.lit(mx).alias("mx"), F.lit(my).alias("my"), F.coalesce(F.col(f"f{k}"), F.lit(0.0)).alias("force")) for k, (mx, my) in enumerate(MOVES)])).alias("f")).select("part", "f.*")


def active_cores(placement: DataFrame) -> DataFrame:
    """(y, xs): the used columns of each row of the lattice."""
    return placement.groupBy("y").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("xs"))


def all_six(graph: Hypergraph, assignment: DataFrame, placement: DataFrame, hw: Hardware) -> DataFrame:
    """One row: energy, latencies, mean and greatest congestion, and localities; all null if the placement isn't valid."""
    names = ["energy", "avg_latency", "max_latency", "avg_congestion"]
    most = congestion(graph, placement, hw).agg(F.round(F.max("load"), 3).alias("max_congestion"))
    all_of = metrics(graph, placement, hw, names).crossJoin(F.broadcast(most)).crossJoin(F.broadcast(locality(graph, placement, hw)))  # one row each
    return all_of.crossJoin(F.broadcast(placement_validity(assignment, placement, hw).select("valid"))).select("valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in all_of.columns])
