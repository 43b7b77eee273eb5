"""More queries of the catalogue: parts of hypergraphs, files, indexes, products of results, and what must hold of partitionings, placements and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import order, place, scores, similarity, stats
from ..operators import results as R
from ..operators.hypergraph import Hypergraph
from ..operators.tables import settled, shared_folder
from ..sources import files
from . import fixtures as fx
from .catalog import _HE, ORACLES, _contracted, query

# ---- hyperedges of given nodes

_SOME = "+asked AS (SELECT node FROM nodes WHERE node % 7 = 3)"


def _some(g: Hypergraph) -> DataFrame:
    return g.nodes.where("node % 7 = 3")


@query(_SOME + " SELECT DISTINCT node, he_id FROM pins JOIN asked ON source = node", "basket")
def outbound_hyperedges(spark, d):
    g = fx.basket(spark, d)
    return g.outbound(_some(g))


@query(_SOME + " SELECT DISTINCT node, he_id FROM pins JOIN asked ON dst = node", "basket")
def inbound_hyperedges(spark, d):
    g = fx.basket(spark, d)
    return g.inbound(_some(g))


@query(_SOME + " SELECT DISTINCT node, he_id FROM pins JOIN asked ON dst = node OR source = node", "basket")
def touching_hyperedges(spark, d):
    g = fx.basket(spark, d)
    return g.touching(_some(g))


@query("SELECT node FROM nodes UNION SELECT node + 10 FROM nodes", "basket")
def add_nodes(spark, d):
    g = fx.basket(spark, d)
    return g.with_nodes(g.nodes.select((F.col("node") + 10).alias("node"))).nodes


# ---- functions


@query("SELECT x, y FROM range(12) a(x), range(12) b(y) WHERE x <= 10 AND y <= 9 AND 2 * y >= x - 2 AND y <= x + 4 AND 2 * x + y <= 25 AND 3 * x + y >= 4")
def points_in_polygon(spark, d):
    corners = [(1, 1), (2, 0), (10, 4), (10, 5), (8, 9), (5, 9), (0, 4)]
    cells = scalar.diagonals(spark, 12, 12).select("x", "y")
    return cells.where(scalar.in_polygon(F.col("x"), F.col("y"), corners))


@query(_HE + " SELECT he_id, row_number() OVER (ORDER BY n, he_id) - 1 AS at FROM hh", "basket")
def counting_sort(spark, d):
    return scalar.counting_sort(fx.basket(spark, d).hyperedges().select("he_id", "n_dst"), "n_dst", "he_id").select("he_id", "at")


@query("SELECT bins, bins * 4 >= 13 AND bins > 3 AS fits FROM range(2, 7) t(bins)")
def packing_fits(spark, d):
    return spark.createDataFrame([(b, order.can_distribute([3, 3, 3, 2, 1, 1], b, 4)) for b in range(2, 7)], "bins long, fits boolean")


# ---- files


@query("SELECT source, list_sort(list(DISTINCT dst)) AS dsts FROM pins GROUP BY he_id, source", "basket")
def csv_round_trip(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(fx.basket(spark, d), path)
    return files.read_csv(spark, path)


@query("SELECT 0 AS section, -1 AS n, 'nodedef>name VARCHAR,partition_block VARCHAR' AS line UNION ALL SELECT 0, node, node || ',' || part FROM assign UNION ALL SELECT 1, -1, 'edgedef>node1 VARCHAR,node2 VARCHAR,weight DOUBLE' UNION ALL SELECT 1, he_id, printf('%d,%d,%.3f', source, dst, weight) FROM pins", "basket", "assign")
def gdf_export(spark, d):
    g = fx.basket(spark, d)
    return files.gdf_lines(g, {"block": fx.assigned(g)})


@query("SELECT 0 AS section, -1 AS n, 'graph [ directed 1' AS line UNION ALL SELECT 3, -1, ']' UNION ALL SELECT 1, node, printf('node [ id %d label \"%d\" ]', node, node) FROM nodes UNION ALL SELECT 2, he_id, printf('edge [ source %d target %d weight %.3f ]', source, dst, weight) FROM pins", "basket")
def gml_export(spark, d):
    return files.gml_lines(fx.basket(spark, d))


# ---- scores


ORACLES["all_six_metrics"] = f"SELECT true AS valid, a.*, m.*, l.* FROM ({ORACLES['all_metrics']}) a, ({ORACLES['max_congestion']}) m, ({ORACLES['connections_locality']}) l"


@query()
def all_six_metrics(spark, d):
    g, p, hw, a = _contracted(spark, d)
    return scores.all_six(g, a, p, hw)


ORACLES["heavy_edge_matching"] = f"WITH n AS ({ORACLES['neighbor_weights']}), b AS (SELECT u a, v b, weight FROM n UNION ALL SELECT v, u, weight FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, least(a, b), greatest(a, b)) k FROM b) SELECT least(a, b) AS u, greatest(a, b) AS v FROM r WHERE k = 1 GROUP BY 1, 2 HAVING count(*) = 2"


# ---- index


def _index(spark, d):
    sets = fx.weighted_sets(fx.basket(spark, d))
    return sets, similarity.Index.of(sets.where("set_id % 3 = 0"))


_SETS = "+ws AS (SELECT DISTINCT dst set_id FROM pins)"


@query(_SETS + " SELECT set_id, set_id % 3 < 2 AND set_id % 5 <> 0 AS known FROM ws", "basket")
def index_contains(spark, d):
    sets, index = _index(spark, d)
    index = index.insert(sets.where("set_id % 3 < 2")).delete(sets.where("set_id % 5 = 0").select("set_id").distinct())
    return index.contains(sets.select("set_id").distinct())


@query(_SETS + " SELECT count(*) AS size FROM ws WHERE set_id % 3 = 0", "basket")
def index_size(spark, d):
    return _index(spark, d)[1].size()


@query(_SETS + " SELECT set_id, set_id AS other, 1.0::DOUBLE AS similarity FROM ws WHERE set_id % 3 = 0", "basket")
def index_finds_itself(spark, d):
    """A set that is indexed is found with similarity 1; of equal sets the greatest id comes first."""
    sets, index = _index(spark, d)
    found = index.query(sets.where("set_id % 3 = 0"), 1 << 30).where("set_id = other")
    return found.select("set_id", "other", "similarity")


@query()
def index_query_by_id(spark, d):
    sets, index = _index(spark, d)
    return index.query_ids(sets.where("set_id % 30 = 0").select("set_id").distinct(), 3)


# ---- products of results


@query("SELECT graph, technique, round(latency / min(latency) OVER (PARTITION BY graph), 6) AS latency, round(cost / max(cost) OVER (PARTITION BY graph), 6) AS cost FROM r", "results")
def case_study_ratios(spark, d):
    return R.ratios(fx.results(spark, d), ["latency"], ["cost"])


@query("+f AS (SELECT *, row_number() OVER (PARTITION BY graph, split_part(technique, '-', 1) ORDER BY technique) k FROM r) SELECT graph, split_part(technique, '-', 1) AS partitioner, round(energy / min(energy) OVER (PARTITION BY graph), 6) AS energy, round(cost / min(cost) OVER (PARTITION BY graph), 6) AS cost FROM f WHERE k = 1", "results")
def partitioning_ratios(spark, d):
    return R.partition_ratios(fx.results(spark, d), ["energy", "cost"])


@query("SELECT graph, technique, round(energy / min(energy) OVER (PARTITION BY graph), 6) AS energy FROM r WHERE technique LIKE '%O-%'", "results")
def placement_ratios(spark, d):
    return R.placement_ratios(fx.results(spark, d), "O-", ["energy"])


@query("SELECT graph, technique, round(energy / min(latency) OVER (PARTITION BY graph), 6) AS initial, round(latency / min(latency) OVER (PARTITION BY graph), 6) AS final FROM r", "results")
def initial_ratios(spark, d):
    return R.initial_ratios(fx.results(spark, d), "energy", "latency")


@query("SELECT substr(graph, 1, 1)::BIGINT AS size, technique, round(cost / min(cost) OVER (PARTITION BY substr(graph, 1, 1)), 6) AS cost FROM r WHERE substr(graph, 1, 1) BETWEEN '0' AND '9'", "results")
def scalability_ratios(spark, d):
    return R.by_size(fx.results(spark, d), ["cost"])


@query("SELECT split_part(technique, '-', 1) AS name, round(regr_slope(log10(energy), log10(cost)), 6) AS slope, round(regr_intercept(log10(energy), log10(cost)), 6) AS intercept, round(corr(log10(energy), log10(cost)), 6) AS pearson, count(*) AS n FROM r GROUP BY 1", "results")
def power_laws(spark, d):
    return R.fits_by(fx.results(spark, d), "cost", "energy", R.partitioner())


@query("SELECT round(regr_slope(log10(energy / latency), log10(cost)), 6) AS slope, round(regr_intercept(log10(energy / latency), log10(cost)), 6) AS intercept, round(corr(log10(energy / latency), log10(cost)), 6) AS pearson, count(*) AS n FROM r", "results")
def ratio_against_congestion(spark, d):
    return R.loglog_fit(fx.results(spark, d).withColumn("ratio", F.col("energy") / F.col("latency")), "cost", "ratio")


@query(
    "+l AS (SELECT log10(cost) - avg(log10(cost)) OVER () u, log10(latency) v FROM r), s AS (SELECT count(*) n, sum(u) u1, sum(u ** 2) u2, sum(u ** 3) u3, sum(u ** 4) u4, sum(v) v0, sum(v * u) v1, sum(v * u ** 2) v2 FROM l), t AS (SELECT *, n * (u2 * u4 - u3 * u3) - u1 * (u1 * u4 - u3 * u2) + u2 * (u1 * u3 - u2 * u2) det FROM s) "
    "SELECT round((v0 * (u2 * u4 - u3 * u3) - u1 * (v1 * u4 - u3 * v2) + u2 * (v1 * u3 - u2 * v2)) / det, 6) AS a, round((n * (v1 * u4 - u3 * v2) - v0 * (u1 * u4 - u3 * u2) + u2 * (u1 * v2 - v1 * u2)) / det, 6) AS b, round((n * (u2 * v2 - v1 * u3) - u1 * (u1 * v2 - v1 * u2) + v0 * (u1 * u3 - u2 * u2)) / det, 6) AS c FROM t",
    "results",
)
def quadratic_fit(spark, d):
    return R.quadratic_fit(fx.results(spark, d), "cost", "latency")


@query("SELECT graph, CASE technique WHEN 'F-BUILDING' THEN 'finished building' ELSE technique END AS technique FROM r", "results")
def label_rename(spark, d):
    return R.relabelled(fx.results(spark, d), {"F-BUILDING": "finished building"}).select("graph", "technique")


@query(_HE + ", z AS (SELECT min(log10(weight)) lo, max(log10(weight)) hi FROM hh) SELECT least(19, floor((log10(weight) - lo) * 20 / (hi - lo)))::BIGINT AS bin, sum(n)::BIGINT AS n FROM hh, z GROUP BY 1", "basket")
def log_histogram(spark, d):
    return R.histogram(fx.basket(spark, d).hyperedges(), "weight", "n_dst", 20, logarithmic=True)


# ---- what must hold


def _holds(name: str):
    def partitioning(spark, d):
        from .pipeline import partitioned

        g = fx.basket(spark, d)
        hw = fx.hardware(g)
        a = settled(partitioned(g, hw, name))
        return scores.partition_validity(g, a, hw).crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("node").alias("nodes")))).select("rows", "nodes", "valid")

    partitioning.__name__ = f"valid_partition_{name}"
    query("SELECT count(*) AS rows, count(*) AS nodes, true AS valid FROM nodes", "basket")(partitioning)


for _name in ("greedy", "edge_hiding", "hyperedge_hiding", "multistart"):
    _holds(_name)


def _placed(name: str):
    def placement(spark, d):
        g, _, hw, a = _contracted(spark, d)
        p = settled(place.hilbert(g, hw) if name == "hilbert" else place.place(g, hw, name))
        return scores.placement_validity(a, p, hw)

    placement.__name__ = f"valid_placement_{name}"
    query("SELECT count(DISTINCT part) AS n_parts, count(DISTINCT part) AS n_placed, 0 AS out_of_bounds, 0 AS taken_twice, true AS valid FROM assign", "basket", "assign")(placement)


for _name in ("hilbert", "spectral", "force_directed", "min_distance"):
    _placed(_name)


@query("SELECT count(DISTINCT part) AS parts, count(DISTINCT part) AS numbers, 0 AS least, count(DISTINCT part) - 1 AS greatest FROM assign", "basket", "assign")
def valid_feed_forward_order(spark, d):
    found = order.feed_forward_order(_contracted(spark, d)[0])
    return found.agg(F.count_distinct("node").alias("parts"), F.count_distinct("new").alias("numbers"), F.min("new").alias("least"), F.max("new").alias("greatest"))


@query("SELECT false AS has_cycle")
def valid_acyclic_part(spark, d):
    g = _contracted(spark, d)[0]
    g = Hypergraph(g.nodes, settled(g.pins))
    kept = settled(order.acyclic_part(g)).where("kept").select("he_id")
    return order.has_cycle(Hypergraph(g.nodes, g.pins.join(kept, "he_id", "left_semi")))


@query("SELECT true AS sorted")
def valid_order_without_cycles(spark, d):
    """Without the arcs that are left out, no arc leads to a smaller number."""
    g = _contracted(spark, d)[0]
    arcs = g.pins.groupBy("source", "dst").agg(F.sum("weight").alias("weight")).select(F.col("source").alias("he_id"), "source", "dst", "weight")
    g = Hypergraph(g.nodes, settled(arcs))  # each arc once, those of a source as one hyperedge
    gone = settled(order.broken_cycles(g)).select("source", "dst")
    rest = Hypergraph(g.nodes, settled(g.pins.join(gone, ["source", "dst"], "left_anti").select(*g.pins.columns)))
    from ..operators.transform import relabel

    return stats.topologically_sorted(relabel(rest, settled(order.topological_order(rest))))


@query("SELECT true AS part_valid, true AS placement_valid, 'sequential-feed_forward-hilbert' AS name")
def valid_pipeline_ordered(spark, d):
    from .pipeline import REGISTRY, run

    g = fx.basket(spark, d)
    return run(g, fx.hardware(g), REGISTRY["sequential-feed_forward-hilbert"]).select("part_valid", "placement_valid", "name")


@query("+c AS (SELECT count(DISTINCT part) n FROM assign) SELECT n AS n_parts, true AS part_valid, true AS placement_valid FROM c", "basket", "assign")
def valid_placement_only(spark, d):
    """A given partitioning is placed and scored."""
    from .pipeline import Pipeline, placed

    g = fx.basket(spark, d)
    return placed(g, fx.hardware(g), fx.assigned(g), Pipeline("given", "hilbert")).select("n_parts", "part_valid", "placement_valid")
