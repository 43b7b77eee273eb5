"""Queries over the fixtures, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import results as R
from ..operators import scores, similarity, stats, transform, traversal
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Registers a query; its SQL comes after the fixtures that it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "UNION" in sql and "-- recursive" in sql else ""
            ORACLES[f.__name__] = (f"WITH {recursive}{', '.join(fx.SQL[n] for n in needs)}{', ' if sql.startswith('+') else ' '}" if needs else "") + sql.lstrip("+").replace("-- recursive", "")
        return f

    return add


# ---- transforms


@query("SELECT source AS src, dst, weight FROM pins", "basket")
def hg_to_graph(spark, d):
    return transform.to_graph(fx.basket(spark, d))


@query("SELECT source AS src, dst, sum(weight) AS weight FROM pins GROUP BY 1, 2", "basket")
def hg_to_graph_collapsed(spark, d):
    return transform.to_graph(fx.basket(spark, d), collapse=True)


@query("SELECT least(source, dst) AS a, greatest(source, dst) AS b, sum(weight) AS weight FROM pins GROUP BY 1, 2", "basket")
def hg_undirected(spark, d):
    return transform.undirected(fx.basket(spark, d))


_ENDS = "+e AS (SELECT p.*, a.part dp, b.part sp FROM pins p JOIN assign a ON a.node = p.dst JOIN assign b ON b.node = p.source)"
_CONTRACT = "c AS (SELECT he_id, sp AS source, array_to_string(list_sort(list(DISTINCT dp)), ',') AS dsts, any_value(weight) AS weight FROM e {} GROUP BY he_id, sp)"


def _joined(hyperedges: DataFrame) -> DataFrame:
    return hyperedges.withColumn("dsts", F.array_join(F.col("dsts").cast("array<string>"), ","))


@query(_ENDS + ", " + _CONTRACT.format("WHERE sp <> dp") + " SELECT * FROM c", "basket", "assign")
def contract(spark, d):
    g = fx.basket(spark, d)
    return _joined(transform.contract(g, fx.assigned(g)))


@query(_ENDS + ", " + _CONTRACT.format("") + " SELECT * FROM c", "basket", "assign")
def contract_keep_self(spark, d):
    g = fx.basket(spark, d)
    return _joined(transform.contract(g, fx.assigned(g), keep_self=True))


@query(_ENDS + ", " + _CONTRACT.format("WHERE sp <> dp") + " SELECT min(he_id) AS he_id, source, dsts, sum(weight) AS weight FROM c GROUP BY source, dsts", "basket", "assign")
def contract_squish(spark, d):
    g = fx.basket(spark, d)
    return _joined(transform.contract(g, fx.assigned(g), squish_equal=True))


@query("+c AS (SELECT he_id, source, array_to_string(list_sort(list(DISTINCT dst)), ',') AS dsts, any_value(weight) AS weight FROM pins GROUP BY he_id, source) SELECT min(he_id) AS he_id, source, dsts, sum(weight) AS weight FROM c GROUP BY source, dsts", "basket")
def squish(spark, d):
    return _joined(transform.squish(fx.basket(spark, d)))


@query("SELECT he_id, (SELECT max(node) FROM nodes) - source AS source, (SELECT max(node) FROM nodes) - dst AS dst, weight FROM pins", "basket")
def relabel(spark, d):
    g = fx.basket(spark, d)
    top = g.nodes.agg(F.max("node").alias("top"))
    return transform.relabel(g, g.nodes.crossJoin(F.broadcast(top)).select("node", (F.col("top") - F.col("node")).alias("new"))).pins


@query(
    "+hh AS (SELECT he_id, any_value(weight) weight, count(*) n FROM pins GROUP BY he_id), t AS (SELECT floor(sum(n) * 0.37)::BIGINT target FROM hh), b AS (SELECT he_id, n, coalesce(sum(n) OVER (ORDER BY weight, he_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hh) SELECT he_id, greatest(0, least(n, target - before))::BIGINT AS removed, (n - greatest(0, least(n, target - before)))::BIGINT AS kept FROM b, t",
    "basket",
)
def remove_edge_fraction(spark, d):
    return transform.remove_connections(fx.basket(spark, d), 0.37)


@query(
    "+hh AS (SELECT he_id, any_value(weight) weight, count(*) n FROM pins GROUP BY he_id), t AS (SELECT sum(weight * n) * 0.25 target FROM hh), b AS (SELECT he_id, n, weight, coalesce(sum(n * weight) OVER (ORDER BY weight, he_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hh), g AS (SELECT he_id, n, CASE WHEN target <= before THEN 0 ELSE least(n, floor((target - before) / weight)) END::BIGINT gone FROM b, t) SELECT he_id, gone AS removed, (n - gone)::BIGINT AS kept FROM g",
    "basket",
)
def remove_weight_fraction(spark, d):
    return transform.remove_weight(fx.basket(spark, d), 0.25)


@query("SELECT he_id, source, dst, weight FROM pins UNION ALL SELECT -1 - node, node, (SELECT max(node) + 1 FROM nodes), 1.0 FROM nodes WHERE node < 10", "basket")
def add_hyperedges(spark, d):
    g = fx.basket(spark, d)
    top = g.nodes.agg(F.max("node").alias("top"))
    more = g.nodes.where("node < 10").crossJoin(F.broadcast(top)).select((-1 - F.col("node")).alias("he_id"), F.col("node").alias("source"), (F.col("top") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return transform.add_hyperedges(g, more, add_missing=True).pins


# ---- degrees and statistics

_DEGREES = "+o AS (SELECT source node, count(DISTINCT he_id) c FROM pins GROUP BY 1), i AS (SELECT dst node, count(*) c FROM pins GROUP BY 1), deg AS (SELECT n.node, coalesce(o.c, 0) n_out, coalesce(i.c, 0) n_in, coalesce(o.c, 0) + coalesce(i.c, 0) n_touch FROM nodes n LEFT JOIN o ON o.node = n.node LEFT JOIN i ON i.node = n.node)"


@query(_DEGREES + " SELECT * FROM deg", "basket")
def degree_in_out_touch(spark, d):
    return stats.degrees(fx.basket(spark, d))


@query(
    "+hh AS (SELECT he_id, any_value(weight) weight, count(*) n FROM pins GROUP BY he_id), a AS (SELECT count(*) e, sum(n + 1)::BIGINT p, sum(n)::BIGINT c, sum(weight * n) f, sum(weight) w FROM hh), b AS (SELECT count(*) k FROM nodes) SELECT k AS nodes_count, e AS hedges_count, p AS edges_count, f AS total_frequency, round(p / e, 6) AS nodes_per_hedge_mean, round(p / k, 6) AS hedges_per_node_mean, round(e / k, 6) AS outbound_mean, round(c / k, 6) AS inbound_mean, round(w / e, 6) AS frequency_mean FROM a, b",
    "basket",
)
def graph_statistics(spark, d):
    return stats.statistics(fx.basket(spark, d))


@query("+m AS (SELECT he_id, dst node FROM pins UNION SELECT he_id, source FROM pins), c AS (SELECT count(*) c FROM m GROUP BY node), e AS (SELECT count(DISTINCT he_id) e FROM pins) SELECT round(sum(c * (c - 1) / 2) / (any_value(e) * (any_value(e) - 1) / 2), 6) AS overlap FROM c, e", "basket")
def hyperedge_overlap(spark, d):
    return stats.overlap(fx.basket(spark, d))


_CLUSTER = "+o AS (SELECT DISTINCT source, dst FROM pins WHERE source <> dst), g AS (SELECT DISTINCT least(source, dst) a, greatest(source, dst) b FROM o), p AS (SELECT x.source node, x.dst a, y.dst b FROM o x JOIN o y ON x.source = y.source AND x.dst < y.dst), c AS (SELECT p.node, count(*) pairs, count(g.a) closed FROM p LEFT JOIN g ON g.a = p.a AND g.b = p.b GROUP BY 1)"


@query(_CLUSTER + " SELECT n.node, coalesce(pairs, 0) AS pairs, coalesce(closed, 0) AS closed, coalesce(round(closed / pairs, 6), 0) AS coefficient FROM nodes n LEFT JOIN c ON c.node = n.node", "basket")
def clustering_exact(spark, d):
    return stats.clustering(fx.basket(spark, d))


@query()
def clustering_sampled(spark, d):
    return stats.clustering(fx.basket(spark, d), sample=100, seed=192)


@query(_DEGREES + " SELECT * FROM deg ORDER BY n_touch DESC, node LIMIT 5", "basket")
def topk_degree(spark, d):
    return stats.top_degrees(fx.basket(spark, d))


@query(_DEGREES + " SELECT node FROM deg WHERE n_touch = 0", "basket")
def isolated_nodes(spark, d):
    return stats.isolated(fx.basket(spark, d))


@query("SELECT bool_and(dst >= source) AS sorted FROM pins", "dag")
def is_topologically_sorted(spark, d):
    return stats.topologically_sorted(fx.basket(spark, d, acyclic=True))


# ---- traversal


@query("+e AS (SELECT DISTINCT source, dst FROM pins), w(node, level) AS (SELECT node, 0 FROM nodes WHERE node = 0 UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.source = w.node WHERE w.level < 4) -- recursive\n SELECT 0::BIGINT AS start, node, min(level) AS level FROM w GROUP BY node", "basket")
def bfs_levels(spark, d):
    g = fx.basket(spark, d)
    return traversal.bfs_levels(g, g.nodes.where("node = 0"))


@query()
def avg_path_length(spark, d):
    g = fx.basket(spark, d)
    return traversal.average_path_length(g, traversal.sampled(g, 5, 192))


@query("+e AS (SELECT DISTINCT source, dst FROM pins), w(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.source = w.node) -- recursive\n SELECT node, max(level) AS level FROM w GROUP BY node", "dag")
def topo_levels(spark, d):
    return traversal.topological_levels(fx.basket(spark, d, acyclic=True))


@query("SELECT min(dst - source) < 0 AS has_cycle FROM pins", "dag")
def has_cycle(spark, d):
    return traversal.has_cycle(fx.basket(spark, d, acyclic=True))


@query("+e AS (SELECT DISTINCT source a, dst b FROM pins UNION SELECT DISTINCT dst, source FROM pins), w(root, node) AS (SELECT node, node FROM nodes WHERE node < 3 UNION SELECT w.root, e.b FROM w JOIN e ON e.a = w.node) -- recursive\n SELECT node, min(root) AS component FROM w GROUP BY node UNION ALL SELECT node, node FROM nodes WHERE node NOT IN (SELECT node FROM w)", "axon")
def components(spark, d):
    return traversal.components(fx.axon(spark, d))


@query()
def scc(spark, d):
    return traversal.strong_components(fx.basket(spark, d))


# ---- scores of partitionings


@query(_ENDS + ", q AS (SELECT DISTINCT he_id, dp, weight FROM e WHERE sp <> dp) SELECT count(*) AS cut_pins, coalesce(sum(weight), 0) AS connectivity FROM q", "basket", "assign")
def connectivity(spark, d):
    g = fx.basket(spark, d)
    return scores.connectivity(g, fx.assigned(g))


@query(_ENDS + ", q AS (SELECT he_id, bool_or(sp <> dp) cut, any_value(weight) weight FROM e GROUP BY 1) SELECT coalesce(sum(weight) FILTER (WHERE cut), 0) AS cut_weight, count(*) FILTER (WHERE cut) AS cut_hedges FROM q", "basket", "assign")
def plain_cut(spark, d):
    g = fx.basket(spark, d)
    return scores.plain_cut(g, fx.assigned(g))


@query(_ENDS + ", q AS (SELECT DISTINCT he_id, dp, weight FROM e) SELECT sum(weight) AS swap_cost FROM q", "basket", "assign")
def swap_cost(spark, d):
    g = fx.basket(spark, d)
    return scores.swap_cost(g, fx.assigned(g))


_LOADS = _ENDS + ", n AS (SELECT part, count(*) n_nodes FROM assign GROUP BY 1), l AS (SELECT dp part, count(DISTINCT he_id) n_axons, count(*) n_synapses FROM e GROUP BY 1), loads AS (SELECT n.part, n_nodes, coalesce(n_axons, 0) n_axons, coalesce(n_synapses, 0) n_synapses FROM n LEFT JOIN l ON l.part = n.part)"


@query(_LOADS + " SELECT * FROM loads", "basket", "assign")
def part_loads(spark, d):
    g = fx.basket(spark, d)
    return scores.part_loads(g, fx.assigned(g))


@query(
    _LOADS + ", v AS (SELECT count(*) n_parts, count(*) FILTER (WHERE n_nodes > 64) over_nodes, count(*) FILTER (WHERE n_axons > 2048) over_axons, count(*) FILTER (WHERE n_synapses > 2048) over_synapses, min(part) = 0 AND max(part) = count(*) - 1 AS contiguous FROM loads) SELECT v.*, contiguous AND n_parts <= w * w AND over_nodes + over_axons + over_synapses = 0 AS valid FROM v, side",
    "basket", "assign", "place",
)
def partition_validity(spark, d):
    g = fx.basket(spark, d)
    return scores.partition_validity(g, fx.assigned(g), fx.hardware(g))


@query("+i AS (SELECT count(*) c FROM pins GROUP BY dst) SELECT (SELECT count(*) FROM nodes) <= any_value(w) * any_value(w) * 64 AS nodes_fit, max(c) <= 2048 AS axons_fit, sum(c) <= any_value(w) * any_value(w) * 2048 AS synapses_fit, max(c) <= 2048 AS node_synapses_fit FROM i, side", "basket", "assign", "place")
def snn_fit_checks(spark, d):
    g = fx.basket(spark, d)
    return scores.fit_checks(g, fx.hardware(g))


@query(_LOADS + ", r AS (SELECT CASE WHEN n_axons > 0 THEN n_synapses / n_axons ELSE 0 END r FROM loads) SELECT round(avg(r), 6) AS ar_mean, round(exp(sum(CASE WHEN r > 0 THEN ln(r) ELSE 0 END) / count(*)), 6) AS geo_mean FROM r", "basket", "assign")
def synaptic_reuse(spark, d):
    g = fx.basket(spark, d)
    return scores.synaptic_reuse(g, fx.assigned(g))


@query("SELECT x.dst AS u, y.dst AS v, sum(x.weight) AS weight FROM pins x JOIN pins y ON x.he_id = y.he_id AND x.dst < y.dst GROUP BY 1, 2", "basket")
def pair_weights(spark, d):
    return scores.pair_weights(fx.basket(spark, d))


@query("+m AS (SELECT he_id, dst node, weight FROM pins UNION SELECT he_id, source, weight FROM pins) SELECT x.node AS u, y.node AS v, sum(x.weight) AS weight FROM m x JOIN m y ON x.he_id = y.he_id AND x.node < y.node GROUP BY 1, 2", "basket")
def neighbor_weights(spark, d):
    return scores.neighbor_weights(fx.basket(spark, d))


# ---- scores of placements

_ROUTES = _ENDS + ", q AS (SELECT DISTINCT he_id, sp source, dp dst, weight FROM e WHERE sp <> dp), r AS (SELECT q.*, a.x sx, a.y sy, b.x dx, b.y dy, abs(a.x - b.x) + abs(a.y - b.y) d FROM q JOIN place a ON a.part = q.source JOIN place b ON b.part = q.dst)"
_DELAY = "((d + 1) * 2.1::DOUBLE + d * 5.3::DOUBLE)"
_METRICS = {
    "energy": "round(sum(weight * ((d + 1) * 1.7::DOUBLE + d * 3.5::DOUBLE)), 3)", "avg_latency": f"round(sum(weight * {_DELAY}) / sum(weight), 6)",
    "max_latency": f"round(max({_DELAY}), 6)", "avg_congestion": "round(sum(weight * (d + 1)) / (SELECT w * w FROM side), 6)",
}


def _contracted(spark, d):
    g = fx.basket(spark, d)
    a, hw = fx.assigned(g), fx.hardware(g)
    return transform.contracted(g, a), fx.placed(a, hw.width), hw, a


def _metric(name):
    def run(spark, d):
        g, p, hw, _ = _contracted(spark, d)
        return scores.metrics(g, p, hw, [name])

    run.__name__ = name
    query(f"{_ROUTES} SELECT {_METRICS[name]} AS {name} FROM r", "basket", "assign", "place")(run)


for _name in _METRICS:
    _metric(_name)


@query(f"{_ROUTES} SELECT {', '.join(f'{v} AS {k}' for k, v in _METRICS.items())} FROM r", "basket", "assign", "place")
def all_metrics(spark, d):
    g, p, hw, _ = _contracted(spark, d)
    return scores.metrics(g, p, hw, list(_METRICS))


@query(f"{_ROUTES} SELECT round({_METRICS['energy']} * {_METRICS['avg_latency']}, 0) AS compound FROM r", "basket", "assign", "place")
def compound_metric(spark, d):
    g, p, hw, _ = _contracted(spark, d)
    return scores.compound(g, p, hw)


_LOAD = (
    _ROUTES + ", z AS (SELECT sx, sy, dx, dy, abs(dx - sx) ex, abs(dy - sy) ey, sum(weight) weight FROM r GROUP BY ALL), k AS (SELECT z.*, unnest(range(ex + 1)) i FROM z), kk AS (SELECT k.*, unnest(range(ey + 1)) j FROM k), "
    "edge AS (SELECT a, b, sum(exp(lgamma(a + t) - lgamma(a) - lgamma(t + 1) - (a + t) * ln(2))) OVER (PARTITION BY a ORDER BY b) pr FROM (SELECT a, b, b AS t FROM (SELECT unnest(range(1, 20)) a), (SELECT unnest(range(0, 20)) b))), "
    "load AS (SELECT sx + sign(dx - sx) * i AS x, sy + sign(dy - sy) * j AS y, sum(weight * CASE WHEN ex = 0 OR ey = 0 OR (i = ex AND j = ey) THEN 1 WHEN i < ex AND j < ey THEN exp(lgamma(i + j + 1) - lgamma(i + 1) - lgamma(j + 1) - (i + j) * ln(2)) WHEN i = ex THEN u.pr ELSE v.pr END) AS load "
    "FROM kk LEFT JOIN edge u ON u.a = ex AND u.b = j LEFT JOIN edge v ON v.a = ey AND v.b = i GROUP BY 1, 2)"
)


@query(_LOAD + " SELECT x::BIGINT AS x, y::BIGINT AS y, round(load, 3) AS load FROM load", "basket", "assign", "place")
def congestion_matrix(spark, d):
    g, p, hw, _ = _contracted(spark, d)
    return scores.congestion(g, p, hw).withColumn("load", F.round("load", 3))


@query(_LOAD + " SELECT round(max(load), 3) AS max_congestion FROM load", "basket", "assign", "place")
def max_congestion(spark, d):
    g, p, hw, _ = _contracted(spark, d)
    return scores.congestion(g, p, hw).agg(F.round(F.max("load"), 3).alias("max_congestion"))


@query("+v AS (SELECT (SELECT count(DISTINCT part) FROM assign) n_parts, count(DISTINCT part) n_placed, count(*) FILTER (WHERE x < 0 OR y < 0 OR x >= w OR y >= w) out_of_bounds, count(*) - count(DISTINCT (x, y)) taken_twice FROM place, side) SELECT *, n_parts = n_placed AND out_of_bounds = 0 AND taken_twice = 0 AS valid FROM v", "basket", "assign", "place")
def placement_validity(spark, d):
    _, p, hw, a = _contracted(spark, d)
    return scores.placement_validity(a, p, hw)


_HULL = (
    _ROUTES + ", m AS (SELECT he_id, sx x, sy y, weight FROM r UNION SELECT he_id, dx, dy, weight FROM r), g AS (SELECT he_id, any_value(weight) weight, string_agg(x || ':' || y, ',' ORDER BY x, y) k FROM m GROUP BY 1), u AS (SELECT k, min(he_id) he_id, count(*) n, sum(weight) w FROM g GROUP BY 1), "
    "pt AS (SELECT u.k, m.x, m.y FROM u JOIN m ON m.he_id = u.he_id), pr AS (SELECT a.k, a.x ax, a.y ay, b.x bx, b.y \"by\" FROM pt a JOIN pt b ON a.k = b.k AND (a.x, a.y) <> (b.x, b.y)), "
    "he AS (SELECT k, ax, ay, bx, \"by\" FROM pr WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.k = pr.k AND (bx - ax) * (c.y - ay) - (\"by\" - ay) * (c.x - ax) < 0)), bb AS (SELECT k, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pt GROUP BY 1), "
    "c1 AS (SELECT bb.*, unnest(range(x0, x1 + 1)) cx FROM bb), c2 AS (SELECT c1.*, unnest(range(y0, y1 + 1)) cy FROM c1), ok AS (SELECT k, count(*) c FROM c2 WHERE NOT EXISTS (SELECT 1 FROM he WHERE he.k = c2.k AND (bx - ax) * (cy - ay) - (\"by\" - ay) * (cx - ax) < 0) GROUP BY 1), f AS (SELECT n, w, c FROM ok JOIN u ON u.k = ok.k)"
)


@query(_HULL + " SELECT round(sum(n * c) / sum(n), 6) AS ar_mean, round(exp(sum(n * ln(c)) / sum(n)), 6) AS geo_mean, round(sum(w * c) / sum(w), 6) AS ar_mean_weighted, round(exp(sum(w * ln(c)) / sum(w)), 6) AS geo_mean_weighted FROM f", "basket", "assign", "place")
def connections_locality(spark, d):
    g, p, hw, _ = _contracted(spark, d)
    return scores.locality(g, p, hw)


@query(
    _ROUTES + ", o AS (SELECT dst part, dx - sx ox, dy - sy oy, weight FROM r UNION ALL SELECT source, sx - dx, sy - dy, weight FROM r), mv AS (SELECT * FROM (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) t(mx, my)), f AS (SELECT part, mx, my, sum(weight * (greatest(abs(ox) + abs(oy), 1) - greatest(abs(ox + mx) + abs(oy + my), 1))) force FROM o, mv GROUP BY 1, 2, 3) SELECT place.part, mv.mx, mv.my, coalesce(f.force, 0) AS force FROM place CROSS JOIN mv LEFT JOIN f ON f.part = place.part AND f.mx = mv.mx AND f.my = mv.my",
    "basket", "assign", "place",
)
def forces(spark, d):
    g, p, _, _ = _contracted(spark, d)
    return scores.forces(g, p)


@query("SELECT y, string_agg(x::VARCHAR, ',' ORDER BY x) AS xs FROM place GROUP BY y", "basket", "assign", "place")
def active_cores(spark, d):
    _, p, _, _ = _contracted(spark, d)
    return scores.active_cores(p)


# ---- similarity

_SETS = "+ws AS (SELECT dst set_id, source elem, sum(weight) w FROM pins GROUP BY 1, 2), tt AS (SELECT set_id, sum(w) t FROM ws GROUP BY 1), jj AS (SELECT x.set_id a, y.set_id b, sum(x.w + y.w) s FROM ws x JOIN ws y ON x.elem = y.elem AND x.set_id < y.set_id GROUP BY 1, 2), ja AS (SELECT a, b, round(s / (p.t + q.t), 9) similarity FROM jj JOIN tt p ON p.set_id = a JOIN tt q ON q.set_id = b)"


@query(_SETS + " SELECT * FROM ja", "basket")
def weighted_jaccard(spark, d):
    return similarity.weighted_jaccard(fx.weighted_sets(fx.basket(spark, d)))


@query(_SETS + ", bo AS (SELECT a set_id, b other, similarity FROM ja UNION ALL SELECT b, a, similarity FROM ja), rk AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY similarity DESC, other DESC) AS rank FROM bo) SELECT * FROM rk WHERE rank <= 3", "basket")
def jaccard_topk_exact(spark, d):
    return similarity.top_similar(similarity.weighted_jaccard(fx.weighted_sets(fx.basket(spark, d))), 3)


@query()
def minhash_bands(spark, d):
    return similarity.banded(similarity.signatures(fx.weighted_sets(fx.basket(spark, d)), 16), 2)


@query()
def lsh_topk(spark, d):
    sets = fx.weighted_sets(fx.basket(spark, d))
    return similarity.top_similar(similarity.weighted_jaccard(sets, similarity.candidates(similarity.signatures(sets, 64), 2)), 3)


@query("+ws AS (SELECT dst set_id, source elem, sum(weight) w FROM pins GROUP BY 1, 2) SELECT floor(set_id / 16)::BIGINT AS set_id, elem, max(w) AS w FROM ws GROUP BY 1, 2", "basket")
def merge_sets(spark, d):
    sets = fx.weighted_sets(fx.basket(spark, d))
    return similarity.merged_sets(sets, sets.select("set_id", F.floor(F.col("set_id") / 16).alias("group")).distinct(), "max")


# ---- experiment records

_RESULT_METRICS = ["energy", "latency", "cost"]


@query(f"SELECT graph, technique, {', '.join(f'round({m} / min({m}) OVER (PARTITION BY graph), 6) AS {m}' for m in _RESULT_METRICS)} FROM r", "results")
def normalize_by_best(spark, d):
    return R.normalised(fx.results(spark, d), _RESULT_METRICS)


@query(
    f"+n AS (SELECT graph, technique, {', '.join(f'{m} / min({m}) OVER (PARTITION BY graph) AS {m}' for m in _RESULT_METRICS)} FROM r), a AS (SELECT technique, {', '.join(f'avg({m}) AS {m}' for m in _RESULT_METRICS)} FROM n GROUP BY 1) SELECT technique, {', '.join(f'round({m} / min({m}) OVER (), 6) AS {m}' for m in _RESULT_METRICS)} FROM a",
    "results",
)
def technique_averages(spark, d):
    return R.technique_averages(fx.results(spark, d), _RESULT_METRICS)


@query("SELECT graph, technique, round(energy * latency / 1e6, 3) AS elp FROM r", "results")
def elp(spark, d):
    return R.with_elp(fx.results(spark, d)).select("graph", "technique", F.round(F.col("elp") / 1e6, 3).alias("elp"))


@query("+k AS (SELECT graph, split_part(technique, '-', 1) partitioner, technique, row_number() OVER (PARTITION BY graph, split_part(technique, '-', 1) ORDER BY energy * latency, technique) k FROM r) SELECT graph, partitioner, technique FROM k WHERE k = 1", "results")
def best_placement_per_partitioner(spark, d):
    return R.best_placements(fx.results(spark, d))


@query("+l AS (SELECT x.technique FROM r x JOIN r y ON x.graph = y.graph AND x.technique <> y.technique AND split_part(x.technique, '-', 1) = split_part(y.technique, '-', 1) GROUP BY x.technique, y.technique HAVING bool_and(y.energy * y.latency < x.energy * x.latency)) SELECT DISTINCT technique FROM r WHERE technique NOT IN (SELECT technique FROM l)", "results")
def dominance_filter(spark, d):
    return R.undominated(R.with_elp(fx.results(spark, d)))


@query(
    "+z AS (SELECT graph, technique, round((log10(energy) - avg(log10(energy)) OVER g) / stddev_pop(log10(energy)) OVER g, 9) x, round((log10(latency) - avg(log10(latency)) OVER g) / stddev_pop(log10(latency)) OVER g, 9) y FROM r WINDOW g AS (PARTITION BY graph)), k AS (SELECT technique, rank() OVER (PARTITION BY technique ORDER BY x) + (count(*) OVER (PARTITION BY technique, x) - 1) / 2 rx, rank() OVER (PARTITION BY technique ORDER BY y) + (count(*) OVER (PARTITION BY technique, y) - 1) / 2 ry FROM z) SELECT technique, round(corr(rx, ry), 6) + 0.0 AS spearman FROM k GROUP BY 1",
    "results",
)
def zscore_spearman(spark, d):
    return R.spearman(R.zscores(fx.results(spark, d), ["energy", "latency"]), "energy", "latency")


@query("SELECT round(regr_slope(log10(energy), log10(cost)), 6) AS slope, round(regr_intercept(log10(energy), log10(cost)), 6) AS intercept, round(corr(log10(cost), log10(energy)), 6) AS pearson, count(*) AS n FROM r", "results")
def loglog_fit(spark, d):
    return R.loglog_fit(fx.results(spark, d), "cost", "energy")


@query()
def huber_fit(spark, d):
    slope, intercept = R.huber_fit(fx.results(spark, d), "cost", "energy")
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


@query("+q AS (SELECT abs(latency * cost - energy * 0.9) / (energy * 0.9) * 100 e FROM r) SELECT round(avg(e), 6) AS mean_error, round(min(e), 6) AS min_error, round(max(e), 6) AS max_error, round(median(e), 6) AS median_error FROM q", "results")
def validation_error(spark, d):
    return R.validation_error(fx.results(spark, d).selectExpr("latency * cost AS m", "energy * 0.9D AS s"), "m", "s")


@query("+q AS (SELECT arg_min(technique, (energy, technique)) = arg_min(technique, (latency, technique)) same FROM r GROUP BY graph) SELECT count(*) FILTER (WHERE same) AS same_best, count(*) AS graphs FROM q", "results")
def same_best(spark, d):
    return R.same_best(fx.results(spark, d), "energy", "latency")


@query("SELECT graph, technique, round((energy - latency) / energy * 100, 6) AS reduction FROM r", "results")
def init_reduction(spark, d):
    return R.init_reduction(fx.results(spark, d), "energy", "latency")


@query("+q AS (SELECT *, avg(latency) OVER g a, stddev_pop(latency) OVER g s, count(latency) OVER g c FROM r WINDOW g AS (PARTITION BY graph)) SELECT graph, technique, round(latency, 4) AS latency FROM q WHERE c = 1 OR abs(latency - a) <= 0.5 * s", "results")
def outlier_band(spark, d):
    return R.within_band(fx.results(spark, d), "latency").select("graph", "technique", F.round("latency", 4).alias("latency"))


_HE = "+hh AS (SELECT he_id, any_value(weight) weight, count(*) n FROM pins GROUP BY he_id)"


@query(_HE + ", z AS (SELECT min(weight) lo, max(weight) hi FROM hh) SELECT least(49, floor((weight - lo) * 50 / (hi - lo)))::BIGINT AS bin, sum(n)::BIGINT AS n FROM hh, z GROUP BY 1", "basket")
def histogram(spark, d):
    return R.histogram(fx.basket(spark, d).hyperedges(), "weight", "n_dst", 50)


@query(_HE + ", m AS (SELECT sum(ln(weight) * n) / sum(n) m, sum(ln(weight) * ln(weight) * n) / sum(n) q FROM hh) SELECT round(sqrt(q - m * m), 6) AS shape, round(exp(m), 6) AS scale, round(sqrt(exp(q - m * m) - 1), 6) AS cv FROM m", "basket")
def lognormal_fit(spark, d):
    return R.lognormal_fit(fx.basket(spark, d).hyperedges(), "weight", "n_dst")


@query(_HE + ", x AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS i, sum(1) OVER () AS c FROM hh, unnest(range(n))) SELECT floor(any_value(c) * 0.3)::BIGINT AS cut_count, min(weight) FILTER (WHERE i = floor(c * 0.3)) AS cut_value, sum(weight) FILTER (WHERE i < floor(c * 0.3)) AS cut_total, sum(weight) AS total FROM x", "basket")
def cutoff_fraction(spark, d):
    return R.cutoff(fx.basket(spark, d).hyperedges(), "weight", "n_dst", 0.3)


# ---- spikes


@query("+t AS (SELECT quantile_cont(ts, 0.05) lo, quantile_cont(ts, 0.95) hi FROM spikes), u AS (SELECT min(ts) a, max(ts) b FROM spikes, t WHERE ts >= lo AND ts <= hi) SELECT node, round(count(*) / (any_value(b) - any_value(a)), 9) AS rate FROM spikes, u GROUP BY node", "spikes")
def spike_rate_p5_p95(spark, d):
    return scalar.spike_rates(fx.spikes(spark, d))


@query("+q AS (SELECT event_type layer, user_id::BIGINT neuron, day(ts) batch, value v FROM events), b AS (SELECT layer, count(DISTINCT batch) n FROM q GROUP BY 1) SELECT q.layer, neuron, round(sum(v) / any_value(n), 6) AS rate FROM q JOIN b ON b.layer = q.layer GROUP BY 1, 2", "spikes")
def mean_batch_rate(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("layer"), F.col("user_id").cast("long").alias("neuron"), F.dayofmonth("ts").alias("batch"), F.col("value").cast("double").alias("v"))
    return scalar.batch_rates(e)


# ---- scalars, arrays and scans


@query("SELECT p_partkey AS k, abs(p_partkey % 17 - 3) + abs(p_partkey % 5 - 4) AS d FROM part")
def manhattan(spark, d):
    p = fx.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), scalar.manhattan(F.array(F.col("p_partkey") % 17, F.col("p_partkey") % 5), F.array(F.lit(3), F.lit(4))).cast("long").alias("d"))


@query("+x AS (SELECT he_id, source, dense_rank() OVER (ORDER BY source) - 1 AS new FROM (SELECT DISTINCT he_id, source FROM pins)) SELECT * FROM x", "basket")
def dense_reindex(spark, d):
    h = fx.basket(spark, d).hyperedges().select("he_id", "source")
    return scalar.dense(h, "source", "new")


@query("SELECT l_orderkey::BIGINT AS k, array_to_string(list_distinct_sorted, ',') AS parts FROM (SELECT l_orderkey, list(l_partkey ORDER BY m, l_partkey) list_distinct_sorted FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) m FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def dedupe_preserve_order(spark, d):
    line = fx.table(spark, d, "lineitem")
    return scalar.first_seen(line, "l_orderkey", "l_partkey", "l_linenumber").select(F.col("l_orderkey").cast("long").alias("k"), F.array_join(F.col("items").cast("array<string>"), ",").alias("parts"))


@query("+hh AS (SELECT he_id, any_value(weight) weight FROM pins GROUP BY 1) SELECT he_id, coalesce(sum(weight) OVER (ORDER BY he_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hh", "basket")
def running_fold(spark, d):
    h = fx.basket(spark, d).hyperedges()
    return transform.running(h, "weight", ["he_id"], "before").select("he_id", F.col("before").cast("double").alias("before"))


@query("SELECT k, sum(v) AS v FROM (SELECT source k, weight v FROM pins UNION ALL SELECT dst, 1 FROM pins) GROUP BY k", "basket")
def dict_sum(spark, d):
    p = fx.basket(spark, d).pins
    return scalar.dict_sum(p.select(F.col("source").alias("k"), F.col("weight").alias("v")), p.select(F.col("dst").alias("k"), F.lit(1.0).alias("v")))


@query("SELECT source AS k, count(DISTINCT dst) AS n FROM pins GROUP BY 1", "basket")
def length_of_union(spark, d):
    lists = fx.basket(spark, d).listed()
    return lists.groupBy(F.col("source").alias("k")).agg(F.size(F.array_distinct(F.flatten(F.collect_list("dsts")))).cast("long").alias("n"))


@query("SELECT x::BIGINT AS x, y::BIGINT AS y, row_number() OVER (ORDER BY x + y, x) - 1 AS k FROM range(8) a(x), range(8) b(y)")
def diagonal_order(spark, d):
    return scalar.diagonals(spark, 8, 8)


@query("SELECT lower(regexp_replace(x, '([a-z])([A-Z][a-z])', '\\1_\\2', 'g')) AS s FROM (SELECT DISTINCT 'kind' || upper(substr(lower(o_orderpriority), 3, 1)) || substr(lower(o_orderpriority), 4) || 'Order' AS x FROM orders)")
def camel_case(spark, d):
    o = fx.table(spark, d, "orders").select(F.expr("concat('kind', upper(substr(lower(o_orderpriority), 3, 1)), substr(lower(o_orderpriority), 4), 'Order')").alias("x")).distinct()
    return o.select(scalar.snake_case(F.col("x")).alias("s"))


@query("SELECT DISTINCT (c % 8)::BIGINT AS x, (c // 8)::BIGINT AS y FROM (SELECT least(63, round_even(i * 64 / 7, 0)::BIGINT) AS c FROM range(7) t(i))")
def equispaced_points(spark, d):
    return scalar.equispaced(spark, 8, 8, 7)


# ---- partitioners and placers


def _hardware(g):
    return fx.hardware(g)


@query(
    "+pins2 AS (SELECT he_id, dst, lag(dst) OVER (PARTITION BY he_id ORDER BY dst) prev FROM pins), fr AS (SELECT s.node s, p.dst v, count(*) a FROM pins2 p JOIN nodes s ON s.node <= p.dst AND s.node > p.dst - 64 AND (p.prev IS NULL OR p.prev < s.node) GROUP BY 1, 2), sy AS (SELECT dst v, count(*) c FROM pins GROUP BY 1), "
    "gr AS (SELECT s.node s, s.node + k v, sum(coalesce(fr.a, 0)) OVER (PARTITION BY s.node ORDER BY k) a, sum(coalesce(sy.c, 0)) OVER (PARTITION BY s.node ORDER BY k) c FROM nodes s CROSS JOIN range(64) t(k) LEFT JOIN fr ON fr.s = s.node AND fr.v = s.node + k LEFT JOIN sy ON sy.v = s.node + k), "
    "nx AS (SELECT s, coalesce(min(v) FILTER (WHERE v > s AND (a > 1200 OR c > 1300)), s + 64) nxt FROM gr GROUP BY 1), st(node) AS (SELECT min(node) FROM nodes UNION SELECT nxt FROM st JOIN nx ON nx.s = st.node WHERE nxt <= (SELECT max(node) FROM nodes)) -- recursive\n SELECT n.node, count(*) - 1 AS part FROM nodes n JOIN st ON st.node <= n.node GROUP BY 1",
    "basket",
)
def partition_sequential(spark, d):
    from ..operators.hypergraph import Caps
    from ..operators.partition import partition_sequential as run

    return run(fx.basket(spark, d), Caps(64, 1200, 1300, 1 << 30))


def _partitioner(name):
    def run(spark, d):
        from .pipeline import partitioned

        g = fx.basket(spark, d)
        return partitioned(g, _hardware(g), name)

    run.__name__ = f"partition_{name}"
    query()(run)


for _name in ("greedy", "edge_hiding", "hyperedge_hiding", "swap", "multistart", "similar", "multilevel"):
    _partitioner(_name)


@query()
def heavy_edge_matching(spark, d):
    from ..operators.partition import mutual_best

    return mutual_best(scores.neighbor_weights(fx.basket(spark, d)))


def _placer(name):
    def run(spark, d):
        from ..operators import place

        g, _, hw, _ = _contracted(spark, d)
        return place.hilbert(g, hw) if name == "hilbert" else place.place(g, hw, name)

    run.__name__ = f"place_{name}"
    query()(run)


for _name in ("hilbert", "spectral", "force_directed", "swarm", "min_distance"):
    _placer(_name)


@query()
def pipeline_sequential_force_directed(spark, d):
    from .pipeline import REGISTRY, run

    g = fx.basket(spark, d)
    return run(g, fx.hardware(g), REGISTRY["sequential-force_directed"])


# ---- orders of contracted hypergraphs


@query()
def feed_forward_order(spark, d):
    from ..operators.order import feed_forward_order as run

    return run(_contracted(spark, d)[0])


@query()
def acyclic_part(spark, d):
    from ..operators.order import acyclic_part as run

    return run(_contracted(spark, d)[0])


@query()
def broken_cycles(spark, d):
    from ..operators.order import broken_cycles as run

    return run(_contracted(spark, d)[0])


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM pins) AS edges, round((SELECT count(*) FROM pins) * 2 / count(*), 6) AS mean_degree FROM nodes", "basket")
def graph_inspect(spark, d):
    g = fx.basket(spark, d)
    return g.pins.agg(F.count(F.lit(1)).alias("edges")).crossJoin(F.broadcast(g.nodes.agg(F.count(F.lit(1)).alias("nodes")))).select("nodes", "edges", F.round(F.col("edges") * 2 / F.col("nodes"), 6).alias("mean_degree"))
