"""Micro-graphs with results worked out by hand, invariants, and round trips of sources and sinks."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry, scalar
from netloom.operators import partition, place, results, scores, similarity, stats, transform, traversal
from netloom.operators.hypergraph import Caps, Hardware, Hypergraph
from netloom.plans import catalog, pipeline
from netloom.plans import fixtures as fx
from netloom.sources import files, generate, layers
from netloom.streaming import rates

SF = "/root/testdata/sf0.001"


def graph(spark, n, hyperedges):
    """hyperedges: (source, destinations, weight)."""
    rows = [(h, s, d, float(w)) for h, (s, ds, w) in enumerate(hyperedges) for d in ds]
    return Hypergraph(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(rows, "he_id long, source long, dst long, weight double"))


LINE = [(0, [1], 1), (1, [2], 1), (2, [3], 1)]
RING = [*LINE, (3, [0], 0.5)]


def test_cycles_and_levels(spark):
    line, ring = graph(spark, 4, LINE), graph(spark, 4, RING)
    assert {tuple(r) for r in traversal.topological_levels(line).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert not traversal.has_cycle(line).first()[0] and traversal.has_cycle(ring).first()[0]
    assert stats.topologically_sorted(line).first()[0] and not stats.topologically_sorted(ring).first()[0]
    assert traversal.average_path_length(line, line.nodes).first()["mean_distance"] == pytest.approx(10 / 6, abs=1e-6)
    assert {r["component"] for r in traversal.strong_components(ring).collect()} == {3}
    assert {r["component"] for r in traversal.strong_components(line).collect()} == {0, 1, 2, 3}
    assert {r["component"] for r in traversal.components(graph(spark, 6, [*LINE, (5, [4], 1)])).collect()} == {0, 4}


def test_star_and_contraction(spark):
    g = graph(spark, 5, [(0, [1, 2, 3, 4], 2)])
    a = g.nodes.select("node", F.when(F.col("node") == 0, 0).otherwise(1).cast("long").alias("part"))
    assert scores.synaptic_reuse(g, a).first()["ar_mean"] == 2.0
    assert scores.connectivity(g, a).first()["connectivity"] == 2.0 and scores.swap_cost(g, a).first()[0] == 2.0 and scores.plain_cut(g, a).first()["cut_weight"] == 2.0
    assert transform.contract(g, a).first()["dsts"] == [1]


def test_squish_and_self_cycle(spark):
    g = graph(spark, 3, [(0, [1, 2], 1), (0, [2, 1], 3), (0, [1], 1)])
    assert {(tuple(r["dsts"]), r["weight"]) for r in transform.squish(g).collect()} == {((1, 2), 4.0), ((1,), 1.0)}
    loop = graph(spark, 2, [(0, [0, 1], 1)])
    assert {tuple(r) for r in stats.degrees(loop).collect()} == {(0, 1, 1, 2), (1, 0, 1, 1)}
    one = loop.nodes.select("node", F.lit(0).cast("long").alias("part"))
    assert transform.contract(loop, one).count() == 0 and transform.contract(loop, one, keep_self=True).count() == 1


def test_split_of_the_border(spark):
    g = graph(spark, 4, [(0, [1, 2, 3], 1), (1, [2, 3], 2)])
    assert {tuple(r) for r in transform.remove_connections(g, 0.4).collect()} == {(0, 2, 1), (1, 0, 2)}
    assert {tuple(r) for r in transform.remove_weight(g, 0.5).collect()} == {(0, 3, 0), (1, 0, 2)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("cached", [False, True])
def test_prefix_sums_of_many_rows(spark, adaptive, cached):
    """Beyond the rows that the bounds of ranges are sampled from, with a column that the sums don't need."""
    n, before = 150_000, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
        rows = rows.cache() if cached else rows
        got = {r["k"]: (r["at"], r["extra"]) for r in transform.running(rows, "v", ["k"], "at").collect()}
        want, total = {}, 0
        for r in sorted(rows.collect()):
            want[r["k"]] = (total, r["extra"])
            total += r["v"]
        assert got == want
    finally:
        rows.unpersist()
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_empty(spark):
    g = graph(spark, 3, [])
    assert stats.overlap(g).first()[0] == 0.0 and stats.degrees(g).count() == 3 and stats.isolated(g).count() == 3
    assert traversal.average_path_length(g, g.nodes).first()["mean_distance"] is None
    assert g.violations().count() == 0


def test_invariants(spark):
    g = fx.basket(spark, SF)
    a = fx.assigned(g)
    kept = transform.contract(g, a, keep_self=True)
    assert kept.agg(F.sum("weight")).first()[0] == g.hyperedges().agg(F.sum("weight")).first()[0]
    total = lambda h: h.agg(F.sum(F.col("weight") * F.size("dsts"))).first()[0]
    assert total(transform.contract(g, a)) == total(transform.contract(g, a, squish_equal=True)) == scores.connectivity(g, a).first()["connectivity"]
    names = g.nodes.select("node", (199 - F.col("node")).alias("new"))
    assert stats.overlap(transform.relabel(g, names)).first() == stats.overlap(g).first()
    assert transform.add_hyperedges(g, spark.createDataFrame([(-1, 0, 10_000, 1.0)], g.pins.schema)).violations().count() == 1
    small = transform.as_graph(transform.contract(g, a), a.select(F.col("part").alias("node")).distinct())
    hw = fx.hardware(g)
    load = scores.congestion(small, fx.placed(a, 3), hw).agg(F.sum("load")).first()[0]
    assert load == pytest.approx(scores.routes(small, fx.placed(a, 3)).agg(F.sum(F.col("weight") * (F.col("d") + 1))).first()[0])


def test_transit_against_the_walk(spark):
    for w, h in ((0, 3), (3, 0), (1, 1), (3, 2), (4, 5)):
        p = np.zeros((w + 1, h + 1))
        p[0, 0] = 1
        for i in range(w + 1):
            for j in range(h + 1):
                both = i < w and j < h
                if i < w:
                    p[i + 1, j] += p[i, j] / (2 if both else 1)
                if j < h:
                    p[i, j + 1] += p[i, j] / (2 if both else 1)
        cells = spark.range((w + 1) * (h + 1)).select(F.floor(F.col("id") / (h + 1)).cast("long").alias("i"), (F.col("id") % (h + 1)).alias("j"))
        for r in cells.select("i", "j", scores.transit(F.col("i"), F.col("j"), F.lit(w).cast("long"), F.lit(h).cast("long"), 8).alias("p")).collect():
            assert r["p"] == pytest.approx(p[r["i"], r["j"]])


def test_hulls():
    assert geometry.hull_cells([(2, 2)], 5, 5) == 1 and geometry.hull_cells([(0, 0), (3, 0)], 5, 5) == 4 and geometry.hull_cells([(0, 0), (2, 2)], 5, 5) == 3
    assert geometry.hull_cells([(0, 0), (1, 2)], 5, 5) == 2 and geometry.hull_cells([(0, 0), (2, 0), (0, 2)], 5, 5) == 6 and geometry.hull_cells([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)], 5, 5) == 9
    r = np.random.default_rng(1)
    for _ in range(300):
        points = [tuple(p) for p in r.integers(0, 7, (r.integers(1, 7), 2)).tolist()]
        hull = geometry.convex_hull(points)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        inside = sum(all(geometry.cross(a, b, (x, y)) >= 0 for a, b in zip(hull, hull[1:] + hull[:1], strict=True)) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1))
        assert geometry.hull_cells(points, 7, 7) == inside


@pytest.mark.parametrize(("w", "h"), [(1, 1), (5, 1), (4, 4), (8, 8), (7, 3), (6, 10), (13, 5)])
def test_curve_visits_each_cell_once(w, h):
    cells = geometry.curve(w, h)
    assert sorted(cells) == [(x, y) for x in range(w) for y in range(h)]
    assert sum(max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 1 for a, b in zip(cells, cells[1:], strict=False)) == 0


def caps_hold(g, a, caps):
    bad = scores.part_loads(g, a).where(f"n_nodes > {caps.nodes} OR (n_nodes > 1 AND (n_axons > {caps.axons} OR n_synapses > {caps.synapses}))")
    ids = sorted(r[0] for r in a.select("part").distinct().collect())
    return bad.count() == 0 and ids == list(range(len(ids))) and a.count() == g.nodes.count()


def plain_sequential(g, caps):
    rows = {}
    for r in g.pins.collect():
        rows.setdefault(r["dst"], []).append(r["he_id"])
    part, held, size, pins, out = 0, set(), 0, 0, {}
    for n in sorted(r[0] for r in g.nodes.collect()):
        into = rows.get(n, [])
        if size and (size + 1 > caps.nodes or len(held | set(into)) > caps.axons or pins + len(into) > caps.synapses):
            part, held, size, pins = part + 1, set(), 0, 0
        held |= set(into)
        size, pins, out[n] = size + 1, pins + len(into), part
    return out


def test_partitioners(spark):
    g, caps = fx.basket(spark, SF), Caps(32, 500, 600, 64)
    first = partition.partition_sequential(g, caps)
    assert {r[0]: r[1] for r in first.collect()} == plain_sequential(g, caps) == {r[0]: r[1] for r in partition.partition(g, caps, "sequential").collect()}
    cost = lambda a: scores.connectivity(g, a).first()["connectivity"]
    for method in ("greedy", "edge_hiding", "hyperedge_hiding", "swap", "multistart"):
        a = partition.partition(g, caps, method, (1, 2) if method == "multistart" else (1,))
        assert caps_hold(g, a, caps), method
        if method in ("greedy", "multistart"):
            assert cost(a) <= cost(first), method
    for a in (partition.partition_multilevel(g, caps, 3), partition.partition_similar(g, caps, 2)):
        assert caps_hold(g, a, caps)
    with pytest.raises(Exception, match="parts are needed"):
        partition.partition_sequential(g, Caps(32, 500, 600, 2))


def test_refinement_ends_when_no_move_pays():
    """A hypergraph on which moves still pay after two sweeps."""
    r, rows = np.random.default_rng(0), []
    for h in range(60):
        s, *ds = r.choice(24, 5, replace=False)
        rows += [(h, s, d, float(1 + h % 7)) for d in ds]
    out = partition.refined(partition.greedy(partition.Incidence(range(24), *(np.array(c) for c in zip(*rows, strict=True))), Caps(6, 60, 60, 20), 0))
    cost = out.cost()
    assert partition.refined(out).cost() == cost


def test_no_swap_pays():
    """All pairs of nodes by the cost itself, neighbours or not."""
    r, rows = np.random.default_rng(3), []
    for h in range(60):
        s, *ds = r.choice(24, 5, replace=False)
        rows += [(h, s, d, float(1 + h % 7)) for d in ds]
    he, source, dst, weight = (np.array(c) for c in zip(*rows, strict=True))
    caps = Caps(4, 60, 60, 20)
    for seed in range(4):
        out = partition.swapped(partition.Incidence(range(24), he, source, dst, weight), caps, seed)
        base = out.cost()
        for a in range(24):
            for b in range(a):
                pa, pb = out.part[a], out.part[b]
                if pa != pb:
                    out.drop(a), out.drop(b)
                    fit = out.fits(b, pa) and out.fits(a, pb)
                    out.add(a, pb), out.add(b, pa)
                    assert not fit or out.cost() >= base - 0.1
                    out.drop(a), out.drop(b)
                    out.add(a, pa), out.add(b, pb)


def test_bfs_query_has_no_bound(spark, monkeypatch):
    monkeypatch.setattr(fx, "basket", lambda spark, d: graph(spark, 8, [(k, [k + 1], 1) for k in range(6)]))
    assert {(r["node"], r["level"]) for r in catalog.QUERIES["bfs_levels"](spark, SF).collect()} == {(k, k) for k in range(7)}


def test_coarsening_goes_on(spark):
    """Of a path with growing weights one pair a round is mutually best; no two neighbours may be left that fit."""
    n = 40
    g, caps = graph(spark, n, [(k, [k + 1], k + 1) for k in range(n - 1)]), Caps(4, 100, 100, 20)
    for run in (partition.partition_multilevel,):
        a = {r[0]: r[1] for r in run(g, caps).collect()}
        size = {p: list(a.values()).count(p) for p in a.values()}
        assert len(a) == n and max(size.values()) <= 4
        assert len(size) <= n // 4 or all(a[k] == a[k + 1] or size[a[k]] + size[a[k + 1]] > 4 for k in range(n - 1))
    far = graph(spark, 6, [(0, [1], 1), (2, [3], 1)])
    for run in (partition.partition_multilevel, partition.partition_similar):
        with pytest.raises(partition.PartitionError):
            run(far, Caps(4, 100, 100, 1))


def test_placers(spark):
    g = fx.basket(spark, SF)
    a = fx.assigned(g, 8)
    small = transform.as_graph(transform.contract(g, a, squish_equal=True), a.select(F.col("part").alias("node")).distinct())
    hw, found = Hardware(8, 999, 999, 6, 6), {}
    for name in (*place.METHODS, "hilbert"):
        p = place.hilbert(small, hw) if name == "hilbert" else place.place(small, hw, name)
        assert scores.placement_validity(a, p, hw).first()["valid"], name
        found[name] = scores.metrics(small, p, hw, ["energy"]).first()[0]
    assert found["force_directed"] <= found["spectral"] and found["swarm"] <= found["rows"] * 1.2
    again = [sorted(map(tuple, place.place(small, hw, "swarm", 5).collect())) for _ in range(2)]
    assert again[0] == again[1]
    assert pipeline.run(g, fx.hardware(g), pipeline.REGISTRY["greedy-hilbert"]).first()["n_parts"] >= 4 and len(pipeline.REGISTRY) == 40


def test_similarity(spark):
    sets = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (2, 3, 3.0), (3, 9, 1.0), (4, 1, 2.0), (4, 2, 2.0)], "set_id long, elem long, w double")
    got = {(r[0], r[1]): r[2] for r in similarity.weighted_jaccard(sets).collect()}
    assert got == {(1, 2): 0.375, (1, 4): 1.0, (2, 4): 0.375}
    assert (1, 4) in {tuple(r) for r in similarity.candidates(similarity.signatures(sets, 8)).collect()}
    merged = similarity.merged_sets(sets, spark.createDataFrame([(1, 0), (4, 0)], "set_id long, group long"), "max")
    assert {tuple(r) for r in merged.collect()} == {(0, 1, 2.0), (0, 2, 2.0)}


def test_results(spark):
    rows = [("g", "a-x", 2.0, 4.0), ("g", "a-y", 1.0, 1.0), ("g", "b-x", None, 3.0), ("h", "a-x", 3.0, 1.0), ("h", "a-y", 6.0, 2.0), ("h", "b-x", 9.0, 9.0)]
    r = spark.createDataFrame(rows, "graph string, technique string, energy double, latency double")
    n = {(x[0], x[1]): x[2] for x in results.normalised(r, ["energy"]).collect()}
    assert n["g", "a-x"] == 2.0 and n["g", "b-x"] is None and n["h", "a-y"] == 2.0
    assert {x[0]: x[1] for x in results.technique_averages(r, ["energy"]).collect()} == {"a-x": 1.0, "a-y": 1.0, "b-x": None}
    assert {x[0] for x in results.undominated(results.with_elp(r)).collect()} == {"a-x", "a-y", "b-x"}
    slope, intercept = results.huber_fit(spark.createDataFrame([(10.0**k, 3 * 10.0 ** (2 * k)) for k in range(6)], "x double, y double"), "x", "y")
    assert slope == pytest.approx(2) and 10**intercept == pytest.approx(3)


def test_scalars(spark):
    one = spark.range(1)
    assert [r[0] for r in one.select(F.explode(F.array(*[scalar.snake_case(F.lit(x)) for x in ("camelCase", "HTMLPage", "x")]))).collect()] == ["camel_case", "html_page", "x"]
    assert one.select(scalar.size_string(F.lit(1536.0))).first()[0] == "1.5 KB"
    assert sorted(map(tuple, scalar.equispaced(spark, 4, 4, 1).collect())) == [(2, 2)]
    assert sorted(y * 8 + x for x, y in scalar.equispaced(spark, 8, 8, 7).collect()) == [0, 9, 18, 27, 37, 46, 55]
    assert {tuple(r) for r in scalar.dict_sum(spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long")).collect()} == {("a", 3), ("b", 3)}


def test_round_trips(spark, tmp_path):
    g = graph(spark, 6, [(0, [1, 2, 5], 1.5), (3, [4], 0.25)])
    files.write_hgr(g, str(tmp_path / "g.hgr"))
    back = files.read_hgr(spark, str(tmp_path / "g.hgr"))
    assert sorted(map(tuple, back.pins.collect())) == sorted(map(tuple, g.pins.collect())) and back.nodes.count() == 6
    files.write_csv(g, str(tmp_path / "csv"))
    assert {(r[0], tuple(r[1])) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()} == {(0, (1, 2, 5)), (3, (4,))}
    p = spark.createDataFrame([(0, 3, 4), (1, -1, 2)], "part long, x long, y long")
    files.write_coords(p, str(tmp_path / "p.plac"))
    assert sorted(map(tuple, files.read_coords(spark, str(tmp_path / "p.plac")).collect())) == [(0, 3, 4), (1, -1, 2)]
    files.write_gdf(g, str(tmp_path / "gdf"), {"one": g.nodes.select("node", F.lit(7).alias("part"))})
    lines = [r[0] for r in spark.read.text(str(tmp_path / "gdf")).collect()]
    assert "nodedef>name VARCHAR,partition_one VARCHAR" in lines and "5,7" in lines and "3,4,0.250" in lines
    (tmp_path / "g.txt").write_text("a\nb\na;b\nb;c\n")
    assert {(r["source"], r["dst"]) for r in files.read_compact(spark, str(tmp_path / "g.txt")).pins.collect()} == {(0, 1), (1, 2)}
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n0"><data key="spike_frequency">2.5</data></node><node id="n1"></node><edge source="n0" target="n1"></edge></graph></graphml>')
    assert [tuple(r) for r in files.read_graphml(spark, str(tmp_path / "g.graphml")).pins.collect()] == [(0, 0, 1, 2.5)]
    np.savez(tmp_path / "a.npz", arr_0=np.arange(6.0).reshape(2, 3))
    assert {(tuple(r["idx"]), r["v"]) for r in files.read_npz(spark, str(tmp_path / "a.npz")).collect()} == {((i, j), 3.0 * i + j) for i in range(2) for j in range(3)}
    (tmp_path / "res").mkdir()
    (tmp_path / "res/g1.json").write_text(json.dumps([{"name": "a-x", "part_cost": 2.0}, {"name": "a-y", "note": "failed"}]))
    (tmp_path / "res/_skip.json").write_text(json.dumps([{"name": "z"}]))
    assert [(r["graph"], r["name"], r["part_cost"]) for r in files.read_results(spark, str(tmp_path / "res")).collect()] == [("g1", "a-x", 2.0)]


def test_sonata(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "source_node_id long, target_node_id long")
    spikes = spark.createDataFrame([(0, float(k)) for k in range(101)], "node_ids long, timestamps double")
    g = files.from_sonata(nodes, edges, spikes)
    assert {(r["source"], r["dst"], round(r["weight"], 4)) for r in g.pins.collect()} == {(0, 1, 1.1222), (0, 2, 1.1222), (1, 2, 0.0)}
    with pytest.raises(ValueError, match="dense"):
        files.from_sonata(nodes.where("node_id > 0"), edges, spikes)


def test_generators(spark):
    for make in (generate.random_graph, generate.reservoir, generate.hierarchical):
        one = make(spark, 200, 8, 2) if make is generate.random_graph else make(spark, 200, 8)
        rows = sorted(map(tuple, one.pins.collect()))
        again = make(spark, 200, 8, 2) if make is generate.random_graph else make(spark, 200, 8)
        assert rows == sorted(map(tuple, Hypergraph(again.nodes, again.pins.repartition(3)).pins.collect()))
        assert one.violations().count() == 0 and 3 < len(rows) / 200 < 14 and all(r[1] != r[2] for r in rows)


def test_layers(spark):
    net = [layers.Layer("input", shape=(4, 4, 1)), layers.Layer("conv", (0,), 2, kernel=(3, 3)), layers.Layer("pool", (1,), kernel=(2, 2), stride=(2, 2)), layers.Layer("flatten", (2,)), layers.Layer("dense", (3,), 3)]
    assert layers.shapes(net) == [(4, 4, 1), (2, 2, 2), (1, 1, 2), (1, 1, 2), (1, 1, 3)]
    assert layers.network(spark, net).pins.count() == 8 * 9 + 8 + 2 + 6
    same = [layers.Layer("input", shape=(3, 3, 1)), layers.Layer("conv", (0,), 1, kernel=(3, 3), same=True)]
    assert layers.network(spark, same).pins.count() == 4 * 4 + 4 * 6 + 9


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    out = rates.windowed_rates(rates.event_stream(spark, str(tmp_path / "in"), events.schema), "1 day")
    run = out.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == events.count()


def test_catalogue():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_hyperedges_of_nodes_and_new_nodes(spark):
    g = graph(spark, 4, [(0, [1, 2], 1), (2, [2, 0], 1), (3, [1], 1)])
    some = spark.createDataFrame([(0,), (2,)], "node long")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(g.outbound(some)) == [(0, 0), (2, 1)] and pairs(g.inbound(some)) == [(0, 1), (2, 0), (2, 1)] and pairs(g.touching(some)) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    assert pairs(g.with_nodes(spark.createDataFrame([(3,), (9,)], "node long")).nodes) == [(0,), (1,), (2,), (3,), (9,)]


def test_index(spark):
    rows = [(s, e, 1.0 + e % 3) for s in range(8) for e in range(s // 2 * 10, s // 2 * 10 + 6)]
    sets = spark.createDataFrame(rows, "set_id long, elem long, w double")
    index = similarity.Index.of(sets.where("set_id < 4"), 32, 2)
    more = index.insert(sets.where("set_id >= 3")).delete(spark.createDataFrame([(6,)], "set_id long"))
    assert index.size().first()[0] == 4 and more.size().first()[0] == 7 and {r[0] for r in more.contains(sets.select("set_id").distinct()).where("NOT known").collect()} == {6}
    assert {tuple(r) for r in more.query_ids(spark.createDataFrame([(0,), (3,), (7,)], "set_id long"), 2).collect()} == {(0, 1, 1.0, 1), (3, 2, 1.0, 1)}
    assert [r["other"] for r in more.query(sets.where("set_id = 6"), 1).collect()] == [7]


def test_polygon(spark):
    corners = geometry.convex_hull([(1, 1), (5, 0), (7, 4), (3, 6), (3, 3)])
    inside = scalar.diagonals(spark, 9, 9).where(scalar.in_polygon(F.col("x"), F.col("y"), corners)).count()
    assert inside == geometry.hull_cells(corners, 9, 9)
    assert scalar.diagonals(spark, 9, 9).where(scalar.in_polygon(F.col("x"), F.col("y"), [(1, 1), (3, 3)])).count() == 3


def test_ordered_pipeline(spark):
    g, hw = graph(spark, 6, [(5, [4], 1), (4, [3], 1), (3, [2, 5], 1), (2, [1], 1), (1, [0], 1)]), Hardware(2, 9, 9, 4, 4)
    r = pipeline.run(g, hw, pipeline.REGISTRY["sequential-topological-hilbert"]).first()
    assert r["n_parts"] == 3 and r["part_valid"] and r["placement_valid"]
