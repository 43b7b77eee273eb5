"""Hypergraphs and other inputs from the ordinary tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Hardware, Hypergraph

BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_as_nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"))


def basket(spark, sf_dir, acyclic: bool = False) -> Hypergraph:
    """Parts as nodes; one hyperedge per order with at least two distinct parts. Even orders start at the least part, odd ones at the greatest, or all at the least."""
    orders = (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("he_id"))
        .agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"), F.sum(F.col("l_quantity").cast("double")).alias("weight"), F.collect_set(F.col("l_partkey").cast("long")).alias("parts"))
        .where("lo < hi")
    )
    source = F.col("lo") if acyclic else F.when(F.col("he_id") % 2 == 0, F.col("lo")).otherwise(F.col("hi"))
    pins = orders.select("he_id", source.cast("long").alias("source"), F.explode("parts").alias("dst"), "weight").where("dst <> source")
    return Hypergraph(parts_as_nodes(spark, sf_dir), pins)


def axon(spark, sf_dir) -> Hypergraph:
    """Suppliers fire into the parts that they deliver: two layers, wide fan-out."""
    shift = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("shift"))
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("he_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("weight"), F.collect_set(F.col("l_partkey").cast("long")).alias("parts"))
    pins = line.select("he_id", F.col("he_id").alias("source"), F.explode("parts").alias("p"), "weight").crossJoin(F.broadcast(shift)).select("he_id", "source", (F.col("p") + F.col("shift")).alias("dst"), "weight")
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node")).union(parts_as_nodes(spark, sf_dir).crossJoin(F.broadcast(shift)).select(F.col("node") + F.col("shift")))
    return Hypergraph(nodes, pins)


def assigned(graph: Hypergraph, block: int = BLOCK) -> DataFrame:
    """(node, part): blocks of consecutive nodes."""
    return graph.nodes.select("node", F.floor(F.col("node") / block).cast("long").alias("part"))


def hardware(graph: Hypergraph, block: int = BLOCK) -> Hardware:
    parts = math.ceil(graph.nodes.count() / block)
    side = max(8, math.ceil(math.sqrt(parts)))
    return Hardware(64, 2048, 2048, side, side)


def placed(assignment: DataFrame, width: int) -> DataFrame:
    """(part, x, y): row by row."""
    return assignment.select("part").distinct().select("part", (F.col("part") % width).cast("long").alias("x"), F.floor(F.col("part") / width).cast("long").alias("y"))


def spikes(spark, sf_dir) -> DataFrame:
    """(node, ts): seconds."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("node"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


def weighted_sets(graph: Hypergraph) -> DataFrame:
    """(set_id, elem, w): of each node the weights that enter it, by source."""
    return graph.pins.groupBy(F.col("dst").alias("set_id"), F.col("source").alias("elem")).agg(F.sum("weight").alias("w"))


def results(spark, sf_dir) -> DataFrame:
    """Experiment records (graph, technique, energy, latency, cost) made of orders and customers."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.round(F.col("o_totalprice").cast("double") * 100).cast("long")
    return joined.groupBy(F.col("o_orderpriority").alias("graph"), F.concat_ws("-", "o_orderstatus", "c_mktsegment").alias("technique")).agg((F.sum(price) / 100).alias("energy"), (F.sum(price) / 100 / F.count(F.lit(1))).alias("latency"), F.count(F.lit(1)).cast("double").alias("cost"))


#: DuckDB versions of the fixtures, as common table expressions.
SQL = {
    "basket": "s AS (SELECT l_orderkey::BIGINT he_id, min(l_partkey) lo, max(l_partkey) hi, sum(l_quantity::DOUBLE) weight FROM lineitem GROUP BY 1), h AS (SELECT he_id, (CASE WHEN he_id % 2 = 0 THEN lo ELSE hi END)::BIGINT source, weight FROM s WHERE lo < hi), pins AS (SELECT DISTINCT h.he_id, h.source, l.l_partkey::BIGINT dst, h.weight FROM h JOIN lineitem l ON l.l_orderkey = h.he_id WHERE l.l_partkey <> h.source), nodes AS (SELECT p_partkey::BIGINT node FROM part)",
    "dag": "s AS (SELECT l_orderkey::BIGINT he_id, min(l_partkey) lo, max(l_partkey) hi, sum(l_quantity::DOUBLE) weight FROM lineitem GROUP BY 1), pins AS (SELECT DISTINCT s.he_id, s.lo::BIGINT source, l.l_partkey::BIGINT dst, s.weight FROM s JOIN lineitem l ON l.l_orderkey = s.he_id WHERE s.lo < s.hi AND l.l_partkey <> s.lo), nodes AS (SELECT p_partkey::BIGINT node FROM part)",
    "axon": "pins AS (SELECT l_suppkey::BIGINT he_id, l_suppkey::BIGINT source, ((SELECT count(*) FROM supplier) + l_partkey)::BIGINT dst, sum(sum(l_quantity::DOUBLE)) OVER (PARTITION BY l_suppkey) weight FROM lineitem GROUP BY l_suppkey, l_partkey), nodes AS (SELECT s_suppkey::BIGINT node FROM supplier UNION ALL SELECT p_partkey + (SELECT count(*) FROM supplier) FROM part)",
    "assign": f"assign AS (SELECT node, floor(node / {BLOCK})::BIGINT part FROM nodes)",
    "place": f"side AS (SELECT greatest(8, ceil(sqrt(ceil(count(*) / {BLOCK}))))::BIGINT w FROM nodes), place AS (SELECT DISTINCT part, part % w x, floor(part / w)::BIGINT y FROM assign, side)",
    "spikes": "spikes AS (SELECT user_id::BIGINT node, epoch_us(ts) / 1e6 ts FROM events)",
    "results": "r AS (SELECT o_orderpriority graph, o_orderstatus || '-' || c_mktsegment technique, sum(round(o_totalprice::DOUBLE * 100)::BIGINT)::BIGINT / 100 energy, sum(round(o_totalprice::DOUBLE * 100)::BIGINT)::BIGINT / 100 / count(*) latency, count(*)::DOUBLE AS cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
}
