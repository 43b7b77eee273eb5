"""Readers and writers. Binary inputs come through Spark's own file source, so any store that Spark reads will do; a binary file is one row, of at most 2 GB."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph
from ..operators.transform import running

#: Item types of packed arrays, by their letters.
PACKED = {"i": "<i4", "I": "<u4", "q": "<i8", "f": "<f4", "d": "<f8"}


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_hgr(spark: SparkSession, path: str) -> Hypergraph:
    """The hypergraph of a binary file: node and hyperedge counts, then for each hyperedge the number of destinations, the source, the destinations (32-bit unsigned) and the weight (32-bit float), little-endian."""

    def parse(batches):
        for b in batches:
            for content in b.column(1):
                data = content.as_buffer()
                word = np.frombuffer(data, "<u4")
                n, m, at = int(word[0]), int(word[1]), 2
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n]), pa.array([0]), pa.array([0.0])], names=["he_id", "source", "dst", "weight"])
                for first in range(0, m, 10_000):
                    he, source, dst, weight = [], [], [], []
                    for h in range(first, min(m, first + 10_000)):
                        k = int(word[at])
                        he.append(np.full(k, h))
                        source.append(np.full(k, word[at + 1], np.int64))
                        dst.append(word[at + 2 : at + 2 + k].astype(np.int64))
                        weight.append(np.full(k, word[at + 2 + k : at + 3 + k].view("<f4")[0], np.float64))
                        at += 3 + k
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (he, source, dst, weight)], names=["he_id", "source", "dst", "weight"])

    rows = _binary(spark, path).mapInArrow(parse, "he_id long, source long, dst long, weight double")
    nodes = rows.where("he_id = -1 AND source > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("source") - 1)).alias("node"))
    return Hypergraph(nodes, rows.where("he_id >= 0"))


def write_hgr(graph: Hypergraph, path: str) -> None:
    """One file, written by the driver as the hyperedges arrive, one partition at a time; weights lose their double precision."""
    rows = graph.listed().orderBy("he_id")
    with open(path, "wb") as f:
        f.write(struct.pack("<II", graph.nodes.count(), rows.count()))
        for r in rows.toLocalIterator():
            f.write(struct.pack("<II", len(r["dsts"]), r["source"]) + np.array(r["dsts"], "<u4").tobytes() + struct.pack("<f", r["weight"]))


def read_packed(spark: SparkSession, path: str, kind: str = "i") -> DataFrame:
    """(idx, value) of a packed array."""
    item = np.dtype(PACKED[kind])
    out = "long" if item.kind in "iu" else "double"

    def parse(batches):
        for b in batches:
            for content in b.column(1):
                value = np.frombuffer(content.as_buffer(), item)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value.astype(np.int64 if out == "long" else np.float64))], names=["idx", "value"])

    return _binary(spark, path).mapInArrow(parse, f"idx long, value {out}")


def write_packed(df: DataFrame, path: str, kind: str = "i", order: str = "idx", value: str = "value") -> None:
    with open(path, "wb") as f:
        for r in df.orderBy(order).select(value).toLocalIterator():
            f.write(np.array([r[0]], PACKED[kind]).tobytes())


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """(part, x, y) of flattened pairs."""
    v = read_packed(spark, path, "i").withColumn("part", F.floor(F.col("idx") / 2).cast("long"))
    return v.groupBy("part").agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("idx") % 2 == 1, F.col("value"))).alias("y"))


def write_coords(placement: DataFrame, path: str) -> None:
    flat = placement.select((F.col("part") * 2).alias("idx"), F.col("x").alias("value")).union(placement.select(F.col("part") * 2 + 1, "y"))
    write_packed(flat, path)


def write_csv(graph: Hypergraph, path: str) -> None:
    """A line for each hyperedge: source and destinations, separated by semicolons."""
    graph.listed().select(F.concat_ws(";", F.col("source").cast("string"), F.col("dsts").cast("array<string>")).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source, dsts)."""
    parts = F.transform(F.split("value", ";"), lambda x: x.cast("long"))
    return spark.read.text(path).select(parts[0].alias("source"), F.slice(parts, 2, F.size(parts) - 1).alias("dsts"))


def gdf_lines(graph: Hypergraph, partitionings: dict[str, DataFrame] | None = None) -> DataFrame:
    """(section, n, line) of a graph file with a node section, with parts if given, and an edge section."""
    parts = partitionings or {}
    nodes = graph.nodes.select("node", F.col("node").cast("string").alias("line"))
    for name, a in parts.items():
        nodes = nodes.join(a.select("node", F.col("part").alias(name)), "node").select("node", F.concat_ws(",", "line", F.col(name).cast("string")).alias("line"))
    spark = graph.nodes.sparkSession
    heads = spark.createDataFrame([(0, -1, "nodedef>name VARCHAR" + "".join(f",partition_{n} VARCHAR" for n in parts)), (1, -1, "edgedef>node1 VARCHAR,node2 VARCHAR,weight DOUBLE")], "section int, n long, line string")
    edges = graph.pins.select(F.lit(1).alias("section"), F.col("he_id").alias("n"), F.format_string("%d,%d,%.3f", "source", "dst", "weight").alias("line"))
    return heads.union(nodes.select(F.lit(0), F.col("node"), "line")).union(edges)


def write_gdf(graph: Hypergraph, path: str, partitionings: dict[str, DataFrame] | None = None) -> None:
    """The lines in order, in as many files as the sort makes."""
    gdf_lines(graph, partitionings).orderBy("section", "n", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def gml_lines(graph: Hypergraph) -> DataFrame:
    """(section, n, line) of a directed GML graph: nodes, and an edge for each pin with its weight."""
    heads = graph.nodes.sparkSession.createDataFrame([(0, -1, "graph [ directed 1"), (3, -1, "]")], "section int, n long, line string")
    nodes = graph.nodes.select(F.lit(1).alias("section"), F.col("node").alias("n"), F.format_string("node [ id %d label \"%d\" ]", "node", "node").alias("line"))
    edges = graph.pins.select(F.lit(2), F.col("he_id"), F.format_string("edge [ source %d target %d weight %.3f ]", "source", "dst", "weight"))
    return heads.union(nodes).union(edges)


def write_gml(graph: Hypergraph, path: str) -> None:
    """The lines in order, in as many files as the sort makes."""
    gml_lines(graph).orderBy("section", "n", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str, rate_key: str = "spike_frequency") -> Hypergraph:
    """Nodes get ids by their names' order in the file; each source has one hyperedge, whose weight is the node's rate (1 without one)."""
    base = spark.read.option("attributePrefix", "_").option("valueTag", "_VALUE")
    data = "array<struct<_key:string,_VALUE:string>>"
    node = base.schema(f"_id string, data {data}").option("rowTag", "node").xml(path).withColumn("seq", F.monotonically_increasing_id()).where("_id IS NOT NULL")
    edge = base.schema("_source string, _target string").option("rowTag", "edge").xml(path).where("_source IS NOT NULL")
    rate = F.get(F.filter("data", lambda x: x["_key"].contains(rate_key) | (x["_key"] == "d0")), F.lit(0))["_VALUE"].cast("double")
    ids = running(node.withColumn("one", F.lit(1)), "one", ["seq"], "node").select("_id", F.col("node").cast("long").alias("node"), F.coalesce(rate, F.lit(1.0)).alias("weight"))
    start = ids.select(F.col("_id").alias("_source"), F.col("node").alias("source"), "weight")
    pins = edge.join(start, "_source").join(ids.select(F.col("_id").alias("_target"), F.col("node").alias("dst")), "_target")
    return Hypergraph(ids.select("node"), pins.select(F.col("source").alias("he_id"), "source", "dst", "weight").distinct())


def read_compact(spark: SparkSession, path: str) -> Hypergraph:
    """Lines `name` (a node) and `a;b` (an edge); ids by names' first line; weight 1."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).withColumn("p", F.split(F.trim("value"), ";")).where("trim(value) <> ''")
    names = lines.select(F.posexplode("p").alias("k", "name"), "seq").groupBy("name").agg(F.min(F.struct("seq", "k")).alias("first")).withColumn("one", F.lit(1))
    ids = running(names, "one", ["first"], "node").select("name", F.col("node").cast("long").alias("node"))
    edge = lines.where(F.size("p") == 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    pins = edge.join(ids.select(F.col("name").alias("a"), F.col("node").alias("source")), "a").join(ids.select(F.col("name").alias("b"), F.col("node").alias("dst")), "b")
    return Hypergraph(ids.select("node"), pins.select(F.col("source").alias("he_id"), "source", "dst", F.lit(1.0).alias("weight")).distinct())


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(array, idx, v): every value of every plain array in archives."""

    def parse(batches):
        for b in batches:
            for content in b.column(1):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        value = np.lib.format.read_array(io.BytesIO(z.read(name)), allow_pickle=False)
                        for at in range(0, value.size, 100_000):
                            flat = value.reshape(-1)[at : at + 100_000]
                            idx = np.column_stack(np.unravel_index(np.arange(at, at + len(flat)), value.shape)) if value.ndim else np.zeros((1, 0), int)
                            yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".npy")] * len(flat)), pa.array(idx.tolist(), pa.list_(pa.int64())), pa.array(flat.astype(float))], names=["array", "idx", "v"])

    return _binary(spark, path).mapInArrow(parse, "array string, idx array<long>, v double")


def from_sonata(nodes: DataFrame, edges: DataFrame, spikes: DataFrame, renumber: bool = False) -> Hypergraph:
    """nodes (node_id), edges (source_node_id, target_node_id), spikes (node_ids, timestamps): one hyperedge for each source; its weight is its spike rate, 0 without spikes. Ids must be 0 to n - 1 unless they are renumbered."""
    from ..functions.scalar import spike_rates

    rate = spike_rates(spikes.select(F.col("node_ids").alias("node"), F.col("timestamps").alias("ts")))
    n, least, most = nodes.agg(F.count_distinct("node_id"), F.min("node_id"), F.max("node_id")).first()
    if not renumber and n and (least != 0 or most != n - 1):
        raise ValueError("node ids aren't dense")
    pins = edges.select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("dst")).distinct().join(rate, F.col("source") == F.col("node"), "left")
    graph = Hypergraph(nodes.select(F.col("node_id").alias("node")), pins.select(F.col("source").alias("he_id"), "source", "dst", F.coalesce("rate", F.lit(0.0)).alias("weight")))
    if renumber:
        from ..operators.transform import relabel

        ids = running(graph.nodes.withColumn("one", F.lit(1)), "one", ["node"], "new").select("node", F.col("new").cast("long").alias("new"))
        return relabel(graph, ids)
    return graph


#: Fields of experiment records.
RESULTS = (
    "name string, graph_nodes long, graph_edges long, graph_cost double, hw_npc int, hw_apc int, hw_spc int, hw_cpc int, part_valid boolean, part_cost double, part_count int, part_synaptic_reuse struct<ar_mean:double,geo_mean:double>, "
    + ", ".join(f"{p}_valid boolean, {p}_energy double, {p}_avg_lat double, {p}_max_lat double, {p}_avg_cong double, {p}_max_cong double, {p}_connections_locality struct<ar_mean:double,geo_mean:double,ar_mean_weighted:double,geo_mean_weighted:double>" for p in ("init", "plac"))
    + ", note string, part_time double, time double, approx_time double, sim_energy double, sim_latency double"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Records of all JSON lists in a folder, with `graph` from the file's name; files that start with _ are left out, and so are records of failures."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.json$", 1)
    out = spark.read.schema(RESULTS).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(path).select("*", name.alias("graph"))
    return out.where("note IS NULL AND name IS NOT NULL")


def append_results(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
