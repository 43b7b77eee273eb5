"""Neuron graphs of layered networks, from a declared list of layers. Each layer is a range join of coordinates; the tables are built by Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph


@dataclass(frozen=True)
class Layer:
    """kind: input, dense, conv, depthwise, pool, global_pool, pad, add, concat, flatten; `inputs` are the numbers of earlier layers. units: neurons or filters."""

    kind: str
    inputs: tuple[int, ...] = ()
    units: int = 0
    shape: tuple[int, int, int] = (1, 1, 1)
    kernel: tuple[int, int] = (1, 1)
    stride: tuple[int, int] = (1, 1)
    same: bool = False
    pad: tuple[int, int] = (0, 0)


def _extent(size: int, kernel: int, stride: int, same: bool) -> tuple[int, int]:
    """Outputs along an axis, and the padding before it."""
    if not same:
        return (size - kernel) // stride + 1, 0
    out = -(-size // stride)
    return out, max(0, (out - 1) * stride + kernel - size) // 2


def shapes(layers: list[Layer]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a in layers:
        of = [out[k] for k in a.inputs]
        if a.kind == "input":
            out.append(a.shape)
        elif a.kind == "dense":
            out.append((1, 1, a.units))
        elif a.kind in ("conv", "depthwise", "pool"):
            h, w, c = of[0]
            out.append((_extent(h, a.kernel[0], a.stride[0], a.same)[0], _extent(w, a.kernel[1], a.stride[1], a.same)[0], a.units if a.kind == "conv" else c))
        elif a.kind == "global_pool":
            out.append((1, 1, of[0][2]))
        elif a.kind == "pad":
            out.append((of[0][0] + 2 * a.pad[0], of[0][1] + 2 * a.pad[1], of[0][2]))
        elif a.kind == "concat":
            out.append((of[0][0], of[0][1], sum(s[2] for s in of)))
        elif a.kind == "flatten":
            out.append((1, 1, of[0][0] * of[0][1] * of[0][2]))
        else:
            out.append(of[0])
    return out


def network(spark: SparkSession, layers: list[Layer]) -> Hypergraph:
    """Neurons are numbered layer by layer in row order; each neuron fires into those that read it, with weight 1."""
    shape = shapes(layers)
    base = [0]
    for h, w, c in shape:
        base.append(base[-1] + h * w * c)

    def cells(k: int, prefix: str) -> DataFrame:
        h, w, c = shape[k]
        i = F.col("id")
        return spark.range(h * w * c).select((i + base[k]).alias(f"{prefix}n"), F.floor(i / (w * c)).cast("long").alias(f"{prefix}h"), F.floor(i / c % w).cast("long").alias(f"{prefix}w"), (i % c).alias(f"{prefix}c"))

    edges = None
    for k, a in enumerate(layers):
        shift = 0
        for j in a.inputs:
            new, old = cells(k, "o"), cells(j, "i")
            if a.kind in ("conv", "depthwise", "pool"):
                (_, top), (_, left) = (_extent(shape[j][x], a.kernel[x], a.stride[x], a.same) for x in (0, 1))
                low_h, low_w = F.col("oh") * a.stride[0] - top, F.col("ow") * a.stride[1] - left
                reads = new.withColumn("ih", F.explode(F.sequence(low_h, low_h + a.kernel[0] - 1))).withColumn("iw", F.explode(F.sequence(low_w, low_w + a.kernel[1] - 1)))
                on = ["ih", "iw"] if a.kind == "conv" else ["ih", "iw", "ic"]
                joined = (reads if a.kind == "conv" else reads.withColumn("ic", F.col("oc"))).join(old, on)
            elif a.kind == "dense":
                joined = new.crossJoin(old)  # every pair is an edge
            elif a.kind == "global_pool":
                joined = new.join(old, F.col("oc") == F.col("ic"))
            elif a.kind == "pad":
                joined = new.join(old, (F.col("oh") == F.col("ih") + a.pad[0]) & (F.col("ow") == F.col("iw") + a.pad[1]) & (F.col("oc") == F.col("ic")))
            elif a.kind == "concat":
                joined = new.join(old, (F.col("oh") == F.col("ih")) & (F.col("ow") == F.col("iw")) & (F.col("oc") == F.col("ic") + shift))
                shift += shape[j][2]
            else:  # add, flatten: neuron by neuron
                joined = new.join(old, F.col("on") - base[k] == F.col("in") - base[j])
            one = joined.select(F.col("in").alias("source"), F.col("on").alias("dst"))
            edges = one if edges is None else edges.union(one)
    if edges is None:
        edges = spark.createDataFrame([], "source long, dst long")
    return Hypergraph(spark.range(base[-1]).withColumnRenamed("id", "node"), edges.select(F.col("source").alias("he_id"), "source", "dst", F.lit(1.0).alias("weight")))
