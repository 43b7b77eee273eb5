"""Random hypergraphs. Each source draws from a generator of its own (seed, source), so that partitioning doesn't change the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph


def _generated(spark: SparkSession, n: int, seed: int, draw) -> Hypergraph:
    """draw(generator, source) -> destinations and weight."""

    def rows(batches):
        for b in batches:
            source, dst, weight = [], [], []
            for s in b.column(0).to_pylist():
                targets, w = draw(np.random.Generator(np.random.Philox(key=[seed, s])), s)
                targets = np.unique(np.asarray(targets, np.int64))
                targets = targets[(targets != s) & (targets >= 0) & (targets < n)]
                source.append(np.full(len(targets), s))
                dst.append(targets)
                weight.append(np.full(len(targets), float(w)))
            if source:
                s = pa.array(np.concatenate(source).astype(np.int64))
                yield pa.RecordBatch.from_arrays([s, s, pa.array(np.concatenate(dst)), pa.array(np.concatenate(weight))], names=["he_id", "source", "dst", "weight"])

    nodes = spark.range(n).select(F.col("id").alias("node"))
    return Hypergraph(nodes, nodes.mapInArrow(rows, "he_id long, source long, dst long, weight double"))


def random_graph(spark: SparkSession, n: int, fan_out: float, spread: float, low: float = 0.0, high: float = 1.0, seed: int = 192) -> Hypergraph:
    """Fan-outs from a normal distribution; targets near the source are likelier, those behind it a little more; weights from a scaled Beta(5, 2)."""

    def draw(rng, s):
        k = int(np.clip(int(rng.normal(fan_out, spread)), 1, n - 1))
        i = np.arange(n)
        p = np.exp(-np.abs(i - s) / (0.1 * n)) * (1 + 0.3 * np.tanh((i - s) / (0.05 * n)))
        p[s] = 0
        keys = np.full(n, -np.inf)
        keys[p > 0] = np.log(p[p > 0]) + rng.gumbel(size=int((p > 0).sum()))
        return np.argpartition(-keys, k - 1)[:k], low + (high - low) * rng.beta(5, 2)

    return _generated(spark, n, seed, draw)


def _lognormal(rng, median: float, cv: float) -> float:
    return float(rng.lognormal(np.log(median), np.sqrt(np.log(1 + cv * cv))))


def reservoir(spark: SparkSession, n: int, fan_out: float, dimensions: int = 2, reach: float = 0.1, far: float = 0.1, median: float = 1.0, cv: float = 1.58, seed: int = 192) -> Hypergraph:
    """Nodes on a ring or a grid; Poisson fan-outs; most targets from a Gaussian around the source, a share of `far` from anywhere; lognormal weights."""
    side = n if dimensions == 1 else int(np.ceil(n ** (1 / dimensions)))

    def draw(rng, s):
        k = min(n - 1, max(1, rng.poisson(fan_out)))
        local = rng.random(k) >= far
        own = np.array([(s // side**a) % side for a in range(dimensions)])
        at = np.rint(own + rng.normal(0, max(1.0, reach * side), (k, dimensions))).astype(int)
        at = at % side if dimensions == 1 else np.clip(at, 0, side - 1)
        near = (at * side ** np.arange(dimensions)).sum(axis=1)
        return np.where(local, near, rng.integers(0, n, k)), _lognormal(rng, median, cv)

    return _generated(spark, n, seed, draw)


def hierarchical(spark: SparkSession, n: int, fan_out: float, levels: int = 3, branch: int = 4, shortcuts: float = 0.05, median: float = 1.0, cv: float = 1.58, seed: int = 192) -> Hypergraph:
    """Nested modules of consecutive nodes: at each level a Poisson share of the targets lies in the source's module, near it; a few go anywhere."""

    def draw(rng, s):
        out = []
        for level in range(levels + 1):
            size = max(2, n // branch**level)
            k = rng.poisson(fan_out / (levels + 1) * (1.5 if level == levels else 1))
            out.append(s // size * size + (s % size + np.rint(rng.normal(0, size / 4, k)).astype(int)) % size)
        out.append(rng.integers(0, n, rng.binomial(int(fan_out), shortcuts)))
        return np.concatenate(out), _lognormal(rng, median, cv)

    return _generated(spark, n, seed, draw)
