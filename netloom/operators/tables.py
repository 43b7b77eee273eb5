"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where all tasks run in this process, a folder of its own is made if it is unset; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settled(df: DataFrame, name: str = "loop") -> DataFrame:
    """df computed once: written as Parquet in the shared folder and read again, which cuts the lineage of loops and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cores(master: str, given: str | None) -> int:
    """The cores of an executor; 1 where they can't be known, or where all tasks run in one process."""
    if master.startswith("local-cluster["):
        return int(master.split(",")[1])
    return int(given or 1) if not master.startswith("local") else 1


def one_an_executor(spark: SparkSession) -> ResourceProfile | None:
    """For tasks that each hold a whole hypergraph: a profile by which a task takes all cores of an executor, so that no two share its memory."""
    n = cores(spark.sparkContext.master, spark.conf.get("spark.executor.cores", None))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(n)).build if n > 1 else None


def columns(batches: Iterable[pa.RecordBatch], names: tuple[str, ...], node: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """For kernels that hold a table in one task: the nodes, which are the rows with nothing but `node`, and the named columns of the other rows, as arrays."""
    nodes, rest = [], [[] for _ in names]
    for batch in batches:
        alone = batch.column(names[0]).is_null().to_numpy(zero_copy_only=False)
        nodes.append(batch.column(node).to_numpy(zero_copy_only=False)[alone])
        for name, to in zip(names, rest, strict=True):
            to.append(batch.column(name).filter(pa.array(~alone)).to_numpy(zero_copy_only=False))
    return np.concatenate(nodes) if nodes else np.zeros(0, "int64"), [joined(c) for c in rest]


def joined(chunks: list[np.ndarray]) -> np.ndarray:
    """One array, whose chunks are given up on the way."""
    if not chunks:
        return np.zeros(0)
    out, at = np.empty(sum(map(len, chunks)), chunks[0].dtype), 0
    chunks.reverse()
    while chunks:
        c = chunks.pop()
        out[at : at + len(c)] = c
        at += len(c)
    return out
