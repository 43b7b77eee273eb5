"""Shared helpers: Arrow string columns as numpy bytes, word hashes, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import settled

#: Bytes of text that one numpy step works on; a longer single text makes a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch, at most. Texts are long, and a batch is held by Spark and by Python.
BATCH_ROWS = 1000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.Philox(key=20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = (int(_rng.integers(1 << 60, 1 << 61)) * 8 + 5) & 0xFFFFFFFFFFFFFFFF
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, parts: int):
    """crc32 of an id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % parts


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    return settled(df, name)


#: A key is heavy if it has more than this share of the rows; there are at most 1 / HEAVY heavy ones.
HEAVY = 0.001


def with_one(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows (a written table) joined with a table of one row a key, which says in `count` how many rows have that key.

    The rows of a heavy key aren't brought together: at most 1 / HEAVY keys can be heavy, at every size, so their part of
    the table is broadcast. Of the other keys none makes more than a task's fair share.
    """
    total = rows.count()
    table = written(table, "by_key")
    heavy = F.col(count) > max(1000, int(total * HEAVY))
    hot = F.broadcast(table.where(heavy).drop(count))
    light = rows.join(hot.select(key), key, "left_anti").join(table.where(~heavy).drop(count), key)
    return rows.join(hot, key).unionByName(light)


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + (1 << 17))
        with np.errstate(over="ignore"):
            have = np.full(size, np.uint64(base))
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size > 16 * STEP_BYTES:
            return have
        _powers[base] = have
    return have


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each word `[^\\x20\\x09-\\x0D]+`, and each row's first word (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    token = ~_WHITE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(token)
    before[0] = False
    before[1:] = token[:-1]
    before[edge] = False
    starts = np.flatnonzero(token & ~before)
    after = np.empty_like(token)
    after[-1] = False
    after[:-1] = token[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(token & ~after) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, len(data))[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_BASE_INV, len(data))[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, and the offset of each row's run list. A row of fewer words gives its whole sequence as one; a row without words gives none."""
    n = len(hashes)
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    offsets = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=offsets[1:])
    if not n:
        return np.zeros(0, np.uint64), offsets
    odd = [np.uint64(pow(_BASE, k + 2, 1 << 64) | 1) for k in range(size)]
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        whole += hashes[k : n - size + 1 + k] * odd[k]
    keep = np.ones(len(whole), bool)
    for d in np.flatnonzero(count < size) if size > 1 else ():
        keep[max(0, first[d] - size + 1) : first[d + 1]] = False
    for k in range(1, size):  # runs that would cross into the next row
        at = first[1:] - k
        at = at[(at >= 0) & (at < len(whole))]
        keep[at] = False
    out = np.empty(offsets[-1], np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    mask = np.ones(len(out), bool)
    mask[offsets[short]] = False
    out[mask] = whole[keep]
    for d in short:
        value = np.uint64(count[d])
        for k, h in enumerate(hashes[first[d] : first[d + 1]]):
            value = np.uint64((int(value) + int(h) * int(odd[k])) & 0xFFFFFFFFFFFFFFFF)
        out[offsets[d]] = value
    return mix(out), offsets
