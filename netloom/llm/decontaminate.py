"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased (A-Z) and split into words. A benchmark item and a document that share a seed, a run of MIN_MATCH
words, are compared by greedy string tiling: again and again the longest common runs of words that are not marked yet are
marked in both, found by Karp-Rabin fingerprints of a running length; matches shorter than MIN_MATCH don't count, but an
item of fewer words is matched whole. The
share of the item's words in tiles is its coverage, whatever the order of the tiles, so that reordered passages are
caught. A document is contaminated by an item whose coverage is at least COVERAGE.

The benchmark is the stated query set: it is taken in blocks of bounded size, each of which goes over all documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, steps, words, written

MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of benchmark text in a block; a longer single item makes a block of its own.
BLOCK_BYTES = 16 << 20
_PRIME, _RADIX = (1 << 61) - 1, 1_000_003


def _prints(seq: list[int], marked: list[bool], n: int):
    """(start, fingerprint) of each run of n unmarked words, the fingerprint rolled from run to run."""
    top = pow(_RADIX, n - 1, _PRIME)
    value = held = 0
    for k, x in enumerate(seq):
        if marked[k]:
            value = held = 0
            continue
        if held == n:
            value = (value - seq[k - n] * top) % _PRIME
            held -= 1
        value = (value * _RADIX + x) % _PRIME
        held += 1
        if held == n:
            yield k - n + 1, value


def tiles(item: list[int], doc: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of matches that don't overlap in either, longest first; of equal ones the earliest in the item, then in the document."""
    marked_a, marked_b, out = [False] * len(item), [False] * len(doc), []
    length = max(least, len(item) // 2)
    while True:
        table = defaultdict(list)
        for p, h in _prints(item, marked_a, length):
            table[h].append(p)
        found, best = [], length
        if table:
            for q, h in _prints(doc, marked_b, length):
                for p in table.get(h, ()):
                    if item[p : p + length] != doc[q : q + length]:
                        continue
                    n = length
                    while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and not marked_a[p + n] and not marked_b[q + n]:
                        n += 1
                    found.append((-n, p, q))
                    best = max(best, n)
        if best > 2 * length:
            length = best  # a long match: look for those of its length first
            continue
        for n, p, q in sorted(x for x in found if -x[0] == best):  # what they leave of shorter ones is found again
            if not any(marked_a[p : p - n]) and not any(marked_b[q : q - n]):
                marked_a[p : p - n] = marked_b[q : q - n] = [True] * -n
                out.append((p, q, -n))
        if not found:
            if length == least:
                return out
            length = max(least, length // 2)


def blocks(benchmark: DataFrame, most: int):
    """Lists of (item_id, text), of about `most` bytes together; one partition of the benchmark at a time comes to the driver."""
    out, size = [], 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        if out and size + len(row[1]) > most:
            yield out
            out, size = [], 0
        out.append((row[0], row[1]))
        size += len(row[1])
    if out:
        yield out


class Items:
    """A block of items: their word hashes, and their seeds by length: runs of `least` words, or an item of fewer words as a whole."""

    def __init__(self, rows: list[tuple[int, str]], least: int) -> None:
        self.least, self.ids, self.words, seeds = least, [], [], defaultdict(list)
        for item, text in sorted(set(rows)):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            hashes, _, _, first = words(data, np.array([0, len(data)]))
            if not len(hashes):
                continue
            n = min(least, len(hashes))
            found, _ = shingles(hashes, first, n)
            seeds[n].append((found, np.full(len(found), len(self.ids))))
            self.ids.append(item)
            self.words.append(hashes.tolist())
        self.seeds = {}
        for n, parts in seeds.items():
            found, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(found, kind="stable")
            some = np.zeros(1 << 22, bool)
            some[(found >> np.uint64(42)).astype(np.int64)] = True
            self.seeds[n] = found[order], owners[order].astype(np.int64), some


def matches(texts: pa.Array, items: Items):
    """(row, number of the item, tiles, the item's words) for each text and item that share a seed."""
    for at, _, data, offsets in steps(texts):
        hashes, _, _, first = words(data, offsets)
        pairs = set()
        for n, (seeds, owners, some) in items.seeds.items():
            if len(hashes) < n:
                continue
            found, edge = shingles(hashes, first, n)
            hits = np.flatnonzero(some[(found >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(seeds, found[hits], "left"), np.searchsorted(seeds, found[hits], "right")
            pairs |= {(int(d), int(o)) for d, a, z in zip(np.searchsorted(edge, hits, "right") - 1, low, high, strict=True) for o in owners[a:z]}
        for d, o in sorted(pairs):
            t = tiles(items.words[o], hashes[first[d] : first[d + 1]].tolist(), min(items.least, len(items.words[o])))
            if t:
                yield at + d, o, t, items.words[o]


def coverage(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, th, item_id, n_tiles, covered, item_words): for each document (id and hash of its text) and item that share a seed the words of the item in tiles."""
    out = None
    for rows in blocks(benchmark, block_bytes):
        items = Items(rows, least)

        def compare(batches, items=items):
            names = ["id", "th", "item_id", "n_tiles", "covered", "item_words"]
            for b in batches:
                result = [[] for _ in names]
                for d, o, t, item in matches(b.column(2), items):
                    for column, value in zip(result, (b.column(0)[d].as_py(), b.column(1)[d].as_py(), items.ids[o], len(t), sum(x[2] for x in t), len(item)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in result], names=names)

        found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(compare, "id long, th long, item_id long, n_tiles long, covered long, item_words long")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "id long, th long, item_id long, n_tiles long, covered long, item_words long")
    return out.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """docs with `items`, the sorted ids of the items that cover them, and `coverage`, the largest share of an item's words in tiles.

    A null or empty text, and one without a seed, has no items and coverage 0; so has every text if the benchmark is
    empty; items that are null or empty cover nothing, and one of fewer words than a match covers the texts that hold it
    whole; repeated items count once. A very long text makes a step of its own and is compared whole. Rows that repeat
    a document get equal results, null ids are handled like others. Columns of docs with the results' names are replaced,
    other extra columns stay.
    """
    docs = docs.drop("items", "coverage")
    found = written(coverage(docs, benchmark, least), "coverage")
    rate = F.col("covered") / F.col("item_words")
    of = found.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set(F.when(rate >= share, F.col("item_id")))).alias("_items"), F.max(rate).alias("_rate"))
    out = docs.withColumn("_own", F.xxhash64("text")).join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), "left")
    return out.select(*docs.columns, F.coalesce("_items", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("items"), F.coalesce("_rate", F.lit(0.0)).alias("coverage"))


def leaks_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items, coverage. Texts are read once and not moved."""
    found = written(coverage(docs, benchmark), "coverage")
    rate = F.col("covered") / F.col("item_words")
    of = found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.when(rate >= COVERAGE, F.col("item_id")))).alias("items"), F.max(rate).alias("rate"))
    thin = docs.select("doc_id", F.xxhash64("text").alias("own"))
    out = thin.join(of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("th")), "left").select("doc_id", F.coalesce("items", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("items"), F.coalesce("rate", F.lit(0.0)).alias("coverage"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", F.round("coverage", 6).alias("coverage"))


def leaks_filtered(docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """docs without the contaminated ones; each block of the benchmark is a filter over the rows, so nothing is moved."""
    at = docs.columns.index("text")
    for rows in blocks(benchmark, BLOCK_BYTES):
        items = Items(rows, least)

        def clean(batches, items=items):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for d, _, t, item in matches(b.column(at), items):
                    keep[d] &= sum(x[2] for x in t) < share * len(item)
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
