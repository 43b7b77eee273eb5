"""Jaccard self-join of documents by their word n-grams, with partitions of the universe.

Documents with equal sets make a class; classes are joined. Sizes are dealt into bands. In a band the universe of n-grams
is split by hash into as many segments as two linked sets of the band may differ in elements, and one more. By the
pigeonhole principle, two linked sets are equal in a segment; and if one segment may differ by one element, one equal
segment less needs to be looked up. So each set indexes the hash of its part of every segment, and for the first NEAR
segments also those of its one-deletion neighbourhood; and it looks up a choice of segments, allocated by cost: the numbers
of index entries, counted over all documents in a sketch of fixed size, that share a counter with the entry. Costs steer the
choice only, any choice finds all links. Candidates are verified exactly on the sets of
64-bit n-gram hashes: two n-grams count as equal if their hashes are.

Sets that share an index entry make a bucket. Of a small bucket (BUCKET at most) all pairs are candidates. In a large one
all members are compared with its least member first; then those that are in different components still are matched
within the bucket, block by block. An entry that the sketch shows to be frequent is split: its members are dealt into
buckets of their own, whose least members are compared with the least of all. No text is fetched for pairs that a parity sketch rules out: each element flips one of PARITY bits of
its set, so that the sketches of two sets differ in no more bits than the sets differ in elements. That bound is exact,
it never rules out a link, and it holds as a join condition, so that a group of thousands of near copies makes few rows.

Components need only as many links as connect them. All links lie within components, so the join is completed there: two
classes that make a component are linked; the classes of a larger one are dealt into blocks, and each pair of blocks is
compared in full, on the sets themselves. That is quadratic in the classes of a component, as its links may be.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, shingles, steps, with_one, words, written
from .components import components

COUNTERS = 1 << 16
BUCKET = 5
#: Members that are compared with one pivot in one run.
RUN = 256
#: Classes and n-grams of a block, about, and columns of an incidence matrix, when the links of a component are completed.
BLOCK, BLOCK_GRAMS, WIDTH = 256, 1_000_000, 4096
#: Bits of a parity sketch.
PARITY = 1024
INDEX, PROBE = 1, 2
#: Segments of a band whose one-deletion neighbourhoods are indexed. Each adds about as many entries to a set's index as a segment has elements.
NEAR = 2
#: An entry is split if its counter shows more than SPLIT times the mean. Members of a bucket that are in a block when what a large one leaves is compared.
SPLIT, MEMBERS = 4, 1000
_SPREAD, _NEAR = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


class Scheme:
    """Bands of sizes and their segments for a similarity of percent / 100."""

    def __init__(self, percent: int) -> None:
        self.percent, self.edges = percent, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * (100 / percent) ** 2)))

    def differ(self, a: int, b: int) -> int:
        """In how many elements sets of these sizes may differ if they are linked, at most."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def band(self, n: int) -> int:
        return bisect_right(self.edges, n) - 1

    def last(self, band: int) -> int:
        return self.edges[band + 1] - 1

    def segments(self, band: int) -> int:
        last = self.last(band)
        return self.differ(last, last) + 1

    def parts(self, s: np.ndarray, band: int):
        """Of a set the entry of each segment, and for each segment with one-deletion neighbourhoods: its entry as a near one, and its entries without one element, plain and near."""
        m = self.segments(band)
        base = (np.arange(m, dtype=np.uint64) + np.uint64(band << 32)) * np.uint64(_SPREAD)
        if m == 1:
            return mix(np.array([s.sum(dtype=np.uint64)]) + base), []
        segment = ((s >> np.uint64(17)) % np.uint64(m)).astype(np.int64)
        high = np.bincount(segment, (s >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
        low = np.bincount(segment, (s & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
        total = (high << np.uint64(32)) + low
        around = []
        for q in range(min(NEAR, m)):
            without = total[q] - s[segment == q] + base[q]
            around.append((mix(total[q : q + 1] + base[q : q + 1] + _NEAR), mix(without), mix(without + _NEAR)))
        return mix(total + base), around

    def allocated(self, costs: np.ndarray, near: list[float], units: int) -> tuple[np.ndarray, tuple[int, ...]]:
        """The segments to look up exactly, and those to look up with one difference as well, which count twice: the cheapest choice that counts `units` (or all)."""
        m = len(costs)
        best = None
        for chosen in (c for k in range(len(near) + 1) for c in combinations(range(len(near)), k)):
            if chosen and 2 * len(chosen) > max(units, 2):
                continue
            rest = np.delete(np.arange(m), chosen)
            need = min(max(0, units - 2 * len(chosen)), len(rest))
            rest = rest[np.argpartition(costs[rest], need - 1)[:need]] if 0 < need < len(rest) else rest[:need]
            price = costs[rest].sum() + sum(costs[q] + near[q] for q in chosen)
            if best is None or price < best[0]:
                best = price, rest, chosen
        return best[1], best[2]

    def entries(self, s: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Entries and roles of a set; with no counts, those that it indexes."""
        n, out, roles = len(s), [], []
        own, most = self.band(n), self.largest(n)
        exact, around = self.parts(s, own)
        if counts is None:
            return np.concatenate([exact, *(x[2] for x in around)]), None
        for band in range(own, self.band(most) + 1):
            if band > own:
                exact, around = self.parts(s, band)
            cost = lambda x: counts[x >> np.uint64(48)] + 1.0
            chosen, nearly = self.allocated(cost(exact), [cost(x[0]).sum() + cost(x[1]).sum() for x in around], self.differ(n, min(most, self.last(band))) + 1)
            role = np.zeros(len(exact), np.int8)
            role[chosen] = PROBE
            role[list(nearly)] = PROBE
            if band == own:
                role |= INDEX
                for _, _, less_near in around:
                    out.append(less_near)
                    roles.append(np.full(len(less_near), INDEX, np.int8))
            out.append(exact[role > 0])
            roles.append(role[role > 0])
            for q in nearly:
                out += around[q][:2]
                roles.append(np.full(1 + len(around[q][1]), PROBE, np.int8))
        return np.concatenate(out), np.concatenate(roles)


def shingle_sets(texts: pa.Array, size: int):
    """Sorted distinct n-gram hashes of each text."""
    for first, end, data, offsets in steps(texts):
        hashes, _, _, at = words(data, offsets)
        found, edge = shingles(hashes, at, size)
        for d in range(end - first):
            yield np.unique(found[edge[d] : edge[d + 1]])


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of `bits` (a power of two) classes of the universe holds an odd number of elements, packed into 64-bit integers. Half as many classes have the exclusive or of both halves."""
    return np.packbits((np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).view("<i8")


def described(docs: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """id, n, h1 and h2 (hashes of the set), parity (its sketch) and, of sets with more elements than that has bits, more (one of a bit an element) of each row, and rows with known false and `counts`, a task's counts of index entries."""

    def describe(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["known", "id", "n", "h1", "h2", "parity", "more", "counts"]
        longs = PARITY // 64
        for b in batches:
            n, h1, h2, parity, more = [], [], [], [], []
            for s in shingle_sets(b.column(1), size):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64)))
                h2.append(int(mix(s ^ _NEAR).sum(dtype=np.uint64)))
                parity.append(parities(s, PARITY))
                more.append(parities(s, 1 << (len(s) - 1).bit_length()).tolist() if len(s) > PARITY else None)
                if len(s):
                    np.add.at(counts, (scheme.entries(s, None)[0] >> np.uint64(48)).astype(np.int64), 1)
            hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * longs), pa.array(np.concatenate([*parity, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), b.column(0), pa.array(np.array(n, np.int64)), *hashes, sketches, pa.array(more, pa.list_(pa.int64())), pa.nulls(len(n), pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([None], pa.int64()), *[pa.array([0])] * 3, *[pa.nulls(1, pa.list_(pa.int64()))] * 2, pa.array([counts.tobytes()], pa.binary())], names=names)

    return written(docs.mapInArrow(describe, "known boolean, id long, n long, h1 long, h2 long, parity array<long>, more array<long>, counts binary"), "sets")


def counted(sets: DataFrame) -> np.ndarray:
    """The counters of all tasks together. Sixteen arrays of fixed size come to the driver."""

    def add(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    rows = sets.where("NOT known").select("counts").coalesce(16).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(COUNTERS, np.int64))


def candidates(docs: DataFrame, size: int, scheme: Scheme, counts: np.ndarray) -> DataFrame:
    """From small buckets pairs (a, b) of ids; from large ones (entry, pivot a, member b, n, role). The pivot is the member with the least id: what others were copied from is likely older."""
    # buckets that an entry is dealt into, by its counter; at most 1 / SPLIT of the counters have more than one
    split = np.ceil(counts / max(1.0, SPLIT * counts.mean())).clip(1).astype(np.int64)

    def index(batches):
        for b in batches:
            keys, n, entries, roles, salts = [], [], [], [], []
            ids = b.column(0).to_pylist()
            for k, s in enumerate(shingle_sets(b.column(1), size)):
                if len(s):
                    e, r = scheme.entries(s, counts)
                    parts = split[(e >> np.uint64(48)).astype(np.int64)]
                    keys.append(ids[k])
                    n.append(len(s))
                    entries.append(e.view(np.int64))
                    roles.append(r)
                    own = int(mix(np.array([ids[k]], np.int64).view(np.uint64))[0] >> np.uint64(1))
                    salts.append(np.where(parts > 1, own % parts, -1).astype(np.int32))
                if len(keys) >= 1000:
                    yield pack(keys, n, entries, roles, salts)
                    keys, n, entries, roles, salts = [], [], [], [], []
            if keys:
                yield pack(keys, n, entries, roles, salts)

    def pack(keys, n, entries, roles, salts):
        edge = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate(x))) for x in (entries, roles, salts)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(n, np.int32)), *lists], names=["b", "n", "entries", "roles", "salts"])

    rows = docs.select("id", "text").mapInArrow(index, "b long, n int, entries array<long>, roles array<tinyint>, salts array<int>")
    rows = rows.select("b", "n", F.explode(F.arrays_zip("entries", "roles", "salts")).alias("e")).select("b", "n", F.col("e.entries").alias("entry"), F.col("e.roles").alias("role"), F.col("e.salts").alias("salt"))
    group, order = Window.partitionBy("entry", "salt"), Window.partitionBy("entry", "salt").orderBy("b")
    before = [F.lag(F.struct("b", "n", "role"), k).over(order) for k in range(1, BUCKET)]
    # salt is -1 where an entry isn't split
    found = rows.select("*", F.count(F.lit(1)).over(group).alias("members"), F.first(F.struct("b", "n")).over(order).alias("pivot"), F.array(*before).alias("before")).where("members > 1 OR salt >= 0")
    fits = f"x.b <> b AND greatest(x.n, n) * {scheme.percent} <= 100 * least(x.n, n)"
    small = f"members <= {BUCKET} AND salt < 0"
    ends = f"IF({small}, filter(before, x -> x IS NOT NULL AND {fits} AND x.role | role = 3), IF(pivot.b = b AND salt < 0, CAST(array() AS ARRAY<STRUCT<b: BIGINT, n: INT, role: TINYINT>>), array(struct(pivot.b, pivot.n, role))))"
    found = found.select(F.when(~F.expr(small), F.col("entry")).alias("entry"), "b", "n", "role", F.explode(F.expr(ends)).alias("x"))
    out = written(found.select("entry", F.col("x.b").alias("a"), "b", "n", F.col("x.n").alias("pivot_n"), "role"), "candidates")
    # the pivots of a split entry's buckets, which are their own pivots so far, and the least of them
    pivots = out.where("entry IS NOT NULL AND a = b")
    least = pivots.groupBy("entry").agg(F.min(F.struct("b", "n")).alias("p"))
    return out.where("entry IS NULL OR a <> b").union(pivots.join(least, "entry").where("b <> p.b").select("entry", F.col("p.b").alias("a"), "b", "n", F.col("p.n").alias("pivot_n"), "role"))


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones among pairs (a, b) of ids. A pivot's members are dealt into runs of about RUN; texts are fetched by id."""
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    asked = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), "runs").alias("run"), "b")
    asked = asked.select("a", "run", F.col("b").alias("id"), F.lit(False).alias("pivot")).union(asked.select("a", "run", F.col("a").alias("id"), F.lit(True)).distinct())
    # what is asked for grows with the input, so it is never broadcast: the plan is alike at every size
    told = docs.select("id", "text").hint("merge").join(asked, "id").select("a", "run", "id", "pivot", "text").repartition("a", "run").sortWithinPartitions("a", "run", F.desc("pivot"))

    def verify(batches):
        key, own = None, None
        for b in batches:
            a, run, ids, pivot = (b.column(k).to_pylist() for k in range(4))
            linked = []
            for k, s in enumerate(shingle_sets(b.column(4), size)):
                if pivot[k]:
                    key, own = (a[k], run[k]), s
                elif key == (a[k], run[k]) and len(s):
                    place = np.minimum(np.searchsorted(own, s), len(own) - 1) if len(own) else None
                    both = int((own[place] == s).sum()) if len(own) else 0
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        linked.append((a[k], ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], names=["a", "b"])

    return told.select("a", "run", "id", "pivot", "text").mapInArrow(verify, "a long, b long")


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x has in common with each of y."""
    out = np.zeros((len(x), len(y)))
    flat = [np.concatenate(k) for k in (x, y)]
    both = np.intersect1d(*flat)
    rows = [np.repeat(np.arange(len(k)), [len(s) for s in k]) for k in (x, y)]
    places = []
    for k, r in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(both, k), max(0, len(both) - 1))
        known = both[at] == k if len(both) else np.zeros(len(k), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], r[known][order]))
    for low in range(0, len(both), WIDTH):
        wide = min(WIDTH, len(both) - low)
        sides = []
        for (at, r), n in zip(places, (len(x), len(y)), strict=True):
            a, b = np.searchsorted(at, [low, low + wide])
            m = np.zeros((n, wide), np.float32)
            m[r[a:b], at[a:b] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def completed(joined: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, links): parts of the numbers of links of classes' representatives, from their components (id, component) and numbers of n-grams (id, n). Links are counted where they are found, for each pair of blocks, so that rows don't grow as the links do."""
    groups = joined.join(classes, "id").groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams"), F.min("id").alias("a"), F.max("id").alias("b"))
    groups = written(groups, "groups")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS))
    dealt = joined.join(groups.where("k > 2").select("component", blocks.alias("blocks")), "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    told = docs.select("id", "text").hint("merge").join(dealt, "id").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    told = told.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "text")
    told = told.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "block", "id")

    def links(key, ids, sets):
        """How many links each member has in one pair of blocks, or within one block."""
        x, y = ids[key[1]], ids[key[2]] if key[1] != key[2] else ids[key[1]]
        if not x or not y:
            return None
        p, q = sets[key[1]], sets[key[2]]
        both = shared(p, q)
        n, m = (np.array([len(s) for s in k]) for k in (p, q))
        found = 100 * both >= percent * (n[:, None] + m[None, :] - both)
        if key[1] == key[2]:
            np.fill_diagonal(found, False)
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)), pa.array(found.sum(axis=1, dtype=np.int64))], names=["id", "links"])
        return pa.RecordBatch.from_arrays([pa.array(np.array([*x, *y], np.int64)), pa.array(np.concatenate([found.sum(axis=1, dtype=np.int64), found.sum(axis=0, dtype=np.int64)]))], names=["id", "links"])

    def complete(batches):
        key, ids, sets = None, {}, {}
        for b in batches:
            component, low, high, block, own = (b.column(k).to_pylist() for k in range(5))
            for k, s in enumerate(shingle_sets(b.column(5), size)):
                if key != (component[k], low[k], high[k]):
                    if key is not None and (out := links(key, ids, sets)) is not None:
                        yield out
                    key = (component[k], low[k], high[k])
                    ids, sets = {low[k]: [], high[k]: []}, {low[k]: [], high[k]: []}
                if not ids[block[k]] or ids[block[k]][-1] != own[k]:  # repeated rows are one document
                    ids[block[k]].append(own[k])
                    sets[block[k]].append(s)
        if key is not None and (out := links(key, ids, sets)) is not None:
            yield out

    pairs = groups.where("k = 2").select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("links"))
    return pairs.union(told.mapInArrow(complete, "id long, links long"))


def jaccard_classes(docs: DataFrame, id_column: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with an id (id, text), rows (id, n, rep, class_size and sketches), and the components (id, component) of linked representatives."""
    scheme = Scheme(percent)
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    known = base.where("id IS NOT NULL")
    sets = described(base, size, scheme)
    rows = sets.where("known").select("id", "n", "h1", "h2", F.struct(*[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY // 64)]).alias("parity"), "more")
    rows = rows.withColumn("key", F.struct("h1", "h2", "n")).drop("h1", "h2")
    full = "n > 0 AND id IS NOT NULL"
    classes = rows.where(full).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    classes = classes.withColumn("rows", F.col("class_size"))
    columns = ["id", "n", "parity", "more", "rep", "class_size"]
    others = rows.where(f"NOT ({full}) OR id IS NULL").select("id", "n", "parity", "more", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("class_size"))
    named = written(with_one(rows.where(full), classes, "key", "rows").select(*columns).union(others), "classes")
    of = named.where("rep IS NOT NULL").select("id", "rep", "n", "parity").distinct()
    found = candidates(known, size, scheme, counted(sets))
    apart = " + ".join(f"bit_count(x.parity.p{k} ^ y.parity.p{k})" for k in range(PARITY // 64))
    fits = f"greatest(x.n, y.n) * {percent} <= 100 * least(x.n, y.n) AND {apart} <= floor({100 - percent} * (x.n + y.n) / {100 + percent})"

    sketched = named.where("id = rep AND more IS NOT NULL").select("id", "n", "more").dropDuplicates(["id"])
    halved = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (p, q) -> p ^ q)"
    alike = lambda k, other: f"IF(size({k}.more) > size({other}.more), {halved.format(k + '.more')}, {k}.more)"
    further = f"aggregate(zip_with({alike('_a', '_b')}, {alike('_b', '_a')}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c) <= floor({100 - percent} * (_a.n + _b.n) / {100 + percent})"

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among pairs of representatives (a, b). Large sets' larger sketches are compared first."""
        side = lambda k: sketched.select(F.col("id").alias(k), F.struct("n", "more").alias(f"_{k}"))
        pairs = pairs.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").where(f"_a IS NULL OR _b IS NULL OR {further}").select("a", "b")
        return written(verified(written(pairs, "pairs"), known, size, percent), "links")

    first = found.select("a", "b").distinct().join(of.alias("x"), F.col("a") == F.col("x.id")).join(of.alias("y"), F.col("b") == F.col("y.id")).where("x.rep <> y.rep AND " + fits)
    links = compared(first.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")))
    joined = written(components(links), "components")
    # what large buckets leave: members, by their representatives, that are in different components still
    large = found.where("entry IS NOT NULL")
    large = large.select("entry", "b", "role").union(large.select("entry", F.col("a").alias("b"), F.lit(3).cast("tinyint")).distinct())
    large = large.join(of, F.col("b") == F.col("id")).groupBy("entry", F.col("rep").alias("b")).agg(F.bit_or("role").alias("role"))
    large = written(large.join(joined, F.col("b") == F.col("id"), "left").select("entry", "b", "role", F.coalesce("component", "b").alias("c")), "members")
    mixed = large.groupBy("entry").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("b").alias("p"), F.count(F.lit(1)).alias("rows")).where("low < high")
    mixed = mixed.select("entry", "p", F.ceil(F.col("rows") / MEMBERS).alias("blocks"), "rows")
    large = written(with_one(large, mixed, "entry", "rows").where("b > p").drop("p"), "large")  # the least member has been compared with all
    if not large.isEmpty():
        own = of.where("id = rep").select(F.col("id").alias("b"), "n", "parity")
        # each pair of blocks of an entry is a group of its own
        large = large.withColumn("block", F.pmod(F.xxhash64("b"), "blocks")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        large = large.select("entry", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "b", "role", "c").join(own, "b")
        met = "x.c <> y.c AND x.role | y.role = 3 AND (x.block < y.block OR x.block = y.block AND x.b < y.b) AND "
        pairs = large.alias("x").join(large.alias("y"), ["entry", "low", "high"]).where(met + fits)
        further_links = compared(pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")))
        joined = written(components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(further_links)), "components")
    return known, named, joined


def with_components(named: DataFrame, joined: DataFrame) -> DataFrame:
    parts = joined.select(F.col("id").alias("_rep"), "component")
    return named.join(parts, F.col("rep") == F.col("_rep"), "left").select("id", "n", "rep", F.coalesce("component", "rep", "id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (the smallest id that links reach, itself included) and class_size (rows with the same set).

    A null or empty text, or one of white space, has no n-grams and is linked with nothing; with fewer words than `size`
    the whole sequence is the only n-gram. Ids tell documents apart: repeated rows are one document. A null id has a null
    component and isn't linked. An empty table gives an empty result. Only id and text are read.
    """
    _, named, joined = jaccard_classes(docs, id_column, text, size, percent)
    return with_components(named, joined).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "class_size")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """The columns of jaccard_components, class_id (the smallest id with the same set; its own without n-grams) and n_links: how many other classes the row's class is linked with, none left out."""
    known, named, joined = jaccard_classes(docs, id_column, text, size, percent)
    classes = named.where("id = rep").select("id", "n").dropDuplicates(["id"])
    count = completed(joined, classes, known, size, percent).groupBy(F.col("id").alias("_end")).agg(F.sum("links").alias("n_links"))
    out = with_components(named, joined).join(count, F.col("rep") == F.col("_end"), "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "class_size", F.coalesce("rep", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with the smallest doc_id of each group of near copies only (repeated rows are one document); rows with a null id, which aren't linked, stay."""
    first = jaccard_components(docs.select("doc_id", "text"), size=size, percent=percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).union(docs.where("doc_id IS NULL"))
