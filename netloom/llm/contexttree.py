"""Language-model scores by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions. Each of the 255 decision nodes has a context tree over the DEPTH bytes
before; each tree node counts zeros and ones and has their Krichevsky-Trofimov probability; a node's weighted probability
is the mean of that and of the product of its children's. Predictions mix the estimates of all depths by those weights.
The counts are those of the training documents and stay fixed while texts are scored, which gives a code length for each
byte; the score of a text is the sum, with an end mark, as a logarithm to base 10.

No task ever holds the model. Texts are read in blocks. Each block sends its distinct byte (DEPTH + 1)-grams and words,
with their training counts, to the parts that the two latest context bytes, or the word's hash, name. A part adds them up,
weighs its subtrees, and sends to each block the probabilities of the block's own n-grams, and the counts of its words.
The two upper levels of the tree, at most 256 contexts of 255 nodes, pass through the driver. What is gathered and sent
grows with the blocks, so with the corpus; each task's memory is bounded by a block and a part.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, steps, written

DEPTH = 4
#: Bytes of text of which one block holds the distinct n-grams and words.
BLOCK_BYTES = 96 << 20
START, END = 0x00, 0xFF
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes and end marks with their contexts, latest context byte first, the byte last; and each text's offset."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1) * (DEPTH + 1)  # DEPTH start marks before each text, an end mark after it
    padded = np.full(at[-1], START, np.uint8)
    padded[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], np.diff(offsets)) + DEPTH] = data
    padded[at[1:] - 1] = END
    x, m = padded.astype(_U), at[-1] - DEPTH
    key = np.zeros(m, _U)
    for k in range(1, DEPTH + 1):
        key = (key << _U(8)) | x[DEPTH - k : DEPTH - k + m]
    key = (key << _U(8)) | x[DEPTH:]
    coded = np.ones(m, bool)
    for k in range(1, DEPTH + 1):  # the start marks of the next text aren't coded
        coded[at[1:-1] - k] = False
    return key[coded], offsets + np.arange(n + 1)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _distinct(key: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, np.zeros(0, np.int64)
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.concatenate([first, [len(key)]])) * train


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(7):
        small = x < 7
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The decision nodes of all contexts of one depth: node (context * 256 + prefix of the byte), zeros, ones."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> None:
        nodes, zeros, ones = [], [], []
        for k in range(8):
            node = (context << _U(8)) | (_U(1 << k) | (byte >> _U(8 - k)))
            bit = (byte >> _U(7 - k)) & _U(1)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            nodes.append(node[first])
            ones.append(np.add.reduceat(count * (bit == 1), first) if len(first) else np.zeros(0, np.int64))
            zeros.append(np.add.reduceat(count * (bit == 0), first) if len(first) else np.zeros(0, np.int64))
        node = np.concatenate(nodes)
        order = np.argsort(node)
        self.node, self.zeros, self.ones = node[order], np.concatenate(zeros)[order].astype(np.float64), np.concatenate(ones)[order].astype(np.float64)
        self.own = estimate(self.zeros, self.ones)
        self.weighted = self.own
        self.share = np.ones(len(self.node))

    def weigh(self, below: np.ndarray) -> None:
        """below: of each node the sum of the children's weighted log probabilities."""
        self.weighted = np.logaddexp(self.own, below) - np.log(2)
        self.share = 1 / (1 + np.exp(np.clip(below - self.own, -700, 700)))


def levels(key: np.ndarray, count: np.ndarray, least: int) -> list[Level]:
    """The weighted levels from depth `least` to DEPTH of a part's subtrees."""
    out: list[Level] = []
    for depth in range(DEPTH, least - 1, -1):
        short = ((key >> _U(8 * (DEPTH - depth + 1))) << _U(8)) | (key & _U(255))
        k, n = added([short], [count])
        level = Level(k >> _U(8), k & _U(255), n)
        if out:
            up = ((out[-1].node >> _U(16)) << _U(8)) | (out[-1].node & _U(255))
            level.weigh(np.bincount(np.searchsorted(level.node, up), out[-1].weighted, len(level.node)))
        out.append(level)
    return out[::-1]


def predicted(key: np.ndarray, tree: list[Level], least: int) -> np.ndarray:
    """Log10 probability of each key's byte; tree: levels from depth 0."""
    total, byte = np.zeros(len(key)), key & _U(255)
    for k in range(8):
        prefix, bit = _U(1 << k) | (byte >> _U(8 - k)), ((byte >> _U(7 - k)) & _U(1)).astype(bool)
        p = None
        for depth in range(DEPTH, -1, -1):
            level = tree[depth]
            at = np.searchsorted(level.node, ((key >> _U(8 * (DEPTH - depth + 1))) << _U(8)) | prefix)
            own = (np.where(bit, level.ones[at], level.zeros[at]) + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            p = own if p is None else level.share[at] * own + (1 - level.share[at]) * p
        total += np.log10(p)
    return total


class Table:
    """Values by 64-bit keys, in open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, ~_U(0)), np.zeros(1 << self.bits)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] == ~_U(0)
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        slot = self.slot(keys)
        out, todo = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[todo] = self.values[slot]
            wrong = self.keys[slot] != keys[todo]
            todo, slot = todo[wrong], slot[wrong]
        return out


#: Rows of the block table: kind 0 packed n-grams, 1 packed words, 2 documents.
BLOCKS = "kind int, block long, part int, keys binary, counts binary, doc_id long, held_out boolean, train boolean, text string"


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    def cut(batches):
        context, number, size = TaskContext.get(), 0, 0
        key, count, vocabulary, trained = [], [], Counter(), Counter()
        names = ["kind", "block", "part", "keys", "counts", "doc_id", "held_out", "train", "text"]

        def block() -> int:
            return (context.partitionId() << 24) + number

        def packed():
            k, n = added(key, count)
            part = ((k >> _U(8 * (DEPTH - 1))) * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(parts)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            lists: list[list[bytes]] = [[] for _ in range(parts)]
            for w in vocabulary.keys() | trained.keys():
                lists[zlib.crc32(w) % parts].append(w)
            rows = [(0, p, k[order[a:z]].tobytes(), n[order[a:z]].astype(np.int64).tobytes()) for p, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if z > a]
            rows += [(1, p, b" ".join(ws), np.array([trained[w] for w in ws], np.int64).tobytes()) for p, ws in enumerate(lists) if ws]
            m = len(rows)
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([block()] * m, pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.string())], names=names)

        for b in batches:
            train_all = np.array(b.column(2).to_pylist(), bool)
            for first, end, data, offsets in steps(b.column(3)):
                if size > BLOCK_BYTES:
                    yield packed()
                    key, count, vocabulary, trained, size, number = [], [], Counter(), Counter(), 0, number + 1
                size += len(data)
                g, at = grams(data, offsets)
                train = train_all[first:end]
                of = np.repeat(train, np.diff(at))
                new = [_distinct(g[of], True), _distinct(g[~of], False)]
                merged = added([*key, *(x[0] for x in new if len(x[0]))], [*count, *(x[1] for x in new if len(x[0]))])
                key, count = [merged[0]], [merged[1]]
                raw = data.tobytes().lower()
                for d in range(end - first):
                    (trained if train[d] else vocabulary).update(raw[offsets[d] : offsets[d + 1]].split())
                m = end - first
                own = b.slice(first, m)
                yield pa.RecordBatch.from_arrays([pa.array([2] * m, pa.int32()), pa.array([block()] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), *own.columns], names=names)
        if key:
            yield packed()

    return written(docs.mapInArrow(cut, BLOCKS), "blocks")


def _parts(rows: DataFrame, function, schema: str) -> DataFrame:
    """Runs function(part, rows as (order, block, keys, counts)) on each part's rows, which come in order."""

    def run(batches):
        now, held = None, []
        for b in batches:
            part, order, block = (b.column(k).to_pylist() for k in range(3))
            for k in range(b.num_rows):
                if part[k] != now:
                    if held:
                        yield from function(now, held)
                    now, held = part[k], []
                held.append((order[k], block[k], b.column(3)[k].as_py(), b.column(4)[k].as_py()))
        if held:
            yield from function(now, held)

    return rows.repartition("part").sortWithinPartitions("part", "first").mapInArrow(run, schema)


def _gram_totals(part, rows):
    key, count = None, None
    for _, _, k, n in rows:
        k, n = np.frombuffer(k, _U), np.frombuffer(n, np.int64)
        key, count = (k, n) if key is None else added([key, k], [count, n])
    top = levels(key, count, 2)[0]
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * 2, *[pa.nulls(1, pa.float64())] * 3], names=_TOTAL_NAMES)
    m = len(top.node)
    yield pa.RecordBatch.from_arrays(
        [pa.array([1] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array((top.node >> _U(16)).astype(np.int64)), pa.array((top.node & _U(255)).astype(np.int64)), pa.array(top.zeros), pa.array(top.ones), pa.array(top.weighted)], names=_TOTAL_NAMES
    )


_TOTALS = "kind int, part int, keys binary, counts binary, context long, prefix long, zeros double, ones double, weighted double"
_TOTAL_NAMES = [x.split()[0] for x in _TOTALS.split(", ")]
_ANSWERS = "kind int, block long, keys binary, values binary"


def _answer(kind, rows):
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "block", "keys", "values"])


def _words_answered(part, rows):
    total = Counter()
    for _, _, ws, n in rows:
        for w, c in zip(ws.split(b" "), np.frombuffer(n, np.int64).tolist(), strict=True):
            total[w] += c
    known = [c for c in total.values() if c]
    yield _answer(3, [(-1, b"", np.array([len(known), sum(known)], np.int64).tobytes())])
    for _, block, ws, _ in rows:
        yield _answer(1, [(block, ws, np.array([total[w] for w in ws.split(b" ")], np.int64).tobytes())])


def _upper(totals: DataFrame) -> list[Level]:
    """Levels 0 and 1, from the sums over the contexts of depth 2."""
    rows = totals.where("kind = 1").groupBy("context", "prefix").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()  # at most 256 * 255 rows
    rows.sort(key=lambda r: (r[0], r[1]))

    def level(node, zeros, ones, below) -> Level:
        out = Level(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
        out.node, out.zeros, out.ones = node.astype(_U), zeros, ones
        out.own = estimate(zeros, ones)
        out.weigh(below)
        return out

    a = np.array([tuple(r) for r in rows], np.float64).reshape(-1, 5)
    one = level(a[:, 0].astype(np.int64) * 256 + a[:, 1].astype(np.int64), a[:, 2], a[:, 3], a[:, 4])
    prefix = a[:, 1].astype(np.int64)
    seen = np.unique(prefix)
    sums = [np.bincount(prefix, x, 256)[seen] for x in (a[:, 2], a[:, 3], one.weighted)]
    return [level(seen, *sums), one]


def scored(docs: DataFrame, id_column: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes and bits_per_byte.

    Rows whose crc32(id) mod folds is not 0 train; a null id is in neither part. A null text is the empty text: one token,
    the end, and one coded mark. Repeated rows count as often as they occur and get equal scores. An empty table gives an
    empty result, and without training rows every byte costs eight bits. Only id and text are read.
    """
    held = fold(id_column, folds) == 0
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(~held, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = min(4096, max(64, base.rdd.getNumPartitions()))
    blocks = _blocks(base, parts)
    packed = blocks.select("part", F.lit(1).alias("first"), "block", "keys", "counts", "kind")
    grams_sent, words_sent = packed.where("kind = 0").drop("kind"), packed.where("kind = 1").drop("kind")
    totals = written(_parts(grams_sent, _gram_totals, _TOTALS), "totals")
    upper = _upper(totals)

    def answer(part, rows):
        key, count = np.frombuffer(rows[0][2], _U), np.frombuffer(rows[0][3], np.int64)
        values = predicted(key, [*upper, *levels(key, count, 2)], 2)
        for _, block, k, _ in rows[1:]:
            yield _answer(0, [(block, k, values[np.searchsorted(key, np.frombuffer(k, _U))].tobytes())])

    model = totals.where("kind = 0").select("part", F.lit(0).alias("first"), F.lit(0).cast("long").alias("block"), "keys", "counts")
    answers = written(_parts(model.union(grams_sent), answer, _ANSWERS).union(_parts(words_sent, _words_answered, _ANSWERS)), "answers")
    sums = [np.frombuffer(r[0], np.int64) for r in answers.where("kind = 3").select("values").collect()]  # one row a part
    trained = blocks.where("kind = 2 AND train").count()
    distinct, tokens = int(sum(s[0] for s in sums)) + (trained > 0), int(sum(s[1] for s in sums)) + trained
    spread = tokens + 0.1 * (distinct + 1)
    told = answers.where("kind < 2").select("block", "kind", "keys", "values", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    read = blocks.where("kind = 2").select("block", "kind", "keys", F.col("counts").alias("values"), "doc_id", "held_out", "text")

    def score(batches):
        now, key, value, table, cost = None, [], [], None, {}
        none = float(np.log10(0.1 / spread))
        end_cost = float(np.log10((trained + 0.1) / spread))
        for b in batches:
            block, kind = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.int32)
            at = 0
            while at < len(kind):
                if block[at] != now:
                    now, key, value, table, cost = block[at], [], [], None, {}
                if kind[at] == 0:
                    key.append(np.frombuffer(b.column(2)[at].as_py(), _U))
                    value.append(np.frombuffer(b.column(3)[at].as_py()))
                    at += 1
                    continue
                if kind[at] == 1:
                    c = np.frombuffer(b.column(3)[at].as_py(), np.int64)
                    cost.update(zip(b.column(2)[at].as_py().split(b" "), np.where(c, np.log10((c + 0.1) / spread), none).tolist(), strict=True))
                    at += 1
                    continue
                if table is None:
                    table = Table(np.concatenate(key), np.concatenate(value))
                    key = value = []
                stop = at
                while stop < len(kind) and block[stop] == now:
                    stop += 1
                for first, end, data, offsets in steps(b.column(6).slice(at, stop - at)):
                    g, edge = grams(data, offsets)
                    total = np.add.reduceat(table[g], edge[:-1])
                    raw = data.tobytes().lower()
                    tokens_of, known, base_score = [], [], []
                    for d in range(end - first):
                        costs = list(map(cost.__getitem__, raw[offsets[d] : offsets[d + 1]].split()))
                        tokens_of.append(len(costs) + 1)
                        known.append(len(costs) - costs.count(none) + (trained > 0))
                        base_score.append(sum(costs) + end_cost)
                    m, own = end - first, b.slice(at + first, end - first)
                    size = np.diff(edge)
                    columns = [own.column(4), own.column(5), pa.array(tokens_of, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * m, pa.int64()), pa.array(base_score, pa.float64()), pa.array(total), pa.array(size - 1), pa.array(-total / np.log10(2) / size)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bytes", "bits_per_byte"])
                at = stop

    schema = f"{id_column} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long, bits_per_byte double"
    out = told.union(read).repartition("block").sortWithinPartitions("block", "kind")
    return out.mapInArrow(score, schema.replace(f"{id_column} ", "doc_id ", 1)).withColumnRenamed("doc_id", id_column)
