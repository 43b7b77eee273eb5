"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are runs of two to four bytes of a lower-cased word with its edges, hashed into buckets. A text's vector is the
mean of its subwords' embeddings; a linear layer and a softmax give the language. Both layers are trained together by
stochastic gradient descent in numpy, on a sample of labelled rows whose size is a parameter (`TRAIN_ROWS`, in all);
texts are used whole. A part of the sample is kept for calibration: it sets the softmax temperature and the score under
which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, steps, with_fields

#: Labelled rows to train and calibrate on, over all languages (about: rows are drawn by a hash of their id).
TRAIN_ROWS = 2400
BUCKETS = 1 << 14
WIDTH = 16
EPOCHS = 14
#: Of the calibration texts, the share that may fall under the rejection score; the score is at most REJECT_BELOW.
REJECT_SHARE, REJECT_BELOW = 0.002, 0.5

#: Byte to symbol: letters in lower case and parts of UTF-8 letters as they are, all else 0, the edge of a word.
SYMBOL = np.where(np.arange(256) >= 128, np.arange(256), np.where(((LOWER >= 97) & (LOWER <= 122)), LOWER, 0)).astype(np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 to 4: positions and buckets of the subwords. One with an edge inside doesn't count."""
    s = SYMBOL[data]
    cut = offsets[1:-1]
    out = []
    for n in (2, 3, 4):
        m = len(s) - n + 1
        if m <= 0:
            continue
        packed = np.zeros(m, np.uint32)
        good = np.ones(m, bool)
        for k in range(n):
            packed = (packed << np.uint32(8)) | s[k : m + k]
            if 0 < k < n - 1:
                good &= s[k : m + k] != 0
        if n == 2:
            good &= (s[:m] != 0) | (s[1 : m + 1] != 0)
        for k in range(1, n):  # not from one text into the next
            at = cut - k
            good[at[(at >= 0) & (at < m)]] = False
        place = np.flatnonzero(good)
        mixed = (packed[place] ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
        out.append((place, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(18)))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    at = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = at[offsets[1:]] > at[offsets[:-1]]
    for d in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def totals(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sum of its subwords' rows of `weights`, and the number of subwords."""
    total, count = np.zeros((len(offsets) - 1, weights.shape[1])), np.zeros(len(offsets) - 1)
    for place, bucket in subwords(data, offsets):
        edge = np.searchsorted(place, offsets)
        count += np.diff(edge)
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            for k in range(weights.shape[1]):
                total[some, k] += np.add.reduceat(weights[:, k][bucket], edge[some])
    return total, count


@dataclass(frozen=True)
class LanguageModel:
    """languages, and for each bucket its logits: embeddings times the linear layer. temperature and least come from calibration."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = totals(data, offsets, self.logits)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> LanguageModel:
    """rows: language, buckets of a text, and their counts, in an order that doesn't depend on the cluster."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not rows:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    target = np.array([languages.index(r[0]) for r in rows])
    shares = [(bucket, (count / max(1, count.sum())).astype(np.float32)) for _, bucket, count in rows]

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for k, d in enumerate(which):
            x[k, shares[d][0]] = shares[d][1]
        return x

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    hot, step = np.eye(len(languages), dtype=np.float32), 32
    for epoch in range(EPOCHS):
        rate = np.float32(60 * (1 - epoch / EPOCHS))
        rng.shuffle(train)
        for at in range(0, len(train), step):
            batch = train[at : at + step]
            xb = dense(batch)
            hidden = xb @ embed
            z = hidden @ linear + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (p / p.sum(axis=1, keepdims=True) - hot[target[batch]]) / np.float32(len(batch))
            back = xb.T @ (slope @ linear.T)
            linear -= rate * np.float32(0.05) * (hidden.T @ slope)
            bias -= np.float32(0.1) * slope.sum(axis=0)
            embed -= rate * back
    logits = embed @ linear
    model = LanguageModel(languages, logits, bias.astype(np.float64))
    if not len(kept):
        return model
    z = np.concatenate([dense(kept[at : at + step]) @ logits for at in range(0, len(kept), step)]) + bias

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    heat = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(np.maximum(softmax(t)[np.arange(len(kept)), target[kept]], 1e-12)).sum())
    return LanguageModel(languages, logits, bias.astype(np.float64), float(heat), float(min(np.quantile(softmax(heat).max(axis=1), REJECT_SHARE), REJECT_BELOW)))


def trained(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2 and that have text and lang. About train_rows of them, as many of each language, are drawn by a hash of doc_id; the counts that set the shares cover all rows. One task trains; the model alone, of fixed size, comes to the driver."""
    fit = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in fit.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return fitted([])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, train_rows / len(counts) / n))])
    drawn = fit.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def counted(batches):
        for b in batches:
            ids, langs, texts = b.columns
            out = []
            for at, end, data, offsets in steps(texts):
                found = subwords(data, offsets)
                for d in range(end - at):
                    own = [bucket[slice(*np.searchsorted(place, offsets[d : d + 2]))] for place, bucket in found]
                    bucket, count = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)
                    out.append((bucket.astype("<u4").tobytes(), count.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["doc_id", "lang", "bucket", "n"])

    def fit_all(batches):
        rows = {tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows)}
        m = fitted([(r[1], np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<u4")) for r in sorted(rows)])
        made = [list(m.languages)], [m.logits.astype("<f4").tobytes()], [m.bias.astype("<f8").tobytes()], [m.temperature], [m.least]
        kinds = pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds, strict=True)], names=["languages", "logits", "bias", "temperature", "least"])

    # about train_rows rows of at most BUCKETS counts make the one task's input
    rows = drawn.mapInArrow(counted, "doc_id long, lang string, bucket binary, n binary").repartition(1)
    m = rows.mapInArrow(fit_all, "languages array<string>, logits binary, bias binary, temperature double, least double").first()
    return LanguageModel(tuple(m.languages), np.frombuffer(m.logits, "<f4").reshape(BUCKETS, len(m.languages)), np.frombuffer(m.bias, "<f8"), m.temperature, m.least)


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted.

    A null text, one without any letter, and any text if nothing could be learned get `und`, score 0 and accepted false.
    Ties go to the language that sorts first. Rows are handled one by one, so that repeated rows get equal results;
    columns of docs with the names of the three results are replaced, other columns stay.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    at = docs.columns.index(text)

    def predict(batches):
        names = np.array([*model.languages, "und"], dtype=object)
        for b in batches:
            label, score = [], []
            for first, end, data, offsets in steps(b.column(at)):
                known = has_letter(data, offsets) if model.languages else np.zeros(end - first, bool)
                p = model.scores(data, offsets) if model.languages else np.zeros((end - first, 1))
                label.append(np.where(known, p.argmax(axis=1), len(model.languages)))
                score.append(np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0))
            label, score = (np.concatenate(x) if x else np.zeros(0) for x in (label, score))
            sure = (label < len(model.languages)) & (score >= model.least)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[label.astype(int)], pa.string()), pa.array(score, pa.float64()), pa.array(sure)], names=[*b.schema.names, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(predict, with_fields(docs, "lang_pred string, score double, accepted boolean"))


def language_digest(docs: DataFrame) -> DataFrame:
    model = trained(docs)
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def language_filtered(docs: DataFrame) -> DataFrame:
    """docs without those that the model rejects."""
    kept = predicted(docs.select(*docs.columns), trained(docs)).where("accepted")
    return kept.select(*docs.columns)
