"""SentencePiece encoding and decoding by the `tokenizers` library.

The model file, a serialised protobuf, is read field by field here. From it come the normaliser (its precompiled
character map, white-space rules, dummy prefix), the metaspace marker U+2581, the pieces with their scores (a unigram
model, or merges in the order of the scores for a BPE model) and byte fallback. Batches are encoded on several threads.
Where no piece goes past the end of a word, `tokenizers` encodes the words of a text one by one; so here each distinct word is
given to it once and its ids are remembered. Every text's own ids are decoded, and `sentencepiece` encodes every text
whole, for parity; a text for which it gives other ids is encoded whole by `tokenizers` as well.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Kinds of pieces and of models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded in one call of the library.
CALL_CHARS = 1 << 20
#: Words whose ids are remembered before those not met since are dropped, so at most about twice as many, and how long such a word can be.
KNOWN_WORDS, KNOWN_CHARS = 1 << 18, 64
#: Words that are encoded in a row.
ROW_WORDS = 1 << 12
#: The tokenizer's words of a text that starts with a marker, each without its first marker.
WORDS = re.compile(f"{META}({META}*[^{META}]+|{META}*\\Z)")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What the file says: pieces are (text, score, kind)."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        text = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 24:
                        m.suffix = bool(v)
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 40:
                        m.unknown = v
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.trim_spaces = bool(v)
                    elif n == 5:
                        m.escape_spaces = bool(v)
        if m.kind not in (UNIGRAM, BPE) or m.suffix or not m.escape_spaces:
            raise ValueError("only unigram and BPE models with escaped, prefixed white space are supported")
        return m

    @property
    def crossing(self) -> bool:
        """Whether a piece goes on past the end of a word, so that text can't be cut into words first."""
        return any(META in p.lstrip(META) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best piece first; among the splits of a piece those with earlier parts first."""
    number = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for p, k in number.items():
        for cut in range(1, len(p)):
            a, b = number.get(p[:cut]), number.get(p[cut:])
            if a is not None and b is not None:
                out.append((-pieces[k][1], k, a, b, p[:cut], p[cut:]))
    return [x[4:] for x in sorted(out)]


def tokenizer(m: PieceModel):
    """The same model in the `tokenizers` library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == BPE:
        vocab = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        t = Tokenizer(models.BPE(vocab, merges(m.pieces), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, ignore_merges=False))
    else:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback))
    rules = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        rules += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        rules.append(normalizers.Prepend(META))
    t.normalizer = normalizers.Sequence([*rules, normalizers.Replace(" ", META)])
    if not m.crossing:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{META}*[^{META}]+|{META}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(META, " "), *([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    defined = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if defined:
        t.add_tokens(defined)
    t.encode_special_tokens = True
    return t


def runs(texts: list[str], most: int = CALL_CHARS) -> Iterator[list[str]]:
    out, size = [], 0
    for x in texts:
        if out and size + len(x) > most:
            yield out
            out, size = [], 0
        out.append(x)
        size += len(x)
    if out:
        yield out


def read_model(path: str) -> bytes:
    """The model file's bytes, on the driver; tasks get them with their function (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes whole texts, decodes their ids again, and says whether `sentencepiece` gives the same ids for the whole text."""

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True) -> None:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        self.model = PieceModel.parse(data)
        self.tokenizer = tokenizer(self.model)
        m = self.model
        self.plain = m.dummy_prefix and not m.trim_spaces and not m.charsmap and not any(kind == USER_DEFINED for _, _, kind in m.pieces)
        if self.plain:  # a prefix and markers for spaces are all that the normaliser adds: strings do that cheaper
            from tokenizers import normalizers

            self.tokenizer.normalizer = normalizers.Sequence([])
        self.by_word, self.known, self.older, self.begins = self.plain and not m.crossing, {}, {}, np.array([p.startswith(META) for p, _, _ in m.pieces])
        spaced = lambda p: p.replace(META, " ").encode()
        plain = (NORMAL, USER_DEFINED, UNUSED)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else spaced(p) if kind in plain else None for p, _, kind in self.model.pieces]
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=data)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their pieces' bytes put together. What isn't text then, or has an unknown or control piece, is left to the library's decoder."""
        try:
            text = b"".join(map(self.bytes.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def whole(self, texts: list[str]) -> list[list[int]]:
        """ids by `tokenizers`, each text in one piece. An empty text has none."""
        normal = [META + x.replace(" ", META) for x in texts] if self.plain else texts
        return [e.ids if x else [] for x, e in zip(texts, self.tokenizer.encode_batch_fast(normal, add_special_tokens=False), strict=True)]

    def joined(self, texts: list[str]) -> list[list[int]]:
        """The same ids, put together from those of the words."""
        normal = [x.replace(" ", META) for x in texts]
        words = [[] if not x else WORDS.findall(META + x) if x[0] == META or META * 2 in x else x.split(META) for x in normal]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        fresh = set(chain.from_iterable(words)).difference(self.known)
        again = list(filter(self.older.__contains__, fresh))
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        fresh.difference_update(again)
        self.learn(fresh)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, w)), np.int32).tolist() for w in words]
        for w in fresh:
            if len(w) > KNOWN_CHARS:
                del self.known[w]
        return out

    def learn(self, words: set[str]) -> None:
        """The ids of words, as bytes. Words without markers inside are given to the library in rows, and their ids parted where a piece begins with a marker."""
        plain, alone = [w for w in words if w and META not in w], [w for w in words if not w or META in w]
        rows = [plain[at : at + ROW_WORDS] for at in range(0, len(plain), ROW_WORDS)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([META + META.join(row) for row in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            data, cuts = ids.tobytes(), [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), len(ids) * 4]
            if len(cuts) == len(row) + 1:
                self.known.update(zip(row, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
            else:  # the marker isn't a piece
                alone += row
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([META + w for w in alone], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[bool | None]]:
        """ids, what they decode to, and parity. An empty text has no ids in either library."""
        ids = self.joined(texts) if self.by_word else self.whole(texts)
        same = [None] * len(texts)
        if self.other:
            other = self.other.encode(texts, num_threads=1)
            same = [x == y for x, y in zip(ids, other, strict=True)]
            differ = [k for k, x in enumerate(same) if not x] if self.by_word else []
            for k, x in zip(differ, self.whole([texts[k] for k in differ]), strict=True):
                ids[k], same[k] = x, x == other[k]
        return ids, [self.decode(x) for x in ids], same


@lru_cache(2)
def shared(data: bytes, threads: int, verify: bool) -> Encoder:
    """One Encoder for all tasks that a Python worker runs, so that words are remembered from one to the next."""
    return Encoder(data, threads, verify)


def listed(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


RESULTS = {"ids": "array<int>", "decoded": "string", "round_trip": "boolean", "parity": "boolean"}


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text", threads: int = 2, verify: bool = True, columns: list[str] | None = None) -> DataFrame:
    """docs with `ids`, the token ids of the whole text, `decoded`, what they decode to, `round_trip`, whether that is the text again, and `parity`, whether `sentencepiece` gives the same ids (null without verify); or, of all these, `columns` only.

    A null or empty text has no ids and decodes to the empty text. A text that itself has the metaspace marker decodes to
    spaces there, as it does in `sentencepiece`. Rows are handled one by one, so repeated rows get equal ids; columns of
    docs with the results' names are replaced, other columns stay. A very long text is encoded in a call of its own; calls
    hold about CALL_CHARS characters otherwise.
    """
    data = read_model(model)
    docs = docs.drop(*RESULTS)
    at = docs.columns.index(text)
    out = with_fields(docs, ", ".join(f"{k} {v}" for k, v in RESULTS.items()))
    names = columns or out.names

    def encode(batches):
        encoder = shared(data, threads, verify)
        for b in batches:
            first = 0
            for run in runs([x or "" for x in b.column(at).to_pylist()]):
                ids, back, parity = encoder.encode(run)
                own = b.slice(first, len(run))
                first += len(run)
                made = {"ids": lambda ids=ids: listed(ids), "decoded": lambda back=back: pa.array(back, pa.string()), "round_trip": lambda run=run, back=back: pa.array([x == y for x, y in zip(run, back, strict=True)]), "parity": lambda parity=parity: pa.array(parity, pa.bool_())}
                yield pa.RecordBatch.from_arrays([made[n]() if n in made else own.column(n) for n in names], names=names)

    return docs.mapInArrow(encode, StructType([out[n] for n in names]))


def pieces_digest(docs: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded(docs.select("doc_id", "text"), columns=["doc_id", "ids", "round_trip", "parity"]).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "round_trip", "parity")
