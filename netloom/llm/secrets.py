"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are parsed here, joined into one nondeterministic automaton that may start at every byte,
made deterministic by subset construction over byte classes, and minimised. Its transition rows are linked lists of rows,
so that scanning a text for all rules costs one indexing step a byte. Texts in which no accepting state is reached are
finished; in the others, the rules that were reached find their exact spans (leftmost, longest, not overlapping) with
their own anchored automata. Nothing is sampled and texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_fields

WORD = "A-Za-z0-9"


@dataclass(frozen=True)
class Rule:
    """kind, expression (lower-case letters outside of classes match either case if any_case), least length of the match, least length of what follows the separator."""

    kind: str
    pattern: str
    least: int = 0
    least_value: int = 0
    any_case: bool = False


#: The rules whose results are fixed by contract.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", least_value=6, any_case=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),
)
#: Token formats that their issuers publish.
ADDED_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("gh", f"gh[opsur]_[{WORD}]+", least=40),
    Rule("slack", f"xox[abeoprs]-[{WORD}-]+", least=20),
    Rule("jwt", f"eyJ[{WORD}_-]+\\.eyJ[{WORD}_-]+\\.[{WORD}_-]+", least=30),
    Rule("google", f"AIza[{WORD}_-]+", least=39),
    Rule("stripe", f"[rs]k_(live|test)_[{WORD}]+", least=24),
)


# ---- regular expressions to automata


class Nfa:
    """States with byte-set edges and empty edges; a byte set is an int of 256 bits."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


def _bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


class Parser:
    """Alternation, groups, classes, \\xHH and other escapes, and ? * + {m} {m,} {m,n}. Builds the fragment for each piece anew when it repeats."""

    def __init__(self, rule: Rule, nfa: Nfa) -> None:
        self.text, self.at, self.nfa, self.any_case = rule.pattern, 0, nfa, rule.any_case
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"bad expression at {self.at}: {self.text}")
        self.start, self.end = self.build(tree)

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.take()
            out.append(self.sequence())
        return ("or", out)

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeated(self.atom()))
        return ("seq", out)

    def repeated(self, piece):
        c = self.peek()
        if c in "?*+" and c:
            self.take()
            return ("rep", piece, {"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        if c == "{":
            body = self.text[self.at + 1 : (end := self.text.index("}", self.at))]
            self.at = end + 1
            low, comma, high = body.partition(",")
            return ("rep", piece, (int(low), int(high) if high else None if comma else int(low)))
        return piece

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(self.text)
            return inner
        if c == "[":
            values: set[int] = set()
            while self.peek() != "]":
                low = self.escaped() if (x := self.take()) == "\\" else ord(x)
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.escaped() if (x := self.take()) == "\\" else ord(x)
                    values |= set(range(low, high + 1))
                else:
                    values.add(low)
            self.take()
            return ("set", _bits(values))
        value = self.escaped() if c == "\\" else ord(c)
        both = {value, ord(chr(value).swapcase())} if self.any_case and chr(value).isalpha() else {value}
        return ("set", _bits(both))

    def build(self, tree) -> tuple[int, int]:
        n = self.nfa
        start, end = n.state(), n.state()
        if tree[0] == "set":
            n.edges[start].append((tree[1], end))
        elif tree[0] == "or":
            for piece in tree[1]:
                a, b = self.build(piece)
                n.empty[start].append(a)
                n.empty[b].append(end)
        elif tree[0] == "seq":
            last = start
            for piece in tree[1]:
                a, b = self.build(piece)
                n.empty[last].append(a)
                last = b
            n.empty[last].append(end)
        else:
            low, high = tree[2]
            last = start
            for _ in range(low):
                a, b = self.build(tree[1])
                n.empty[last].append(a)
                last = b
            if high is None:
                a, b = self.build(tree[1])
                n.empty[last].append(a)
                n.empty[b].append(a)
                n.empty[b].append(end)
                n.empty[last].append(end)
            else:
                for _ in range(high - low):
                    n.empty[last].append(end)
                    a, b = self.build(tree[1])
                    n.empty[last].append(a)
                    last = b
                n.empty[last].append(end)
        return start, end


@dataclass(frozen=True)
class Automaton:
    """moves[state, byte] -> state; accepts[state]: bits of the rules; dead: the state without a way on, or -1. State 0 is the start."""

    moves: np.ndarray
    accepts: np.ndarray
    dead: int


def compiled(rules: tuple[Rule, ...], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then Moore's minimisation. anywhere: a match may start at each byte."""
    nfa, starts, ends = Nfa(), [], {}
    for k, rule in enumerate(rules):
        # the scan only has to know that a match exists, so it needn't follow a repetition at a rule's end
        p = Parser(replace(rule, pattern=re.sub(r"\+$|,\}$", lambda m: m[0].strip("+,"), rule.pattern)) if anywhere else rule, nfa)
        starts.append(p.start)
        ends[p.end] = k

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.edges[x] or x in ends)

    classes = [(1 << 256) - 1]
    for mask in {m for e in nfa.edges for m, _ in e}:
        classes = [part for c in classes for part in (c & mask, c & ~mask) if part]
    first = closed(starts)
    number, rows, queue = {first: 0}, [], [first]
    for states in queue:
        row = []
        for c in classes:
            to = {t for s in states for mask, t in nfa.edges[s] if mask & c}
            target = closed(to) | first if anywhere else closed(to)
            if target not in number:
                number[target] = len(queue)
                queue.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows, np.int64)
    bits = np.array([_bits({ends[s] for s in states if s in ends}) for states in queue], np.int64)
    label = np.unique(bits, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == label.max():
            break
        label = new
    order = {old: k for k, old in enumerate(dict.fromkeys(label.tolist()))}  # the start state stays 0
    label = np.array([order[x] for x in label.tolist()])
    keep = np.array([int(np.flatnonzero(label == k)[0]) for k in range(len(order))])
    small, accepts = label[table[keep]], bits[keep]
    of_byte = np.zeros(256, np.int64)
    for k, c in enumerate(classes):
        of_byte[[b for b in range(256) if c >> b & 1]] = k
    moves = small[:, of_byte]
    dead = [k for k in range(len(moves)) if not accepts[k] and (moves[k] == k).all()]
    return Automaton(moves.astype(np.int32), accepts, dead[0] if dead and not anywhere else -1)


def linked(a: Automaton) -> list:
    """The start row. A row holds for each byte the next row, and at 256 the bits of the rules that end there."""
    rows = [[None] * 257 for _ in range(len(a.moves))]
    for row, to, bits in zip(rows, a.moves.tolist(), a.accepts.tolist(), strict=True):
        row[:256] = [rows[t] for t in to]
        row[256] = bits
    return rows[0]


def reached(row: list, data: bytes) -> int:
    """Bits of the rules that match somewhere: one step for each byte."""
    bits = 0
    for b in data:
        row = row[b]
        if row[256]:
            bits |= row[256]
    return bits


def value_length(match: bytes) -> int:
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    while match[at : at + 1] == b" ":
        at += 1
    return len(match) - at - (match[at : at + 1] in (b"'", b'"'))


def matches(a: Automaton, rule: Rule, data: bytes) -> list[tuple[int, int]]:
    """Byte spans of the rule: leftmost, longest, going on after each match; those that are too short are dropped."""
    moves, accepts, dead, out, at = a.moves, a.accepts, a.dead, [], 0
    rows = moves.tolist()
    can_start = moves[0] != dead
    for p in np.flatnonzero(can_start[np.frombuffer(data, np.uint8)]).tolist():
        if p < at:
            continue
        state, end = 0, -1
        for q in range(p, len(data)):
            state = rows[state][data[q]]
            if state == dead:
                break
            if accepts[state]:
                end = q + 1
        if end > 0:
            at = end
            if end - p >= rule.least and (not rule.least_value or value_length(data[p:end]) >= rule.least_value):
                out.append((p, end))
    return out


def spans(texts: list[str | None], rules: tuple[Rule, ...], scan: list, own: list[Automaton]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text (start, number of the rule, end) in code points, sorted."""
    for text in texts:
        if not text:
            yield []
            continue
        data = text.encode("utf-8", "surrogatepass")
        bits = reached(scan, data)
        found = [(s, k, e) for k, rule in enumerate(rules) if bits >> k & 1 for s, e in matches(own[k], rule, data)]
        if found and not data.isascii():
            place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            place = np.concatenate([[0], place])
            found = [(int(place[s]), k, int(place[e])) for s, k, e in found]
        yield sorted(found)


def secret_spans(docs: DataFrame, text: str = "text", added: tuple[Rule, ...] = ADDED_RULES) -> DataFrame:
    """docs with a column `spans`: kind, start and end (code points, end exclusive) of every secret, by start, then by the rules' order.

    A null or empty text has none. Rows are handled one by one, so repeated rows, ties and long texts need no care; a
    column `spans` of docs is replaced, other extra columns stay.
    """
    rules = BASE_RULES + added
    whole, own = compiled(rules, True), [compiled((r,), False) for r in rules]
    docs = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        row = linked(whole)
        for b in batches:
            found = spans(b.column(text_at).to_pylist(), rules, row, own)
            values = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kind)], names=[*b.schema.names, "spans"])

    text_at = docs.columns.index(text)
    return docs.mapInArrow(scan, with_fields(docs, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def listed(column: str, kinds=None):
    """kind:start:end of spans, comma-joined, all or those of some kinds."""
    x = F.col(column)
    if kinds:
        x = F.filter(x, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs.select("doc_id", "text")).select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in base), F.sha2(listed("spans", base), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def brute(text: str | None) -> dict:
    """The same by Python's re; for tests."""
    out, text = [], text or ""
    for k, rule in enumerate(BASE_RULES + ADDED_RULES):
        pattern = rule.pattern if not rule.any_case else "(?i:" + rule.pattern + ")"
        for m in re.finditer(pattern, text):
            if m.end() - m.start() >= rule.least and (not rule.least_value or value_length(m.group().encode()) >= rule.least_value):
                out.append((m.start(), k, m.end(), rule.kind))
    out.sort()
    base = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in out if x[1] < len(BASE_RULES))
    return {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in out)}
