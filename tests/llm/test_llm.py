"""Operators of the training-data subpackage: brute force on small fixtures, defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("netloom.llm")
from netloom.llm import contexttree, decontaminate, exactdedup, htmltext, langid, linededup, ngramjoin, pieces, pii, queries, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, spans string, n_lines string, found string, items string, score string, ids string"
WHITE = re.compile("[\\x20\\x09-\\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' results."""
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "some words of a document without an id"), (4, "word"), (4, "word"), (5, "x" * 30_000), (6, "a b c d e f g h. " * 400), (7, "a b c d e f g h. " * 400)]


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < size else zip(*[w[k:] for k in range(size)], strict=False)) if w else frozenset()


def components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, size, percent):
    r = random.Random(size)
    rows = []
    for family in range(3):
        base = [f"w{r.randrange(10**5)}" for _ in range((12, 80, 260)[family])]
        for _ in range((20, 60, 25)[family]):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 14))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**5)}"
            rows.append((r.randrange(10**6), " ".join(w[: r.choice([len(w), len(w), len(w) * 9 // 10])])))
    rows = list({i: t for i, t in rows}.items()) + [(1_000_001, None), (1_000_002, " "), (1_000_003, "Two words"), (1_000_004, "two WORDS")]
    got = {x[0]: (x[1], x[2]) for x in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
    assert got == components(rows, size, percent)


@pytest.mark.parametrize(("size", "percent", "split"), [(3, 90, 4), (5, 80, 0.01)])
def test_join_gives_every_link(spark, size, percent, split, monkeypatch):
    """Class and number of links against all pairs; more near copies than a bucket holds, dealt into several blocks; entries that are split, and those that aren't."""
    monkeypatch.setattr(ngramjoin, "SPLIT", split)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 4)
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "WIDTH", 64)
    r, rows = random.Random(size), []
    for n, copies in ((12, 10), (80, 45), (260, 20), (90, 2), (100, 3)):
        base = [f"w{r.randrange(10**5)}" for _ in range(n)]
        for k in range(copies):
            w = list(base)
            for _ in range(0 if k % 7 == 0 else r.randrange(1, max(2, n // 25))):
                w[r.randrange(n)] = f"x{r.randrange(10**5)}"
            rows.append((r.randrange(10**6), " ".join(w)))
    rows = list({i: t for i, t in rows}.items()) + [(1_000_001, None), (1_000_003, "Two words"), (1_000_004, "two WORDS")]
    sets = {i: shingles(t, size) for i, t in rows}
    first, links = {}, Counter()
    for i in sorted(sets, reverse=True):
        first[sets[i] or i] = i
    for a in first.values():
        for b in first.values():
            both = len(sets[a] & sets[b])
            links[a] += a != b and both > 0 and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
    expected = {i: (first[s or i], links[first[s or i]]) for i, s in sets.items()}
    docs = spark.createDataFrame([*rows, *rows[20:30]], "doc_id long, text string")
    out = ngramjoin.jaccard_join(docs, size=size, percent=percent).collect()
    assert len(out) == docs.count() and {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == expected and max(links.values()) > 8


def test_join_edges(spark):
    got = ngramjoin.jaccard_components(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {x["doc_id"]: x for x in got}
    assert by[None]["component_id"] is None and by[1]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[7]["component_id"] == 6
    assert ngramjoin.jaccard_components(frame(spark, [])).count() == 0


def test_scheme_finds_every_link():
    """The allocation leaves no pair at the bound without a common entry, whatever the costs."""
    r, scheme = np.random.default_rng(1), ngramjoin.Scheme(90)
    for n in (5, 9, 10, 19, 37, 120, 400):
        for _ in range(20):
            a = np.unique(r.integers(1, 1 << 62, n, dtype=np.uint64))
            most = scheme.differ(len(a), scheme.largest(len(a)))
            extra = r.integers(1, 1 << 62, min(most, scheme.largest(len(a)) - len(a)), dtype=np.uint64)
            b = np.unique(np.concatenate([a, extra]))
            counts = r.integers(0, 1000, ngramjoin.COUNTERS)
            (ea, ra), (eb, rb) = scheme.entries(a, counts), scheme.entries(b, counts)
            probes, index = set(ea[(ra & ngramjoin.PROBE) > 0].tolist()), set(eb[(rb & ngramjoin.INDEX) > 0].tolist())
            assert probes & index


def test_language(spark):
    r = random.Random(2)
    tongues = {"xx": "ab ba bo ob".split(), "yy": "ik ki ko ok".split()}
    rows = [(i, " ".join("".join(r.choices(tongues[t], k=3)) for _ in range(12)), t) for i in range(300) for t in [r.choice(["xx", "yy"])]] + [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.language_digest(docs).collect()}
    held = [x for x in rows[:300] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == t for i, _, t in held) >= 0.97 * len(held) and all(got[i]["held_out"] for i, _, _ in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.language_filtered(docs).columns == docs.columns
    assert langid.language_digest(docs.limit(0)).count() == 0
    assert langid.predicted(frame(spark, EDGES).drop("score"), langid.fitted([])).count() == len(EDGES)


def test_private_data(spark):
    text = "Mail a.b7@x.org, card 4539 1488 0343 6467 or 4539148803436468, ip 10.0.0.255, on 2024-02-29 or 2023-02-29, 31.12.1999, 078-05-1120, 666-12-1234, +1 (415) 555-0132, DE89 3704 0044 0532 0130 00."
    rows = [(1, text), (2, "again 10.0.0.255 " + text), (3, None), (4, ""), (5, "no data 7.")]
    got = {x["doc_id"]: x for x in pii.pseudonymised(frame(spark, rows)).collect()}
    out = got[1]["text"]
    assert got[1]["found"] == ["mail", "card", "ip", "date", "date", "ssn", "phone", "iban"] and len(out) >= len(text) - 8
    for private in ("a.b7@", "4539 1488 0343 6467", "10.0.0.255", "2024-02-29", "31.12.1999", "078-05-1120", "555-0132", "3704 0044 0532"):
        assert private not in out
    for kept in ("4539148803436468", "2023-02-29", "666-12-1234", "@x.org"):  # no check digit, no such day, no such area; the mail's domain
        assert kept in out
    card = re.search(r"card ([\d ]{19})", out)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert re.search(r"ip (\S+),", out)[1] == re.search(r"again (\S+) ", got[2]["text"])[1]  # linked
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "no data 7." and got[5]["found"] == []


def test_feistel_is_a_permutation(spark):
    out = spark.range(17 * 55).selectExpr(f"{pii._numbers('k', 'date', 'id', 17, 55)} AS v")
    assert {x[0] for x in out.collect()} == set(range(17 * 55))
    words = spark.range(1000).selectExpr("lpad(id, 3, '0') AS s").selectExpr(f"{pii._characters('k', 'card', 's')} AS v")
    assert len({x[0] for x in words.collect()}) == 1000


def brute_tiles(a, b, least):
    ma, mb, out = [0] * len(a), [0] * len(b), 0
    while True:
        best, places = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, places = k, []
                if k == best:
                    places.append((i, j))
        if best < least:
            return out
        for i, j in places:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [1] * best
                out += best


def test_tiling_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        k = r.choice([2, 3, 6, 40])
        a, b = [r.randrange(k) for _ in range(r.randint(1, 30))], [r.randrange(k) for _ in range(r.randint(1, 40))]
        if r.random() < 0.5:
            b = b[:4] + a[len(a) // 2 :] + b[4:8] + a[: len(a) // 2]
        for least in (2, 5):
            assert sum(t[2] for t in decontaminate.tiles(a, b, least)) == brute_tiles(a, b, least)


def test_decontamination(spark):
    item = [f"q{k}" for k in range(30)]
    reordered = " ".join(item[20:] + ["and"] + item[:10] + ["or"] + item[10:20])
    rows = [(1, "start " + " ".join(item).upper() + " end"), (2, reordered), (3, " ".join(item[:8]) + " alone"), (4, "clean " * 50), *[(10 + (i or 0), t) for i, t in EDGES]]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, "a b"), (None, "x y z u v w")], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.leaks_digest(frame(spark, rows), bench).collect()}
    assert got[1]["items"] == [7] and got[2]["items"] == [7] and got[2]["coverage"] == 1.0
    assert got[16]["items"] == got[17]["items"] == [9]  # an item of fewer words than a match, held whole
    assert not got[3]["contaminated"] and got[3]["coverage"] == pytest.approx(8 / 30, abs=1e-5) and not got[4]["contaminated"] and not got[11]["contaminated"]
    left = decontaminate.leaks_filtered(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns and left.count() == len(rows) - 4
    assert decontaminate.leaks_filtered(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(frame(spark, rows), bench).where("size(items) > 0").count() == 4


def test_pieces(spark):
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(1, "Hello  wörld 日本\n <s> a"), (2, "▁ ▁▁x"), *[(20 + k, x) for k, (_, x) in enumerate(EDGES)]]
    got = {x["doc_id"]: x for x in pieces.encoded(frame(spark, rows)).collect()}
    for i, text in rows:
        assert got[i]["ids"] == t.encode(text or "") and got[i]["parity"] and got[i]["round_trip"] == ("▁" not in (text or ""))
    assert pieces.encoded(frame(spark, [])).count() == 0
    whole = pieces.PieceModel.parse(pieces.read_model(pieces.MODEL))
    assert (whole.kind, whole.byte_fallback, len(whole.pieces), whole.crossing) == (pieces.BPE, True, 32000, False)


def model_file(texts, kind, fallback, trim=False):
    """A serialised model with these pieces, made by hand: longer ones score better."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def field(key, value):
        if isinstance(value, float):
            return number(key << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return number(key << 3) + number(value)
        return number(key << 3 | 2) + number(len(value)) + value

    listed = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] if fallback else []
    listed += [(t, -float(k + 1) / len(t), pieces.NORMAL) for k, t in enumerate(texts)]
    out = b"".join(field(1, field(1, t.encode()) + field(2, score) + field(3, k)) for t, score, k in listed)
    return out + field(2, field(3, kind) + field(35, int(fallback)) + field(40, 0) + field(41, 1) + field(42, 2)) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(trim)) + field(5, 1))


def test_words_are_encoded_once(monkeypatch):
    """The same ids as of whole texts, also of texts with odd spaces and markers, and when words are forgotten. Before, each text was encoded whole by both libraries."""
    r, alphabet = random.Random(5), ["a", "b", "the", "é", "漢", "😀", " ", " ", "  ", "\n", "\t", pieces.META, "\x00", "0"]
    texts = ["", " ", "  ", "a ", " a", pieces.META, "a" * 500 + " b"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]
    for most in (pieces.KNOWN_WORDS, 20):
        monkeypatch.setattr(pieces, "KNOWN_WORDS", most)
        e = pieces.Encoder(pieces.read_model(pieces.MODEL))
        ids, same = [], []
        for at in range(0, len(texts), 40):
            own, _, parity = e.encode(texts[at : at + 40])
            ids, same = ids + own, same + parity
        assert ids == e.whole(texts) and ids == e.joined(texts) == e.other.encode(texts) and all(same)
        assert all(len(w) <= pieces.KNOWN_CHARS for w in e.known)
    given = []
    e = pieces.Encoder(pieces.read_model(pieces.MODEL))
    monkeypatch.setattr(e, "learn", lambda words, learn=e.learn: (given.extend(words), learn(words)))
    assert e.encode(["one two one", "two one"])[0] == e.whole(["one two one", "two one"])
    e.encode(["one three"])
    assert sorted(given) == ["one", "three", "two"]


def test_other_ids_of_a_text_are_replaced():
    """A text whose words' ids aren't those that sentencepiece gives is encoded whole; parity is that of the ids given."""
    e = pieces.Encoder(pieces.read_model(pieces.MODEL))
    e.known["one"] = np.array([5], np.int32).tobytes()
    ids, back, same = e.encode(["one two", "two"])
    assert ids == e.whole(["one two", "two"]) and back == ["one two", "two"] and same == [True, True]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("crossing", [True, False])
@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
def test_other_models(kind, crossing, fallback):
    """Unigram models, pieces that cross words, and unknown characters, against the library."""
    texts = ["▁", *"abcde", "▁a", "ab", "▁ab", "cd", "de", "▁cd", "abc", "▁▁", *(["b▁c", "a▁"] if crossing else [])]
    model = model_file(texts, kind, fallback)
    e = pieces.Encoder(model)
    assert e.model.crossing == crossing and e.model.kind == kind
    r = random.Random(kind)
    sample = ["", " ", "a", *["".join(r.choices("abcde  z", k=r.randint(1, 30))) for _ in range(300)]]
    ids, back, same = e.encode(sample)
    assert all(same) and [x == y for x, y in zip(back, sample, strict=True)] == [fallback or "z" not in x for x in sample]


def test_decoding_against_the_library():
    e, r = pieces.Encoder(pieces.read_model(pieces.MODEL)), random.Random(8)
    for _ in range(300):
        ids = [r.randrange(3, 32000) if r.random() < 0.7 else r.randrange(3, 259) for _ in range(r.randint(0, 12))]
        assert e.decode(ids) == e.tokenizer.decode(ids, skip_special_tokens=False)


def test_secrets(spark):
    r = random.Random(4)
    bits = ["token", "=", ":", " ", "'", "password", "api_key", "AKIA", "ABC123", "0123456789abcdef", "é", "ghp_", "a" * 40, "eyJabc.", "-", "x", "SECRET", "\n"]
    rows = [(k, "".join(r.choices(bits, k=r.randint(0, 14)))) for k in range(400)] + [(1000 + k, t) for k, (_, t) in enumerate(EDGES)]
    got = {x["doc_id"]: x for x in secrets.secrets_digest(frame(spark, rows)).collect()}
    for i, text in rows:
        expected = secrets.brute(text)
        assert (got[i]["base_sha256"], got[i]["spans"]) == (expected["base_sha256"], expected["spans"])


def brute_lines(rows):
    """All pairs of equal lines, extended to the right as far as they go; a run of a window's length at least is a repeat."""
    lines, places, full = {}, {}, {}
    for i, text in rows:
        for k, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\r\f\v"):
                lines.setdefault(i, []).append((k, x.strip(" \t\r\f\v")))
        for s, (_, x) in enumerate(lines.get(i, [])):
            places.setdefault(x, []).append((i, s))
            words, n = 0, 0
            while words < linededup.MIN_WORDS and n < linededup.MIN_LINES and s + n < len(lines[i]):
                words += lines[i][s + n][1].count(" ") + 1
                n += 1
            full[i, s] = n if words >= linededup.MIN_WORDS or n == linededup.MIN_LINES else math.inf
    gone = {i: set() for i, _ in rows}
    for same in places.values():
        same.sort()
        for k, (j, q) in enumerate(same):
            longest = 0
            for i, p in same[:k]:
                n = 0
                while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n][1] == lines[j][q + n][1]:
                    n += 1
                longest = max(longest, n)
            if longest >= full[j, q]:
                gone[j] |= {at for at, _ in lines[j][q : q + longest]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    pool = ["a", "b", "", " c ", "long " * 25, "mid one two three four five six seven"]
    rows = [(k, "\n".join(r.choices(pool, k=r.randint(0, 9)))) for k in range(150)] + [(500, None), (501, "x" * 30_000), (502, "a b c d e f g h. \n" * 300)]
    got = {x["doc_id"]: x["text"] for x in linededup.without_repeats(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    twice = linededup.without_repeats(frame(spark, [(1, "p\nq\nr"), (1, "p\nq\nr"), (2, "p\nq\nr\ns"), (None, "p\nq\nr")])).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in twice) == [(0, ""), (1, "p\nq\nr"), (1, "p\nq\nr"), (2, "s")]
    assert linededup.lines_filtered(frame(spark, [])).count() == 0


def test_matches_are_extended(spark):
    """Short lines after a long one go with it, also where the first copy of the long line goes on otherwise."""
    long = "word " * 25
    rows = [(1, f"{long}\nz"), (2, f"{long}\na\nb\nc"), (3, f"{long}\na\nb\nd"), (4, f"y\n{long}\na\nd"), (5, "a\nb"), (6, f"x\nx\nx\nx\nx\n{long}")]
    got = {x["doc_id"]: x["text"] for x in linededup.without_repeats(frame(spark, rows)).collect()}
    assert got == brute_lines(rows) == {1: f"{long}\nz", 2: "a\nb\nc", 3: "d", 4: "y\nd", 5: "a\nb", 6: "x"}


def test_heavy_keys(spark, monkeypatch):
    """Rows of keys with many rows are joined by broadcast, the others by a shuffle; none is lost."""
    from netloom.llm import common

    monkeypatch.setattr(common, "HEAVY", 0.2)
    rows = common.written(spark.range(9000).selectExpr("IF(id < 4000, 0, IF(id < 8000, id, null)) AS k", "id"), "rows")
    table = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    got = common.with_one(rows, table, "k", "n")
    assert {(x["k"], x["id"], x["least"]) for x in got.collect()} == {(0, k, 0) for k in range(4000)} | {(k, k, k) for k in range(4000, 8000)}


def test_exact_dedup(spark):
    r = random.Random(6)
    texts = [" ".join(r.choices("abcdef", k=r.choice([1, 5, 700]))) for _ in range(12)]
    rows = [(k, r.choice(texts).replace(" ", r.choice([" ", "  ", "\n"]))) for k in range(200)] + [(900, None), (901, ""), (902, " "), (None, "n"), (903, "x" * 30_000), (904, "same"), (904, "same")]
    got = exactdedup.exact_groups(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub(" ", t or ""), []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): sorted(ids, key=lambda x: (x is None, x)) for t, ids in groups.items()}
    assert len(got) == len(rows) and sum(x["kept"] for x in got) == len(groups)
    assert all(digest[x["text_sha256"]][0] == x["keep_id"] and len(digest[x["text_sha256"]]) == x["group_size"] for x in got)
    assert exactdedup.exact_groups(frame(spark, [])).count() == 0


def test_pages(spark):
    model = htmltext.trained()
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie">We use cookies.</div><article><h1>Title &amp; more</h1><p>First  para<b>graph</b>.<br>Next line, with words.</p><div class="ad">Buy now.</div><p>Second one is here, and it goes on.</p></article><section class="comments"><p>Nice, thanks.</p></section><aside>More links</aside><form>Sign up<input></form><footer>&copy; all</footer><script>var x="<p>no</p>"</script></body></html>'
    assert model.extract(page) == "Title & more First paragraph. Next line, with words. Second one is here, and it goes on."
    assert model.extract(None) == model.extract("") == model.extract("<html><body></body></html>") == ""
    rng, right, total = random.Random(99), 0, 0
    for _ in range(60):
        p = htmltext.LabelledPage(htmltext.labelled_page(rng))
        for k, text in p.events:
            if text and text.strip():
                total += 1
        c = model.content(p)
        right += sum(c[k] == bool(p.labels[k]) for k, text in p.events if text and text.strip())
    assert right >= 0.93 * total
    docs = spark.createDataFrame([(1, page, "old"), (2, None, "old"), (3, "<p", "old")], "page_id long, html string, text string")
    assert {x["page_id"]: x["text"] for x in htmltext.main_texts(docs, model=model).collect()} == {1: model.extract(page), 2: "", 3: ""}


#: Pages in other styles than the made ones, with the text that a reader would take for the article.
PAGES = [
    ('<html><body><article><p>First para with words, and more words. It goes on here.</p><p>one<wbr>word, x<img src=a>y.</p><p><math><mi>a</mi><mo>=</mo><mn>2</mn></math> equals, in text.</p></article></body></html>', "First para with words, and more words. It goes on here. oneword, xy. a=2 equals, in text."),
    ("Plain text, without markup.", "Plain text, without markup."),
    ("<p>Short.</p>", "Short."),
    ('<body><nav><a href=1>Home</a> <a href=2>News</a></nav><article><h1>On rivers</h1><p>Rivers flow, mostly down. They end in seas.</p><p>Read <a href=x>the whole of this linked sentence here</a></p><p>They also flood, at times.</p></article><footer>Imprint</footer></body>', "On rivers Rivers flow, mostly down. They end in seas. Read the whole of this linked sentence here They also flood, at times."),
    ('<div class="content"><h2>Sources</h2><p>These were read, all of them, for this page.</p><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul><p>More will come, in time.</p></div><div class="sidebar"><ul><li><a href=3>Archive</a></li></ul></div>', "Sources These were read, all of them, for this page. First source Second source More will come, in time."),
    ('<article><p>Lead, with words enough to count as one.</p><p class="note warning">Mind the gap, it is wide.</p><p>End of it, finally.</p></article>', "Lead, with words enough to count as one. End of it, finally."),
    ('<main><h1>Soup</h1><p>Boil water.</p><ol><li>Add salt.</li><li>Stir well.</li></ol></main><div id="comments"><p>Great soup, thank you!</p></div>', "Soup Boil water. Add salt. Stir well."),
    ('<div id="page"><div class="masthead">The Paper</div><div class="story"><p>It rained, again, on Monday. Nobody was surprised.</p><div class="advert">Buy boots</div><p>On Tuesday it didn&#39;t.</p></div><div class="footer">All rights</div></div>', "It rained, again, on Monday. Nobody was surprised. On Tuesday it didn't."),
    ('<section class="entry-content"><p>super<wbr>cali, said slowly.</p><table><tr><td>one</td><td>two</td></tr></table><p>And so on, for lines.</p></section><div class="cookie-banner"><p>We use cookies, accept them.</p></div>', "supercali, said slowly. one two And so on, for lines."),
    ('<nav><ul><li><a href="/">Home</a></li></ul></nav><footer>&copy; all</footer>', ""),
]


def test_foreign_pages():
    model = htmltext.trained()
    wrong = [(html, model.extract(html), text) for html, text in PAGES if model.extract(html) != text]
    assert not wrong


def test_sum_product_is_exact():
    """Marginals of a small tree against the sum over all labellings."""
    parents, own, edges = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.5, 2.0, -0.7], [0, 1, 0, 1, 0]
    pair = [(0.2, -0.4, 0.1, 0.9), (1.0, -1.0, -0.5, 0.6)]
    total, ones = 0.0, [0.0] * 5
    for bits in range(32):
        y = [bits >> k & 1 for k in range(5)]
        p = math.exp(sum(own[k] * y[k] for k in range(5)) + sum(pair[edges[k]][2 * y[parents[k]] + y[k]] for k in range(1, 5)))
        total += p
        for k in range(5):
            ones[k] += p * y[k]
    got = htmltext.marginals(parents, own, edges, pair)[0]
    assert [1 / (1 + math.exp(-x)) for x in got] == pytest.approx([o / total for o in ones])


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def brute_scores(rows):
    """The context trees in dictionaries, one node after another."""
    depth, count = contexttree.DEPTH, {}
    coded = lambda t: [0] * depth + list((t or "").encode()) + [255]
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            x = coded(t)
            for p in range(depth, len(x)):
                node = 1
                for k in range(8):
                    bit = x[p] >> (7 - k) & 1
                    for d in range(depth + 1):
                        count.setdefault((node, tuple(x[p - d : p][::-1])), [0, 0])[bit] += 1
                    node = 2 * node + bit
    children = {}
    for node, c in count:
        if c:
            children.setdefault((node, c[:-1]), []).append((node, c))
    weight, share = {}, {}
    for key in sorted(count, key=lambda k: -len(k[1])):
        own = kt(*count[key])
        below = sum(weight[c] for c in children.get(key, ()))
        weight[key] = own if len(key[1]) == depth else np.logaddexp(own, below) - math.log(2)
        share[key] = 1.0 if len(key[1]) == depth else 1 / (1 + math.exp(min(700.0, below - own)))
    out = {}
    for i, t in rows:
        x, total = coded(t), 0.0
        for p in range(depth, len(x)):
            node = 1
            for k in range(8):
                bit, chance = x[p] >> (7 - k) & 1, None
                for d in range(depth, -1, -1):
                    key = (node, tuple(x[p - d : p][::-1]))
                    z = count.get(key, [0, 0])
                    own = (z[bit] + 0.5) / (sum(z) + 1)
                    s = share.get(key, 1.0 if d == depth else 0.5)
                    chance = own if chance is None else s * own + (1 - s) * chance
                total += math.log10(chance)
                node = 2 * node + bit
        out[i] = total
    return out


def test_context_trees(spark):
    r = random.Random(7)
    rows = [(k, "".join(r.choices(["ab", "ba ", "cé", "D. "], k=r.randint(0, 25)))) for k in range(60)] + [(100, None), (101, "zzz unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in contexttree.scored(docs).collect()}
    expected, held = brute_scores(rows), {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in rows if i not in held for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        assert got[i]["score"] == pytest.approx(expected[i], rel=1e-9) and got[i]["held_out"] == (i in held)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and got[i]["train_tokens"] == n
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(counts.get(x, 0) > 0 for x in w)
    assert contexttree.scored(frame(spark, EDGES)).count() == len(EDGES) and contexttree.scored(frame(spark, [])).count() == 0


def test_pipeline_against_plain_version(spark):
    """Stages 2 to 4 by brute force on what the first keeps."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = c.language_id(spark, docs, SF).orderBy("doc_id").collect()
    rows = [(x["doc_id"], x["text"]) for x in first]
    assert len(rows) >= 0.95 * docs.count()
    lines = {i: t for i, t in brute_lines(rows).items() if t == dict(rows)[i] or t.split()}
    group = components(list(lines.items()), 5, 80)
    one = {i: t for i, t in lines.items() if group[i][1] == i}
    items = [x[0].encode().lower().split() for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    clean = {}
    for i, t in one.items():
        w = t.encode().lower().split()
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [x for x in items if any(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4))]
        if not any(brute_tiles(x, w, 5) >= 0.5 * len(x) for x in near):
            clean[i] = t
    got = {x["doc_id"]: x for x in c.run(spark, SF).collect()}
    assert got.keys() == clean.keys() and all(x["round_trip"] and x["parity"] for x in got.values())
    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]


def test_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} and set(queries.ORACLES) <= set(queries.QUERIES)
