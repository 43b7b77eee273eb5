"""Personal data replaced by format-preserving pseudonyms, in DataFrame and SQL functions only.

Found: mail addresses, IBANs, IP addresses, dates, social security numbers, card numbers and phone numbers. Numbers and
dates count only if they are valid: check digits of cards and IBANs, octets, calendar days, number ranges. Each is mapped
by a keyed Feistel permutation onto another valid value of the same format: punctuation, length, letter case, country
codes and mail domains stay, check digits are made anew. The permutation depends on the value and the key alone, so equal
values get equal pseudonyms in all documents, and different ones stay different.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key. A deployment passes its own.
KEY = "netloom"
ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
#: kind: expression. Where several match at a place, the first does.
PATTERNS = {
    "mail": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)+",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}\\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\.?\\d)",
    "date": "(?<![\\d./-])(?:\\d{4}-\\d\\d-\\d\\d|\\d\\d\\.\\d\\d\\.\\d{4}|\\d\\d/\\d\\d/\\d{4})(?![/-]?\\d)",
    "ssn": "(?<![\\d-])\\d{3}-\\d\\d-\\d{4}(?!-?\\d)",
    "card": "(?<!\\d)(?:\\d{13,19}|\\d{4}(?:[ -]\\d{4}){2,3}(?:[ -]\\d{1,3})?|\\d{4}[ -]\\d{6}[ -]\\d{5})(?!\\d)",
    "phone": "(?<![\\d+])(?:\\+\\d{1,3}[ .-]?(?:\\(\\d{2,4}\\)[ .-]?)?\\d{2,4}(?:[ .-]?\\d{2,4}){1,4}|\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}|\\d{3}[.-]\\d{3}[.-]\\d{4})(?!\\d)",
}
#: Dates by their separator.
DATE_FORMATS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, kind: str, *parts: str) -> str:
    """SQL: a number below 2^60 from the key and the parts."""
    return f"CAST(conv(substr(sha2(concat_ws('|', {_quoted(key)}, '{kind}', {', '.join(parts)}), 256), 1, 15), 16, 10) AS BIGINT)"


def _numbers(key: str, kind: str, value: str, a: int, b: int) -> str:
    """SQL: a permutation of the integers below a * b."""
    left = f"named_struct('a', pmod(s.a + {_prf(key, kind, 'r', 's.b')}, {a}L), 'b', s.b)"
    right = f"named_struct('a', s.a, 'b', pmod(s.b + {_prf(key, kind, 'r', 's.a')}, {b}L))"
    start = f"named_struct('a', CAST(floor(({value}) / {b}L) AS BIGINT), 'b', CAST(pmod({value}, {b}L) AS BIGINT))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> IF(r % 2 = 1, {left}, {right}), s -> s.a * {b}L + s.b)"


def _characters(key: str, kind: str, value: str) -> str:
    """SQL: a permutation of the strings with the same pattern of digits, small and capital letters and others."""
    byte = f"CAST(conv(substr(sha2(concat_ws('|', {_quoted(key)}, '{kind}', r, i div 32, OTHER), 256), 2 * (i % 32) + 1, 2), 16, 10) AS INT)"
    moved = "CASE WHEN c >= '0' AND c <= '9' THEN chr(48 + (ascii(c) - 48 + {k}) % 10) WHEN c >= 'a' AND c <= 'z' THEN chr(97 + (ascii(c) - 97 + {k}) % 26) WHEN c >= 'A' AND c <= 'Z' THEN chr(65 + (ascii(c) - 65 + {k}) % 26) ELSE c END"
    half = lambda own, other: f"IF({own} = '', '', array_join(transform(split({own}, ''), (c, i) -> {moved.format(k=byte.replace('OTHER', other))}), ''))"
    turn = f"IF(r % 2 = 1, named_struct('a', {half('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {half('s.b', 's.a')}))"
    start = f"named_struct('a', substr({value}, 1, CAST(length({value}) / 2 AS INT)), 'b', substr({value}, CAST(length({value}) / 2 AS INT) + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {turn}, s -> concat(s.a, s.b))"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body with value bound to name, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _refilled(shape: str, digits: str) -> str:
    """SQL: shape with its letters and digits, in order, replaced by those of a string."""
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (s, c) -> IF(c RLIKE '[A-Za-z0-9]', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _luhn(digits: str, skip: int) -> str:
    """SQL: the Luhn sum of a digit string whose check digit is (skip 0) or isn't (skip 1) within it."""
    d = "CAST(c AS INT)"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF((i + {skip}) % 2 = 0, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d}))), 0, (s, x) -> s + x)"


def _mod97(text: str) -> str:
    """SQL: a string of digits and capital letters as a number (A is 10), modulo 97."""
    return f"aggregate(split({text}, ''), 0, (s, c) -> IF(c >= 'A', (s * 100 + ascii(c) - 55) % 97, (s * 10 + CAST(c AS INT)) % 97))"


def _valid_day(m: str, form: str) -> str:
    return f"CAST(try_to_date({m}, '{form}') AS DATE)"


def pseudonym(key: str) -> str:
    """SQL: of a match m, array(kind, pseudonym); kind is null and m stays for what isn't valid."""
    none = "array(CAST(NULL AS STRING), m)"
    made = lambda kind, out: f"array('{kind}', {out})"
    mail = made("mail", f"concat({_characters(key, 'mail', 'substring_index(m, chr(64), 1)')}, '@', substring_index(m, '@', -1))")
    ip = made("ip", _bound("aggregate(split(m, '[.]'), 0L, (s, x) -> s * 256 + CAST(x AS BIGINT))", "v", _bound(_numbers(key, "ip", "v", 65536, 65536), "o", "concat_ws('.', shiftright(o, 24), shiftright(o, 16) & 255, shiftright(o, 8) & 255, o & 255)")))
    # days from 1800 to 2199 are 146097 = 189 * 773
    day = "datediff(d, DATE'1800-01-01')"
    dates = "CASE " + " ".join(
        f"WHEN instr(m, '{sep}') > 0 THEN " + _bound(f"IF(length(m) = 10, {_valid_day('m', form)}, NULL)", "d", f"IF(d BETWEEN DATE'1800-01-01' AND DATE'2199-12-31', {made('date', f'''date_format(date_add(DATE'1800-01-01', CAST({_numbers(key, 'date', day, 189, 773)} AS INT)), '{form}')''')}, {none})")
        for sep, form in DATE_FORMATS.items()
    ) + f" ELSE {none} END"
    # 898 areas (not 000, 666 and from 900), 99 groups, 9999 serials
    area, group, serial = (f"CAST(substr(m, {a}, {n}) AS BIGINT)" for a, n in ((1, 3), (5, 2), (8, 4)))
    number = f"(({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    back = "concat_ws('-', lpad(CAST(floor(o / 989901L) + IF(floor(o / 989901L) >= 665, 2, 1) AS BIGINT), 3, '0'), lpad(CAST(floor(o / 9999L) % 99 + 1 AS BIGINT), 2, '0'), lpad(o % 9999 + 1, 4, '0'))"
    ssn = f"IF({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {made('ssn', _bound(_numbers(key, 'ssn', number, 898, 989901), 'o', back))}, {none})"
    digits = "regexp_replace(m, '[^0-9]', '')"
    card = _bound(digits, "d", f"IF({_luhn('d', 0)} % 10 = 0, {made('card', _bound(_characters(key, 'card', 'left(d, length(d) - 1)'), 'p', _refilled('m', f'concat(p, pmod(-({_luhn(chr(112), 1)}), 10))')))}, {none})")
    keep = "IF(length(d) > 10, length(d) - 10, IF(left(m, 1) = '+', 2, 0))"
    phone = _bound(digits, "d", f"IF(length(d) BETWEEN 7 AND 15, {made('phone', _bound(f'concat(left(d, {keep}), {_characters(key, chr(112), f'''substr(d, {keep} + 1)''')})', 'p', _refilled('m', 'p')))}, {none})")
    plain = "replace(m, ' ', '')"
    iban = _bound(plain, "d", f"IF(length(d) BETWEEN 15 AND 34 AND {_mod97('concat(substr(d, 5), left(d, 4))')} = 1, {made('iban', _bound(_characters(key, 'iban', 'substr(d, 5)'), 'p', _refilled('m', f'''concat(left(d, 2), lpad(98 - {_mod97('concat(p, left(d, 2), chr(48), chr(48))')}, 2, chr(48)), p)''')))}, {none})")
    test = lambda kind: f"m RLIKE {_quoted('^(?:' + PATTERNS[kind] + ')$')}"
    return f"CASE WHEN instr(m, '@') > 0 THEN {mail} WHEN m RLIKE '^[A-Z]' THEN {iban} WHEN {test('ip')} THEN {ip} WHEN {test('date')} THEN {dates} WHEN {test('ssn')} THEN {ssn} WHEN {test('card')} THEN {card} ELSE {phone} END"


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with the text's personal data replaced and `found`, the kinds of what was replaced, in order.

    A null text stays null and an empty one empty, with nothing found. Rows are handled one by one, so that repeated rows
    get equal results. A column `found` of docs is replaced, other extra columns stay.
    """
    pattern = _quoted("|".join(PATTERNS.values()))
    docs = docs.drop("found")
    some = F.col(text).rlike("[0-9@]")
    out = (
        docs.withColumn("_hits", F.when(some, F.expr(f"transform(regexp_extract_all({_name(text)}, {pattern}, 0), m -> {pseudonym(key)})")))
        .withColumn("_parts", F.when(F.size("_hits") > 0, F.expr(f"split({_name(text)}, {pattern}, -1)")))
    )
    joined = F.expr("array_join(zip_with(_parts, _hits, (p, h) -> concat(p, coalesce(get(h, 1), ''))), '')")
    return out.select(
        *[F.when(F.col("_parts").isNull(), F.col(text)).otherwise(joined).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.expr("coalesce(filter(transform(_hits, h -> get(h, 0)), k -> k IS NOT NULL), CAST(array() AS ARRAY<STRING>))").alias("found"),
    )


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def private_digest(docs: DataFrame) -> DataFrame:
    out = pseudonymised(docs.select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(found, k -> k = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, "text")
