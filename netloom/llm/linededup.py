"""Line deduplication by winnowing over line hashes, in DataFrame and SQL functions only.

A document's lines without the blank ones are a sequence of line hashes. From each line starts a window: as few lines as
make MIN_WORDS words or MIN_LINES lines. A window's fingerprint is the least hash in it, so two equal windows always share
a fingerprint and most lines are the fingerprint of none. Fingerprints are counted; those that occur at one place only
are done. At the others the positions are joined: windows with equal lines match, and each match is extended line by line
to both sides while the lines are equal. All lines of a run that matches an earlier one go.

To the left, and to the right as far as a later line starts a window within the match, the extension is made of further
matched windows. Beyond the end of the last window within a match at most MIN_LINES - 1 lines are left. A window that may
be the last one is therefore joined with its next lines as well, once for each length.

Hence exactly: a line goes if it lies in a run of lines that is at least a window long and equals, line by line, a run
that starts earlier, in the order of (document id, position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_one, written

#: A window is as few lines as have MIN_WORDS words or are MIN_LINES.
MIN_LINES, MIN_WORDS = 3, 20


def hashed_lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, th (hash of the text), and of its lines that aren't blank: lh, their hashes, nb, their places among all lines, ends, for each where its window ends (null without a full one)."""
    length = "NULL"
    for n in range(MIN_LINES, 0, -1):
        words = " + ".join(f"get(wc, s + {k})" for k in range(n))
        full = "TRUE" if n == MIN_LINES else f"{words} >= {MIN_WORDS}"
        length = f"CASE WHEN s + {n} <= size(lh) AND {full} THEN s + {n} ELSE {length} END"
    return (
        docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("ls"))
        .withColumn("ls", F.expr("transform(ls, x -> btrim(x, ' \\t\\r\\f\\u000b'))"))
        .withColumn("nb", F.expr("filter(transform(ls, (x, i) -> IF(x = '', -1, i)), i -> i >= 0)"))
        .withColumn("lh", F.expr("transform(nb, i -> xxhash64(get(ls, i)))"))
        .withColumn("wc", F.expr("transform(nb, i -> length(get(ls, i)) - length(replace(get(ls, i), ' ', '')) + 1)"))
        .select("id", "th", "lh", "nb", F.expr(f"transform(lh, (x, s) -> {length})").alias("ends"))
    )


def fingerprints(lines: DataFrame) -> DataFrame:
    """id, th, place, least: the least hash of each window and where it stands."""
    window = "slice(lh, s + 1, e - s)"
    each = f"filter(transform(ends, (e, s) -> IF(e IS NULL, NULL, struct(CAST(s + array_position({window}, array_min({window})) AS INT) AS place, array_min({window}) AS least))), w -> w IS NOT NULL)"
    return lines.select("id", "th", F.explode_outer(F.expr(f"array_distinct({each})")).alias("p")).select("id", "th", "p.*")


def runs(lines: DataFrame) -> DataFrame:
    """id, th, start, least, lines (hashes), at (places): each window, and with its next lines, as many as may follow the last window of a match."""
    more = f"filter(sequence(0, {MIN_LINES - 1}), k -> e + k <= size(lh) AND (k = 0 OR coalesce(get(ends, s + 1) > e + k, TRUE)))"
    each = f"flatten(transform(ends, (e, s) -> IF(e IS NULL, array(), transform({more}, k -> struct(s AS start, array_min(slice(lh, s + 1, e - s)) AS least, slice(lh, s + 1, e + k - s) AS lines, slice(nb, s + 1, e + k - s) AS at)))))"
    return lines.select("id", "th", F.explode_outer(F.expr(each)).alias("w")).select("id", "th", "w.*")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), gone: the places of the lines to delete. A row for each document that loses lines."""
    lines = written(hashed_lines(docs, id_column, text), "lines")
    # the same document in repeated rows is one document
    twice = fingerprints(lines).groupBy("least").agg(F.min(F.struct("id", "th", "place")).alias("a"), F.max(F.struct("id", "th", "place")).alias("b")).where("a != b").select("least")
    each = written(runs(lines).join(twice, "least", "left_semi").select("id", "th", "start", "lines", "at"), "runs")
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("th"), F.col("start"))
    first = each.groupBy("lines").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first != last").select("lines", "first", "n")
    later = with_one(each, first, "lines", "n").where(place > F.col("first"))
    return later.select("id", "th", F.explode("at").alias("at")).groupBy("id", "th").agg(F.collect_set("at").alias("gone"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later repeats deleted from their text, and n_lines and n_deleted.

    A null text stays null and has no lines; blank lines stay; a very long text is handled whole, as one row of hashes; rows that repeat one document (same id, same text) get the
    same result; null ids come last in the order. A text without repeats isn't changed by a byte. Columns n_lines and
    n_deleted of docs are replaced, other extra columns stay.
    """
    docs = docs.drop("n_lines", "n_deleted")
    gone = repeated_lines(docs, id_column, text).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    joined = docs.withColumn("_own", F.xxhash64(text)).join(gone, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), "left").withColumn("_lines", F.split(text, "\n"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> get(_lines, i)), '\n')")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_deleted"),
    )


def lines_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def lines_filtered(docs: DataFrame) -> DataFrame:
    """docs with repeats deleted; a document of which nothing but white space is left goes too."""
    out = without_repeats(docs)
    return out.where((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


def kept_sql(documents: str) -> str:
    """DuckDB: doc_id, n_lines, n_deleted and text of each row of `documents`, whose ids are unique."""
    return f"""
SELECT doc_id, coalesce(max(total), 0) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), CASE WHEN count(line) > 0 THEN '' END) AS text
FROM (
  SELECT d.doc_id, a.i, a.line, a.total, g.i IS NOT NULL AS gone
  FROM {documents} d LEFT JOIN (
    SELECT doc_id, len(ls) AS total, unnest(ls) AS line, unnest(range(len(ls))) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents} WHERE text IS NOT NULL)) a ON a.doc_id = d.doc_id
  LEFT JOIN (
    SELECT DISTINCT doc_id, unnest(places) AS i FROM (
      SELECT doc_id, p, places, min((doc_id, p)) OVER (PARTITION BY ls) AS first FROM (
        SELECT doc_id, p, list_slice([l0, l1, l2, l3, l4], 1, n + k) AS ls, list_slice([i, i1, i2, i3, i4], 1, n + k) AS places FROM (
          SELECT *, unnest([0, 1, 2]) AS k FROM (
            SELECT *, CASE WHEN w0 >= {MIN_WORDS} THEN 1 WHEN i1 IS NOT NULL AND w0 + w1 >= {MIN_WORDS} THEN 2 WHEN i2 IS NOT NULL THEN 3 END AS n FROM (
              SELECT doc_id, i, p, l AS l0, w AS w0, lead(l) OVER o AS l1, lead(w) OVER o AS w1, lead(l, 2) OVER o AS l2, lead(l, 3) OVER o AS l3, lead(l, 4) OVER o AS l4,
                     lead(i) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(i, 3) OVER o AS i3, lead(i, 4) OVER o AS i4 FROM (
                SELECT doc_id, i, l, length(l) - length(replace(l, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (
                  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS l FROM (
                    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents} WHERE text IS NOT NULL)))
                WHERE l <> '')
              WINDOW o AS (PARTITION BY doc_id ORDER BY p)))
          WHERE n IS NOT NULL)
        WHERE list_extract([i, i1, i2, i3, i4], n + k) IS NOT NULL))
    WHERE (doc_id, p) > first) g ON g.doc_id = a.doc_id AND g.i = a.i)
GROUP BY doc_id
"""


ORACLE = f"SELECT doc_id, n_lines, n_deleted, sha256(coalesce(text, '')) AS text_sha256 FROM ({kept_sql('documents')})"
