"""Exact deduplication by content-defined chunk recipes, in DataFrame and SQL functions only.

White space is normalised, and each text is cut into chunks where the hash of two neighbouring words says so: a copy of a
passage is cut at the same places wherever it stands. A chunk's identifier is a pair of 64-bit hashes; a text's recipe is
the ordered list of its chunks' identifiers. The identifiers are verified: each distinct chunk is moved once, grouped by
its text, and no identifier may stand for two texts (else other hash seeds are taken). Equal recipes then mean equal
texts, and only recipes, about a fortieth of the texts, are moved and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_one, written

#: A chunk has about this many words (a power of two).
CHUNK_WORDS = 128
WHITE = "[\\x20\\x09-\\x0D]+"


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `normal`, the normalised text, and `chunks`, which joined by spaces give `normal`."""
    cut = f"IF(xxhash64(w, get(words, i + 1)) & {CHUNK_WORDS - 1} = 0 AND i + 1 < size(words), i + 1, 0)"
    return (
        docs.withColumn("normal", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " "))
        .withColumn("words", F.split("normal", " "))
        .withColumn("edges", F.expr(f"concat(array(0), filter(transform(words, (w, i) -> {cut}), x -> x > 0), array(size(words)))"))
        .withColumn("chunks", F.expr("zip_with(slice(edges, 1, size(edges) - 1), slice(edges, 2, size(edges) - 1), (a, b) -> array_join(slice(words, a + 1, b - a), ' '))"))
        .drop("words", "edges")
    )


def identifiers(seed: int) -> str:
    return f"flatten(transform(chunks, c -> array(xxhash64({seed}, c), xxhash64(c, {seed + 1}))))"


def verified(chunks: DataFrame, seed: int) -> bool:
    """Whether no identifier stands for two chunks. Each distinct chunk is moved once. (A plain explode would be given a filter that cuts every text again, and again for every word.)"""
    each = chunks.select(F.explode_outer("chunks").alias("c")).select(F.expr(f"xxhash64({seed}, c)").alias("a"), F.expr(f"xxhash64(c, {seed + 1})").alias("b"), "c")
    return each.distinct().groupBy("a", "b").count().where("count > 1").isEmpty()


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text. The row with the smallest id of a group stays; of repeated rows with that id exactly
    one; rows with a null id stay only if their group has no other. An empty table gives an empty result. Only id and
    text are read, so extra columns don't matter.
    """
    base = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    seed = 42
    while not verified(chunked(base.select("text")).select("chunks"), seed):
        seed += 2
    recipes = chunked(base).select("id", F.monotonically_increasing_id().alias("row"), F.expr(identifiers(seed)).alias("recipe"), F.sha2("normal", 256).alias("text_sha256"))
    recipes = written(recipes, "recipes")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))
    groups = recipes.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return with_one(recipes, groups.withColumn("n", F.col("group_size")), "recipe", "n").select(F.col("id").alias(id_column), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
