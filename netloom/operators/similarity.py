"""Weighted Jaccard similarity of sets, and a banded MinHash index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_jaccard(sets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs of sets with a common element: the weights that both give to common elements over all weights."""
    total = sets.groupBy("set_id").agg(F.sum("w").alias("t"))
    both = sets.alias("x").join(sets.alias("y"), "elem").where("x.set_id < y.set_id")
    both = both.groupBy(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).agg(F.sum(F.col("x.w") + F.col("y.w")).alias("shared"))
    if pairs is not None:
        both = both.join(pairs, ["a", "b"], "left_semi")
    out = both.join(total.select(F.col("set_id").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("set_id").alias("b"), F.col("t").alias("tb")), "b")
    return out.select("a", "b", F.round(F.col("shared") / (F.col("ta") + F.col("tb")), 9).alias("similarity"))


def top_similar(similar: DataFrame, k: int) -> DataFrame:
    """(set_id, other, similarity, rank): for each set the k most similar, ties to the greater id."""
    both = similar.select(F.col("a").alias("set_id"), F.col("b").alias("other"), "similarity").union(similar.select("b", "a", "similarity"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("similarity"), F.desc("other")))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def signatures(sets: DataFrame, n: int = 32, seed: int = 0) -> DataFrame:
    """(set_id, signature): for each permutation the element with the least hash over its share of the set's weight."""
    share = sets.join(sets.groupBy("set_id").agg(F.sum("w").alias("t")), "set_id").withColumn("s", F.col("w") / F.col("t"))
    hashes = [F.xxhash64("elem", F.lit(seed + k)) for k in range(n)]
    score = lambda h: -F.log((F.pmod(h, F.lit(1 << 53)) + 1) / float(1 << 53)) / F.col("s")
    mins = share.groupBy("set_id").agg(*[F.min_by(h, F.struct(score(h), h)).alias(f"h{k}") for k, h in enumerate(hashes)])
    return mins.select("set_id", F.array(*[f"h{k}" for k in range(n)]).alias("signature"))


def banded(sigs: DataFrame, rows: int) -> DataFrame:
    """(band, hash, set_id)."""
    n = F.size("signature")
    return sigs.select("set_id", F.posexplode(F.transform(F.sequence(F.lit(1), n, F.lit(rows)), lambda k: F.xxhash64(F.slice("signature", k, rows)))).alias("band", "hash"))


def candidates(sigs: DataFrame, rows: int = 2) -> DataFrame:
    """(a, b), a < b, of sets that share a band."""
    b = banded(sigs, rows)
    return b.alias("x").join(b.alias("y"), ["band", "hash"]).where("x.set_id < y.set_id").select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()


def merged_sets(sets: DataFrame, groups: DataFrame, how: str = "sum") -> DataFrame:
    """Sets under their groups' ids, with weights summed, or the greatest: groups (set_id, group)."""
    agg = F.sum if how == "sum" else F.max
    return sets.join(groups, "set_id").groupBy(F.col("group").alias("set_id"), "elem").agg(agg("w").alias("w"))


@dataclass(frozen=True)
class Index:
    """A banded MinHash index of weighted sets (set_id, elem, w). Immutable: insert and delete give new ones; what they cost is the new sets' signatures."""

    sets: DataFrame
    bands: DataFrame
    n: int
    rows: int

    @classmethod
    def of(cls, sets: DataFrame, n: int = 64, rows: int = 2) -> Index:
        return cls(sets, banded(signatures(sets, n), rows), n, rows)

    def ids(self) -> DataFrame:
        return self.sets.select("set_id").distinct()

    def size(self) -> DataFrame:
        """One row: the number of sets."""
        return self.sets.agg(F.count_distinct("set_id").alias("size"))

    def contains(self, ids: DataFrame) -> DataFrame:
        """ids (set_id) with `known`."""
        return ids.join(self.ids().withColumn("known", F.lit(True)), "set_id", "left").select("set_id", F.coalesce("known", F.lit(False)).alias("known"))

    def insert(self, more: DataFrame) -> Index:
        """With more sets; those whose id is known replace the old ones."""
        old = self.delete(more.select("set_id").distinct())
        return Index(old.sets.unionByName(more), old.bands.unionByName(banded(signatures(more, self.n), self.rows)), self.n, self.rows)

    def delete(self, ids: DataFrame) -> Index:
        return Index(self.sets.join(ids.select("set_id"), "set_id", "left_anti"), self.bands.join(ids.select("set_id"), "set_id", "left_anti"), self.n, self.rows)

    def query(self, asked: DataFrame, k: int) -> DataFrame:
        """(set_id, other, similarity, rank): for each asked set (set_id, elem, w) the k most similar indexed ones that share a band with it, ties to the greater id."""
        near = banded(signatures(asked, self.n), self.rows).alias("x").join(self.bands.alias("y"), ["band", "hash"]).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
        total = lambda s, key, name: s.groupBy(F.col("set_id").alias(key)).agg(F.sum("w").alias(name))
        x, y = asked.select(F.col("set_id").alias("a"), "elem", F.col("w").alias("wa")), self.sets.select(F.col("set_id").alias("b"), "elem", F.col("w").alias("wb"))
        shared = near.join(x, "a").join(y, ["b", "elem"]).groupBy("a", "b").agg(F.sum(F.col("wa") + F.col("wb")).alias("shared"))
        out = shared.join(total(asked, "a", "ta"), "a").join(total(self.sets, "b", "tb"), "b").select(F.col("a").alias("set_id"), F.col("b").alias("other"), F.round(F.col("shared") / (F.col("ta") + F.col("tb")), 9).alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("similarity"), F.desc("other")))
        return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    def query_ids(self, ids: DataFrame, k: int) -> DataFrame:
        """query() for indexed sets, by their ids; a set isn't its own neighbour."""
        found = self.query(self.sets.join(ids.select("set_id"), "set_id", "left_semi"), k + 1).where("set_id <> other")
        rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("similarity"), F.desc("other")))
        return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
