"""Scalar, array and scan functions as columns and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manhattan(p: Column, q: Column) -> Column:
    """L1 distance of two points, given as arrays; of different dimensions an error."""
    total = F.aggregate(F.zip_with(p.cast("array<double>"), q.cast("array<double>"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(p) == F.size(q), total).otherwise(F.raise_error(F.lit("points of different dimensions")).cast("double"))


def snake_case(name: Column) -> Column:
    """An underscore before a capital that a small letter follows, not at the start; then small letters."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z][a-z])", "_"))


def size_string(size: Column) -> Column:
    """Bytes with a unit and one decimal."""
    out = F.format_string("%.1f TB", size / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", size / 1024.0**k)).otherwise(out)
    return out


def dense(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the ids of a column renumbered from 0 without gaps. The distinct values are ranked in ranges, not in one task."""
    from ..operators.transform import running

    values = df.select(column).distinct().withColumn("_one", F.lit(1))
    return df.join(running(values, "_one", [column], name).select(column, F.col(name).cast("long").alias(name)), column)


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, items): each key's distinct values in the order in which they come first (ties by value)."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda s: s[value]).alias("items"))


def dict_sum(*parts: DataFrame) -> DataFrame:
    """(k, v): sums over several (k, v)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("k").agg(F.sum("v").alias("v"))


def diagonals(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(x, y, k): cells by x + y, then x."""
    cells = spark.range(width).withColumnRenamed("id", "x").crossJoin(F.broadcast(spark.range(height).withColumnRenamed("id", "y")))
    return cells.withColumn("k", (F.row_number().over(Window.orderBy(F.col("x") + F.col("y"), "x")) - 1).cast("long"))


def equispaced(spark: SparkSession, width: int, height: int, k: int) -> DataFrame:
    """(x, y): k cells of a lattice in row order, one every width * height / k cells from the first on, halves rounded to even; for k = 1 the cell at half the width and height."""
    cells = width * height
    if width <= 0 or height <= 0 or k > cells:
        raise ValueError(f"{k} points don't fit on a lattice of {width} x {height}")
    if k == 1:
        return spark.range(1).select(F.lit(width // 2).cast("long").alias("x"), F.lit(height // 2).cast("long").alias("y"))
    at = F.least(F.lit(cells - 1), F.bround(F.col("id") * (cells / k), 0).cast("long"))
    return spark.range(k).select(at.alias("c")).distinct().select((F.col("c") % width).alias("x"), F.floor(F.col("c") / width).cast("long").alias("y"))


def spike_rates(spikes: DataFrame, trim_counts: bool = False, digits: int = 9) -> DataFrame:
    """(node, rate): spikes over the span of the timestamps between the 5th and 95th percentile; all spikes are counted, or those within."""
    ends = spikes.agg(F.percentile("ts", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    inside = spikes.crossJoin(F.broadcast(ends)).where((F.col("ts") >= F.col("p")[0]) & (F.col("ts") <= F.col("p")[1]))
    span = inside.agg((F.max("ts") - F.min("ts")).alias("span"))
    counted = (inside if trim_counts else spikes).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(span)).select("node", F.round(F.col("n") / F.col("span"), digits).alias("rate"))


def batch_rates(values: DataFrame) -> DataFrame:
    """(layer, neuron, rate): sums over the number of the layer's batches."""
    batches = values.groupBy("layer").agg(F.count_distinct("batch").alias("n"))
    return values.groupBy("layer", "neuron").agg(F.sum("v").alias("v")).join(batches, "layer").select("layer", "neuron", F.round(F.col("v") / F.col("n"), 6).alias("rate"))


def in_polygon(x: Column, y: Column, corners: list[tuple[int, int]]) -> Column:
    """Whether a point lies within or on a convex polygon, given by its corners in counter-clockwise order; of one corner that point, of two their segment."""
    sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
    box = x.between(min(c[0] for c in corners), max(c[0] for c in corners)) & y.between(min(c[1] for c in corners), max(c[1] for c in corners))
    for (ax, ay), (bx, by) in sides:
        box = box & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return box


def counting_sort(df: DataFrame, key: str, order: str, name: str = "at") -> DataFrame:
    """df with each row's place, from 0, when it is sorted by a whole number of a small range, rows of equal keys in `order`: the rows of lesser keys are counted, so that only rows of one key are ordered among themselves, in ranges."""
    from ..operators.transform import running

    return running(df.withColumn("_one", F.lit(1)), "_one", [key, order], name).withColumn(name, F.col(name).cast("long")).drop("_one")
