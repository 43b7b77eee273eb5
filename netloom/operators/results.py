"""Analysis of experiment records: (graph, technique, metrics). A technique is partitioner-placer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partitioner(technique: str = "technique") -> Column:
    return F.split(technique, "-", 2)[0]


def normalised(records: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """Each metric over the best, the least, of its graph; null stays null."""
    best = Window.partitionBy("graph")
    return records.select("graph", "technique", *[F.round(F.col(m) / F.min(m).over(best), digits).alias(m) for m in metrics])


def technique_averages(records: DataFrame, metrics: list[str], strict: bool = True) -> DataFrame:
    """Means over graphs of normalised metrics, over the best mean. strict: one missing value makes a mean null."""
    n = normalised(records, metrics, 15)
    mean = lambda m: F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)) if strict else F.avg(m)
    means = n.groupBy("technique").agg(*[mean(m).alias(m) for m in metrics])
    best = means.agg(*[F.min(m).alias(f"best_{m}") for m in metrics])
    return means.crossJoin(F.broadcast(best)).select("technique", *[F.round(F.col(m) / F.col(f"best_{m}"), 6).alias(m) for m in metrics])


def with_elp(records: DataFrame) -> DataFrame:
    return records.withColumn("elp", F.col("energy") * F.col("latency"))


def best_placements(records: DataFrame) -> DataFrame:
    """Of each graph and partitioner the technique with the least energy-latency product; ties to the first name."""
    w = Window.partitionBy("graph", partitioner()).orderBy(F.col("elp").asc_nulls_last(), "technique")
    return with_elp(records).withColumn("k", F.row_number().over(w)).where("k = 1").select("graph", partitioner().alias("partitioner"), "technique")


def undominated(records: DataFrame, metric: str = "elp") -> DataFrame:
    """Techniques that no other of the same partitioner beats in every graph; a missing value loses to any other, and two missing ones count for the rival, as a beaten pair does."""
    names = records.select("technique").distinct()
    graphs = records.select("graph").distinct()
    full = names.crossJoin(graphs).join(records.select("technique", "graph", metric), ["technique", "graph"], "left").withColumn("p", partitioner())
    x, y = full.alias("x"), full.alias("y")
    beaten = (F.col(f"x.{metric}").isNull()) | (F.col(f"y.{metric}") < F.col(f"x.{metric}"))
    lost = x.join(y, (F.col("x.graph") == F.col("y.graph")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.technique") != F.col("y.technique")))
    lost = lost.groupBy(F.col("x.technique").alias("technique"), F.col("y.technique").alias("rival")).agg(F.bool_and(F.coalesce(beaten & F.col(f"y.{metric}").isNotNull(), F.lit(False))).alias("lost"))
    return names.join(lost.where("lost"), "technique", "left_anti")


def zscores(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Population z-scores of each metric's log10 within its graph."""
    w = Window.partitionBy("graph")
    return records.select("graph", "technique", *[F.when(F.stddev_pop(F.log10(m)).over(w) > 0, (F.log10(m) - F.avg(F.log10(m)).over(w)) / F.stddev_pop(F.log10(m)).over(w)).otherwise(0.0).alias(m) for m in metrics])


def spearman(scores: DataFrame, x: str, y: str, by: str = "technique", digits: int = 9) -> DataFrame:
    """Rank correlation of two columns in each group; ties share their mean rank."""
    rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2
    rounded = scores.select(by, F.round(x, digits).alias("_x"), F.round(y, digits).alias("_y"))
    ranked = rounded.select(by, rank("_x").alias("rx"), rank("_y").alias("ry"))
    return ranked.groupBy(by).agg((F.round(F.corr("rx", "ry"), 6) + F.lit(0.0)).alias("spearman"))


def loglog_fit(records: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept and Pearson correlation of log10 y over log10 x, positive values only."""
    good = records.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return good.agg(F.round(F.regr_slope("ly", "lx"), 6).alias("slope"), F.round(F.regr_intercept("ly", "lx"), 6).alias("intercept"), F.round(F.corr("lx", "ly"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


def huber_fit(records: DataFrame, x: str, y: str, epsilon: float = 1.35, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of log10 y over log10 x by reweighted least squares with Huber's weights; a pass over the rows for each round."""
    good = records.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    slope, intercept = good.agg(F.regr_slope("ly", "lx"), F.regr_intercept("ly", "lx")).first()
    for _ in range(rounds):
        off = F.abs(F.col("ly") - (F.lit(slope) * F.col("lx") + F.lit(intercept)))
        scale = good.agg(F.percentile(off, F.lit(0.5))).first()[0] / 0.6745 or 1e-12
        w = F.when(off <= epsilon * scale, 1.0).otherwise(epsilon * scale / off)
        s, sx, sy, sxx, sxy = good.agg(F.sum(w), F.sum(w * F.col("lx")), F.sum(w * F.col("ly")), F.sum(w * F.col("lx") * F.col("lx")), F.sum(w * F.col("lx") * F.col("ly"))).first()
        new = (s * sxy - sx * sy) / (s * sxx - sx * sx)
        moved, slope = abs(new - slope), new
        intercept = (sy - slope * sx) / s
        if moved < 1e-10:
            break
    return slope, intercept


def validation_error(records: DataFrame, model: str, measured: str) -> DataFrame:
    """One row: mean, least and greatest relative error in percent."""
    e = F.abs(F.col(model) - F.col(measured)) / F.col(measured) * 100
    return records.agg(F.round(F.avg(e), 6).alias("mean_error"), F.round(F.min(e), 6).alias("min_error"), F.round(F.max(e), 6).alias("max_error"), F.round(F.percentile(e, F.lit(0.5)), 6).alias("median_error"))


def same_best(records: DataFrame, model: str, measured: str) -> DataFrame:
    """One row: in how many graphs both columns name the same best technique (ties to the first name)."""
    each = records.groupBy("graph").agg((F.min_by("technique", F.struct(model, "technique")) == F.min_by("technique", F.struct(measured, "technique"))).alias("same"))
    return each.agg(F.count_if("same").alias("same_best"), F.count(F.lit(1)).alias("graphs"))


def histogram(values: DataFrame, value: str, count: str, bins: int, logarithmic: bool = False) -> DataFrame:
    """(bin, n): equal bins over the positive values, or over their logarithms, each counted `count` times; the last bin is closed."""
    good = values.where(F.col(value) > 0)
    good = good.withColumn(value, F.log10(value)) if logarithmic else good
    ends = good.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))
    return good.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.sum(count).cast("long").alias("n"))


def lognormal_fit(values: DataFrame, value: str, count: str) -> DataFrame:
    """One row: shape, scale and coefficient of variation of a lognormal by maximum likelihood."""
    good = values.where(F.col(value) > 0).select(F.ln(value).alias("l"), F.col(count).alias("c"))
    m = good.agg((F.sum(F.col("l") * F.col("c")) / F.sum("c")).alias("m"), (F.sum(F.col("l") * F.col("l") * F.col("c")) / F.sum("c")).alias("q"))
    variance = F.col("q") - F.col("m") * F.col("m")
    return m.select(F.round(F.sqrt(variance), 6).alias("shape"), F.round(F.exp("m"), 6).alias("scale"), F.round(F.sqrt(F.exp(variance) - 1), 6).alias("cv"))


def cutoff(values: DataFrame, value: str, count: str, fraction: float) -> DataFrame:
    """One row: of all values, each `count` times, in order, the one at a fraction of the way, and the sum of those before it."""
    by = values.groupBy(value).agg(F.sum(count).alias("c"))  # a row for each distinct value
    total = by.agg(F.floor(F.sum("c") * fraction).alias("k"), F.sum(F.col(value) * F.col("c")).alias("total"))
    run = by.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(F.broadcast(total))
    below = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("before")))
    return run.agg(F.first("k").cast("long").alias("cut_count"), F.min(F.when(F.col("before") + F.col("c") > F.col("k"), F.col(value))).alias("cut_value"), F.sum(below * F.col(value)).alias("cut_total"), F.first("total").alias("total"))


def within_band(records: DataFrame, metric: str, sigma: float = 0.5) -> DataFrame:
    """Records whose metric is within sigma population deviations of their graph's mean; a single record of a graph stays."""
    w = Window.partitionBy("graph")
    keep = (F.count(metric).over(w) == 1) | (F.abs(F.col(metric) - F.avg(metric).over(w)) <= sigma * F.stddev_pop(metric).over(w))
    return records.withColumn("_keep", keep).where("_keep AND " + metric + " IS NOT NULL").drop("_keep")


def init_reduction(records: DataFrame, initial: str, final: str) -> DataFrame:
    """(graph, technique, reduction): what refinement took off, in percent of the initial value."""
    return records.select("graph", "technique", F.round((F.col(initial) - F.col(final)) / F.col(initial) * 100, 6).alias("reduction"))


def relabelled(records: DataFrame, labels: dict[str, str], column: str = "technique") -> DataFrame:
    """records with the values of a column replaced by their labels; those without one stay."""
    if not labels:
        return records
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return records.withColumn(column, F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)))


def ratios(records: DataFrame, least: list[str], greatest: list[str] = (), by: str = "graph") -> DataFrame:  # type: ignore[assignment]
    """Each metric over the least of its group, or over the greatest for those in `greatest`."""
    w = Window.partitionBy(by)
    return records.select(by, "technique", *[F.round(F.col(m) / f(m).over(w), 6).alias(m) for names, f in ((least, F.min), (greatest, F.max)) for m in names])


def partition_ratios(records: DataFrame, metrics: list[str], order: str = "technique") -> DataFrame:
    """(graph, partitioner, metrics over the graph's least): of a partitioner's records of a graph the first counts."""
    first = records.withColumn("partitioner", partitioner()).withColumn("_k", F.row_number().over(Window.partitionBy("graph", "partitioner").orderBy(order))).where("_k = 1")
    w = Window.partitionBy("graph")
    return first.select("graph", "partitioner", *[F.round(F.col(m) / F.min(m).over(w), 6).alias(m) for m in metrics])


def placement_ratios(records: DataFrame, part: str, metrics: list[str]) -> DataFrame:
    """ratios among the techniques whose name contains `part`."""
    return ratios(records.where(F.col("technique").contains(part)), metrics)


def initial_ratios(records: DataFrame, initial: str, final: str) -> DataFrame:
    """(graph, technique, initial, final), both over the least final value of the graph."""
    best = F.min(final).over(Window.partitionBy("graph"))
    return records.select("graph", "technique", F.round(F.col(initial) / best, 6).alias("initial"), F.round(F.col(final) / best, 6).alias("final"))


def fits_by(records: DataFrame, x: str, y: str, by: Column) -> DataFrame:
    """loglog_fit of each group, as (name, slope, intercept, pearson, n)."""
    good = records.where((F.col(x) > 0) & (F.col(y) > 0)).select(by.alias("name"), F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return good.groupBy("name").agg(F.round(F.regr_slope("ly", "lx"), 6).alias("slope"), F.round(F.regr_intercept("ly", "lx"), 6).alias("intercept"), F.round(F.corr("lx", "ly"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


def quadratic_fit(records: DataFrame, x: str, y: str) -> DataFrame:
    """One row: a, b, c of log10 y = a + b u + c u^2 by least squares, u = log10 x less its mean; where a power law doesn't fit."""
    good = records.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("l"), F.log10(y).alias("v"))
    good = good.crossJoin(F.broadcast(good.agg(F.avg("l").alias("m")))).select((F.col("l") - F.col("m")).alias("u"), "v")
    s = good.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u") ** k).alias(f"u{k}") for k in range(1, 5)], *[F.sum(F.col("v") * F.col("u") ** k).alias(f"v{k}") for k in range(3)])
    det = lambda p, q, r: f"({p[0]} * ({q[1]} * {r[2]} - {q[2]} * {r[1]}) - {p[1]} * ({q[0]} * {r[2]} - {q[2]} * {r[0]}) + {p[2]} * ({q[0]} * {r[1]} - {q[1]} * {r[0]}))"
    columns = [["n", "u1", "u2"], ["u1", "u2", "u3"], ["u2", "u3", "u4"]]
    known, whole = ["v0", "v1", "v2"], det(*columns)
    return s.select(*[F.expr(f"round({det(*[known if j == k else columns[j] for j in range(3)])} / {whole}, 6)").alias(name) for k, name in enumerate("abc")])


def by_size(records: DataFrame, metrics: list[str]) -> DataFrame:
    """(size, technique, metrics over the size's least): the size is the whole number that a graph's name starts with; others are left out."""
    size = F.regexp_extract("graph", "^([0-9]+)", 1)
    return ratios(records.where(size != "").withColumn("size", size.cast("long")), metrics, by="size")
