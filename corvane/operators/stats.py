"""Correlation, regression, reliability and tests as Spark aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_tail, normal_tail, t_tail
from .ranks import average_ranks, in_order
from .storage import written


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n, over rows where both are present."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(both, [], "x").select("y", F.col("rank").alias("rx")), [], "y")
    return ranked.agg(F.corr("rx", "rank").alias("rho"), F.count(F.lit(1)).alias("n"))


def pearson_pairs(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """a, b, r, n of every pair of indicators in long rows, over entities that have both.

    Rows are made wide once and all pairs are sums of one aggregate, so nothing is shuffled but the cells and one row of sums a task. The driver asks for the indicators' names.
    """
    names = sorted(r["indicator"] for r in rows.select("indicator").distinct().collect())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    wide = rows.groupBy(entity).pivot("indicator", names).agg(F.first("value", ignorenulls=True))
    x = lambda c: F.col(f"`{c}`")
    sums = wide.agg(*(m.alias(f"{k}{i}") for i, (a, b) in enumerate(pairs) for k, m in (("r", F.corr(x(a), x(b))), ("n", F.count_if(x(a).isNotNull() & x(b).isNotNull())))))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)))
    return sums.select(F.inline(each)).where("n > 0")


def spearman_pairs(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """pearson_pairs over average ranks; columns should be complete."""
    ranked = average_ranks(rows.where("value is not null"), ["indicator"])
    return pearson_pairs(ranked.select(entity, "indicator", F.col("rank").alias("value")), entity)


def kendall(rows: DataFrame, x: str, y: str, block: str, tie: str = "entity", size: int = 1 << 18) -> DataFrame:
    """block, tau_b of each block of two rows or more, null where all pairs are tied or none has both. No pair is made; `tie` names a row.

    A pair counts as untied in x if both rows have an x, whatever their y, and the other way round.
    """
    known = rows.where(F.col(block).isNotNull()).select(F.col(block).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(tie).alias("t"))
    pairs = lambda n: n * (n - 1) / 2

    def tied(*keys: str) -> DataFrame:
        """Of rows that have all keys: g, all pairs, and pairs that are tied in them."""
        own = known.where(" and ".join(f"{k} is not null" for k in keys)).groupBy("g", *keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
        name = "".join(keys)
        return own.groupBy("g").agg(pairs(F.sum("n")).alias(f"all_{name}"), F.sum(pairs(F.col("n"))).alias(f"tied_{name}"))

    both = known.where("x is not null and y is not null")
    placed = placed_by_both(both, ("g",), "places")
    ties = lambda k: placed.groupBy("g", k).agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("g").agg(F.sum(pairs(F.col("n"))).alias(f"in_{k}"))
    found = known.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    for part in (tied("x"), tied("y"), tied("x", "y"), ties("x"), ties("y"), discordant_in(placed, ("g",), size).withColumnRenamed("n", "d")):
        found = found.join(part, "g", "left")
    score = F.col("all_xy") - F.col("in_x") - F.col("in_y") + F.col("tied_xy") - 2 * F.coalesce("d", F.lit(0))
    free = (F.col("all_x") - F.col("tied_x")) * (F.col("all_y") - F.col("tied_y"))
    return found.select(F.col("g").alias(block), (score / F.sqrt(F.nullif(free, F.lit(0.0)))).alias("tau_b"))


def inversions(values: np.ndarray) -> int:
    """How many pairs of an array of different numbers stand in descending order: ones before zeros, bit by bit, within equal higher bits."""
    order = np.empty(len(values), dtype=np.int64)
    order[np.argsort(values)] = np.arange(len(values))
    found = 0
    for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        one, group = (order >> bit) & 1, order >> (bit + 1)
        ones = np.cumsum(one)
        start = np.searchsorted(group, group)  # groups stand in order
        before = ones - np.where(start > 0, ones[start - 1], 0)
        found += int(before[one == 0].sum())
        order = order[np.argsort(order >> bit, kind="stable")]
    return found


def placed_by_both(both: DataFrame, by: tuple[str, ...], kind: str) -> DataFrame:
    """Rows x, y, t with x_at and y_at, each a permutation of 1..n within a `by` group: by x and then y, and by y, ties in the order of x."""
    placed = in_order(both, "y", "t", descending=False, by=by).withColumnRenamed("position", "y0")
    placed = in_order(placed, "x", "y0", descending=False, by=by).withColumnRenamed("position", "x_at")
    return written(in_order(placed, "y", "x_at", descending=False, by=by).withColumnRenamed("position", "y_at"), kind)


def discordant_in(places: DataFrame, by: tuple[str, ...], size: int) -> DataFrame:
    """by, n: how many pairs of a group's rows stand in opposite orders by x_at and y_at (each a permutation of 1, 2, ... within the group).

    Rows are cut into blocks of `size` along x and along y. Pairs of one block along x are counted there, pairs of one block along y but of different ones along x
    are counted there, and pairs that differ in both are products of counts: of a cell's rows and of those in all blocks before it along x and behind it along y.
    """
    cells = places.select(*by, "x_at", "y_at", F.expr(f"(x_at - 1) div {size}").alias("b"), F.expr(f"(y_at - 1) div {size}").alias("k"))
    shape = places.select(*by).schema.add("n", "long")

    def counted(order: list[str]):
        """Rows of a group in that order, and how many of their pairs have descending y_at."""
        return lambda part: part[list(by)].head(1).assign(n=inversions(part.sort_values(order)["y_at"].to_numpy()))

    near = cells.groupBy(*by, "b").applyInPandas(counted(["x_at"]), shape)
    near = near.unionByName(cells.groupBy(*by, "k").applyInPandas(counted(["b", "y_at"]), shape))  # within a block y ascends: nothing is counted
    blocks = cells.groupBy(*by).agg(F.max("b").alias("m"))
    along = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias(c)
    grid = blocks.select(*by, "m", along("b")).select(*by, "b", along("k"))
    full = grid.join(cells.groupBy(*by, "b", "k").agg(F.count(F.lit(1)).alias("own")), [*by, "b", "k"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    behind = F.coalesce(F.sum("own").over(Window.partitionBy(*by, "b").orderBy("k").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    before = F.coalesce(F.sum("behind").over(Window.partitionBy(*by, "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = full.withColumn("behind", behind).withColumn("before", before).select(*by, (F.col("own") * F.col("before")).alias("n"))
    return near.unionByName(far).groupBy(*by).agg(F.sum("n").alias("n"))


def discordant(places: DataFrame, n: int, size: int) -> Column:
    """How many of n rows' pairs stand in opposite orders by x_at and y_at, as a scalar."""
    return discordant_in(places, (), size).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


def kendall_whole(rows: DataFrame, x: str, y: str, tie: str = "entity", size: int = 1 << 18) -> DataFrame:
    """One row: tau_b, n, p of all rows that have both (p: two-sided, by the normal approximation with ties). No pair is made; `tie` names a row.

    Sorted by x and then y, discordant pairs are those whose y descend. Ties of y get their places in the order of x, so none of them counts. Every
    group has `size` rows whatever the ties; the grid of counts has (n / size)^2 cells.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(tie).alias("t"))
    placed = placed_by_both(both, (), "places")
    t = F.col("t").cast("double")
    tied = lambda *keys: placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("t")).agg(
        F.struct(F.coalesce(F.sum(t * (t - 1) / 2), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(t * (t - 1) * (t - 2)), F.lit(0.0)).alias("cubes"), F.coalesce(F.sum(t * (t - 1) * (2 * t + 5)), F.lit(0.0)).alias("spread"))
    ).scalar()
    n = placed.count()
    one = rows.sparkSession.range(1).select(
        F.lit(n).cast("long").alias("n"), F.lit(float(n)).alias("m"), tied("x").alias("x"), tied("y").alias("y"), tied("x", "y").alias("xy"), discordant(placed, n, size).cast("double").alias("d")
    )
    pairs = F.col("m") * (F.col("m") - 1) / 2
    score = pairs - F.col("x.pairs") - F.col("y.pairs") + F.col("xy.pairs") - 2 * F.col("d")
    free = F.sqrt(pairs - F.col("x.pairs")) * F.sqrt(pairs - F.col("y.pairs"))
    variance = (2 * pairs * (2 * F.col("m") + 5) - F.col("x.spread") - F.col("y.spread")) / 18 + F.col("x.pairs") * F.col("y.pairs") / F.nullif(pairs, F.lit(0.0))
    variance = variance + F.col("x.cubes") * F.col("y.cubes") / F.nullif(18 * pairs * (F.col("m") - 2), F.lit(0.0))
    return one.select((score / F.nullif(free, F.lit(0.0))).alias("tau_b"), "n", normal_tail(score / F.sqrt(F.when(variance > 0, variance))).alias("p"))


def ols(rows: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope, intercept, r2."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def residuals(rows: DataFrame, y: str, x: str) -> DataFrame:
    """rows that have both, with `residual` of the line through them."""
    both = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    line = both.agg(F.struct(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))).scalar()
    return both.withColumn("_line", line).withColumn("residual", F.col(y) - F.col("_line.a") - F.col("_line.b") * F.col(x)).drop("_line")


def cronbach(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """pillar, alpha, k: of z-scored items, signed by direction, over entities that have all of the pillar's items."""
    stats = rows.groupBy("indicator").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    items = rows.join(tree, "indicator").join(stats, "indicator").withColumn("z", F.col("direction") * (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    sizes = tree.groupBy("pillar").agg(F.count(F.lit(1)).alias("k"))
    whole = items.groupBy("entity", "pillar").agg(F.sum("z").alias("total"), F.count("z").alias("n")).join(sizes, "pillar").where("n = k")
    item = items.join(whole.select("entity", "pillar"), ["entity", "pillar"]).groupBy("pillar", "indicator").agg(F.var_samp("z").alias("v")).groupBy("pillar").agg(F.sum("v").alias("v"))
    out = whole.groupBy("pillar", "k").agg(F.var_samp("total").alias("t")).join(item, "pillar")
    return out.select("pillar", F.when(F.col("k") >= 2, F.col("k") / (F.col("k") - 1) * (1 - F.col("v") / F.col("t"))).alias("alpha"), "k")


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: f, df_between, df_within."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select((between / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: t, n, over rows that have both."""
    d = F.col(a) - F.col(b)
    return rows.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double")))).alias("t"), F.count(d).alias("n"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: w, the smaller sum of signed ranks of the non-zero differences."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select(F.signum("d").alias("s"), F.abs("d").alias("value"))
    r = average_ranks(d, [])
    up, down = F.sum(F.when(F.col("s") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("s") < 0, F.col("rank")).otherwise(0.0))
    return r.agg(F.least(up, down).alias("w"), F.count(F.lit(1)).alias("n"))


def anova_p(rows: DataFrame, group: str, value: str) -> DataFrame:
    """anova() with p."""
    return anova(rows, group, value).withColumn("p", f_tail("f", "df_between", "df_within"))


def paired_t_p(rows: DataFrame, a: str, b: str) -> DataFrame:
    """paired_t() with the two-sided p."""
    return paired_t(rows, a, b).withColumn("p", t_tail("t", F.col("n") - 1))


def wilcoxon_p(rows: DataFrame, a: str, b: str) -> DataFrame:
    """wilcoxon() with z and the two-sided p of its normal approximation; ties lower the variance, zero differences are left out."""
    ties = rows.select(F.abs(F.col(a) - F.col(b)).alias("d")).where("d <> 0").groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("t"))
    lost = ties.agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0))).scalar()
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("lost") / 48
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(F.when(variance > 0, variance))
    return wilcoxon(rows, a, b).withColumn("lost", lost).withColumn("z", z).withColumn("p", normal_tail("z")).drop("lost")


def moments(rows: DataFrame, value: str) -> list[Column]:
    """skew and excess kurtosis by population moments."""
    return [F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")]


def normality(rows: DataFrame, value: str) -> DataFrame:
    """One row: k2 and p of D'Agostino and Pearson's test, closed forms of skewness, kurtosis and n."""
    m = rows.agg(F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"), F.count(value).cast("double").alias("n"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2") + 3
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - e) / F.sqrt(v)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return m.select((z1 * z1 + z2 * z2).alias("k2"), F.exp(-(z1 * z1 + z2 * z2) / 2).alias("p"))


def gains(rows: DataFrame, score: str, value: str, tie: str = "entity") -> DataFrame:
    """rows with position and gain: the share of all value that rows up to this one hold, by score descending."""
    placed = in_order(rows, score, tie, (value,))
    return placed.withColumn("gain", F.col(f"run_{value}") / rows.agg(F.sum(value)).scalar())


def captured(rows: DataFrame, score: str, value: str, population: str, budget: float, tie: str = "entity") -> DataFrame:
    """One row: n and capture of the rows, by score, up to and with the one whose population crosses the budget's share."""
    placed = in_order(rows, score, tie, (population,))
    before = (F.col(f"run_{population}") - F.col(population)) / rows.agg(F.sum(population)).scalar()
    inside = placed.where(before < budget)
    return inside.agg(F.count(F.lit(1)).alias("n"), (F.sum(value) / rows.agg(F.sum(value)).scalar()).alias("capture"))
