"""Exact quantiles by distributed selection: histograms of equal depth are refined around the wanted ranks until a cell is small.

A percentile aggregate holds all values of a group in one task. Here a group's distinct values are counted first, so that a value that many rows share is one row. While some
cell (at first, a group) has more than `most` of them, those cells are cut at approximate quantiles (a sketch of bounded size) and counted, and only cells that hold a wanted rank
stay. Then values are put in order within cells. The driver gets the large cells' cuts, at most `bins` numbers for each `most` values; what a round leaves is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

BINS, MOST = 256, 1 << 17


def below(cuts: dict[tuple, list[float]], by: list[Column], value: Column) -> Column:
    """2 * k for a value that k of its group's cuts (ascending) lie below, one more if it is a cut itself; null for a null. Found by bisection: lambdas over an array of cuts are interpreted and cost a pass each."""
    known = {key: np.asarray(own, dtype=float) for key, own in cuts.items()}

    @F.pandas_udf("int")
    def place(v: pd.Series, *keys: pd.Series) -> pd.Series:
        x, out = v.to_numpy(dtype=float), np.zeros(len(v), dtype=np.int32)
        codes, names = np.zeros(len(v), dtype=np.int64), [()]
        for key in keys:
            own, found = pd.factorize(key, use_na_sentinel=False)
            codes, pairs = pd.factorize(codes * len(found) + own)
            names = [(*names[i // len(found)], found[i % len(found)]) for i in pairs]
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            at, own = order[ends[i] : ends[i + 1]], known.get(tuple(name))
            if own is not None and len(own):
                k = np.searchsorted(own, x[at])
                out[at] = 2 * k + (own[np.minimum(k, len(own) - 1)] == x[at])
        return pd.Series(out)

    return F.when(value.isNotNull(), place(F.coalesce(value.cast("double"), F.lit(0.0)), *by))


def _refined(cells: DataFrame, targets: DataFrame, keys: list[str], large: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """The large cells cut once more, of all cells those only that hold a target, and the targets with their ranks within them. Rows are placed where they lie; only counts by cell and bin are shuffled."""
    names = [*keys, "_cell"]
    points = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = cells.join(F.broadcast(large), names).groupBy(*names).agg(F.array_distinct(F.percentile_approx("_v", points, 10000)).alias("_cuts")).collect()
    cuts = {tuple(r[k] for k in names): r["_cuts"] for r in found}
    placed = cells.withColumn("_bin", (below(cuts, [F.col(k) for k in names], F.col("_v")) / 2).cast("int"))
    own = placed.groupBy(*names, "_bin").agg(F.sum("_c").alias("_own"))
    earlier = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
    own = own.withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0)))
    hit = targets.join(own, names).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_own")))
    hit = written(hit.select(*keys, "_t", (F.col("_k") - F.col("_before")).alias("_k"), (F.col("_cell") * bins + F.col("_bin")).alias("_cell")), "cells")
    inner = placed.select(*keys, "_v", "_c", (F.col("_cell") * bins + F.col("_bin")).alias("_cell"))
    return written(inner.join(hit.select(*names).distinct(), names, "left_semi"), "cells"), hit


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], bins: int = BINS, most: int = MOST, weight: str | None = None) -> DataFrame:
    """by, n, quantiles: the exact quantiles of each group's values, interpolated linearly between neighbours. Nulls and NaN are no values; a group without values has no row, and
    without `by` there is one row, with nulls where no value is. With a weight, a row counts as that many alike."""
    keys = by or ["_all"]
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*(by or [F.lit(0).alias("_all")]), v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_c"))
    cells = written(known.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")).withColumn("_cell", F.lit(0).cast("long")), "cells")
    sizes = cells.groupBy(*keys).agg(F.sum("_c").alias("n"))
    last = F.col("n") - 1
    low = lambda p: F.floor(F.lit(p) * last).cast("long")
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(low(p), F.least(low(p) + 1, last)) for p in probs))))
    targets = sizes.select(*keys, F.explode(wanted).alias("_t")).withColumn("_k", F.col("_t")).withColumn("_cell", F.lit(0).cast("long"))
    size = 0
    while True:
        counted = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).collect()
        before, size = size, max((r["_n"] for r in counted), default=0)
        if not counted or size == before:  # a sketch always cuts what is larger than its bins
            break
        names = cells.select(*keys, "_cell")
        large = rows.sparkSession.createDataFrame([tuple(r)[:-1] for r in counted], names.schema)
        cells, targets = _refined(cells, targets, keys, large, bins)
    upto = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = cells.withColumn("_upto", F.sum("_c").over(upto))
    found = targets.join(ends, [*keys, "_cell"]).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_at"))  # two entries a quantile
    get = lambda k: F.try_element_at("_at", k)

    def between(p: float):
        a, b, part = get(low(p)), get(F.least(low(p) + 1, last)), F.lit(p) * last - low(p)
        return F.when(part > 0, a + (b - a) * part).otherwise(a)

    out = sizes.join(at, keys).select(*keys, "n", F.array(*(between(p) for p in probs)).alias("quantiles"))
    if by:
        return out
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("quantiles"), F.array(*(F.lit(None).cast("double") for _ in probs))).alias("quantiles"))


def medians(rows: DataFrame, by: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """by, <name>: the exact median of each group's values."""
    return quantiles(rows, by, value, [0.5], weight=weight).select(*by, F.col("quantiles")[0].alias(name))
