"""The entity x indicator matrix in long form: (entity, grp, indicator, value): gates, imputation, normalisers, pillars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import along_curve, neighbours
from .order_statistics import medians
from .ranks import percent_ranks, reused
from .storage import block, in_blocks


def to_long(wide: DataFrame, keys: list[str], indicators: list[str]) -> DataFrame:
    """keys, indicator, value; null cells stay as rows."""
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in indicators)).unpivot(keys, indicators, "indicator", "value")


def to_wide(rows: DataFrame, keys: list[str], indicators: list[str], value: str = "value") -> DataFrame:
    """One row an entity; the column list is given, so no pass is needed to find it."""
    return rows.groupBy(*keys).pivot("indicator", indicators).agg(F.first(value, ignorenulls=True))


def coverage(rows: DataFrame) -> DataFrame:
    """indicator, coverage: the share of cells that have a value."""
    return rows.groupBy("indicator").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))


def covered(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of indicators with enough coverage."""
    return rows.join(F.broadcast(coverage(rows).where(F.col("coverage") >= least).select("indicator")), "indicator", "left_semi")


def sentinels(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Indicators whose values are zero in at least that share: there, zero means missing."""
    found = rows.where("value is not null").groupBy("indicator").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))
    return found.where(F.col("zero_share") >= least)


def without_sentinels(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Zeros of sentinel indicators as nulls."""
    marked = rows.join(sentinels(rows, least).select("indicator", F.lit(True).alias("_s")), "indicator", "left")
    return marked.withColumn("value", F.when(F.col("_s") & (F.col("value") == 0), None).otherwise(F.col("value"))).drop("_s")


def impute(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Group median, then the median of the group-filled column; provenance says which. The second is computed for indicators that still lack a cell."""
    own = reused(medians(rows, [group, "indicator"], "value", "_g"))
    first = rows.join(own, [group, "indicator"], "left").withColumn("_f", F.coalesce("value", "_g"))
    lacking = rows.where("value is null").select(group, "indicator").distinct().join(own, [group, "indicator"], "left_anti").select("indicator").distinct()
    names = [r["indicator"] for r in lacking.collect()]  # columns of the matrix
    out = first.withColumn("_n", F.lit(None).cast("double"))
    if names:
        out = first.join(reused(medians(first.where(F.col("indicator").isin(names)), ["indicator"], "_f", "_n")), "indicator", "left")
    source = F.when(F.col("value").isNotNull(), "observed").when(F.col("_g").isNotNull(), "group_median").when(F.col("_n").isNotNull(), "overall_median")
    return out.withColumn("provenance", source).withColumn("value", F.coalesce("_f", "_n")).drop("_g", "_f", "_n")


def impute_overall(rows: DataFrame) -> DataFrame:
    whole = medians(rows, ["indicator"], "value", "_n")
    return rows.join(whole, "indicator", "left").withColumn("value", F.coalesce("value", "_n")).drop("_n")


def listwise(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """The rows of entities without a missing cell."""
    return rows.join(rows.where("value is null").select(entity).distinct(), entity, "left_anti")


def impute_neighbours(rows: DataFrame, k: int = 5, block_rows: int = 1 << 18, query_rows: int = 1 << 13) -> DataFrame:
    """Missing cells from the mean of the k nearest entities of all that have the indicator; ties to the smaller entity.

    Distance is over shared indicators, z-scored, scaled up for missing ones. Entities with equal cells are one class: as donors
    they are its k smallest entities, and what they lack is looked for once. The classes that lack a cell are the queries: a task takes about `query_rows` of them
    and reads all classes in files of `block_rows`, so none is copied; what lies too far off is skipped (`neighbours`). Cells that no neighbour fills take the indicator's median.
    """
    known = {r["indicator"]: (r["_m"] or 0.0, r["_s"] or 0.0) for r in rows.groupBy("indicator").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")).collect()}
    names = sorted(known)  # the matrix's columns
    middle, spread = np.array([known[c][0] for c in names]), np.array([known[c][1] if known[c][1] > 0 else 1.0 for c in names])
    wide = to_wide(rows, ["entity"], names)
    flat = reused(wide.select("entity", F.array(*(F.coalesce(c, F.lit(float("nan"))) for c in names)).alias("v")))
    firsts = flat.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("entity"))).where(F.col("_r") <= k)
    classes = reused(firsts.groupBy("v").agg(F.min("entity").alias("entity"), F.sort_array(F.collect_list("entity")).alias("ids")))
    lacks, values = F.exists("v", lambda x: F.isnan(x)), [f"v{i}" for i in range(len(names))]
    own = [F.col("entity").cast("long").alias("entity"), *(F.col("v")[i].alias(c) for i, c in enumerate(values))]
    near = along_curve([(F.col(c) - float(m)) / float(s) for c, m, s in zip(values, middle, spread)]).alias("near")
    donors = in_blocks(classes.select(*own, *(F.get("ids", F.lit(i)).cast("long").alias(f"id{i}") for i in range(k))).select("*", near), ["near", "entity"], block_rows)
    queries = in_blocks(classes.where(lacks).select(*own).select("*", near), ["near", "entity"], query_rows)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in part.id:
                entity, *v = block(queries[int(at)], ["entity", *values])
                if not len(entity):
                    continue
                given = ((np.stack(own[1 : 1 + len(names)], axis=1), np.stack(own[1 + len(names) :], axis=1)) for own in (block(f, ["entity", *values, *(f"id{i}" for i in range(k))]) for f in donors))
                row, j, mean = neighbours(np.stack(v, axis=1), given, middle, spread, k)
                yield pd.DataFrame({"cls": entity[row], "indicator": np.array(names, dtype=object)[j], "_k": mean})

    asked = rows.sparkSession.range(0, len(queries), numPartitions=max(1, len(queries)))
    filled = reused(asked.mapInPandas(nearest, "cls long, indicator string, _k double"))
    members = flat.where(lacks).select("entity", "v").join(classes.where(lacks).select(F.col("entity").alias("cls"), "v"), "v").select("entity", "cls")
    filled = filled.join(members, "cls").drop("cls")
    whole = medians(rows, ["indicator"], "value", "_n")
    out = rows.join(filled, ["entity", "indicator"], "left").join(whole, "indicator", "left")
    return out.withColumn("value", F.coalesce("value", "_k", "_n")).drop("_k", "_n")


def blocked(rows: DataFrame, tree: DataFrame, most: float = 1 / 3) -> DataFrame:
    """entity, pillar, missing_share, blocked: more than that share of the pillar's cells is missing."""
    own = rows.join(F.broadcast(tree), "indicator").groupBy("entity", "pillar").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_share"))
    return own.withColumn("blocked", F.col("missing_share") > most)


def pillar_columns(rows: DataFrame, pillars: list[str], most: float = 1 / 3, also: tuple[Column, ...] = (), keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """keys, and for each pillar <p>_p, the mean of its scores, nulls skipped, and <p>_b, as in blocked(). rows: entity, pillar, score, and `missing`, whether the cell lacked a value. Cells are shuffled once, by keys. `also`: more aggregates of an entity's cells."""
    own = lambda p, x: F.avg(F.when(F.col("pillar") == p, F.col(x)))
    cells = rows.withColumn("missing", F.col("missing").cast("double")).repartition(*keys)
    return cells.groupBy(*keys).agg(*(own(p, "score").alias(f"{p}_p") for p in pillars), *(F.coalesce(own(p, "missing") > most, F.lit(False)).alias(f"{p}_b") for p in pillars), *also)


def rank_normalised(rows: DataFrame, direction: Column | int = 1) -> DataFrame:
    return percent_ranks(rows, ["indicator"], "value", direction)


def minmax_normalised(rows: DataFrame, direction: Column | int = 1) -> DataFrame:
    """0 to 100 between the least and the largest; 50 where both are one."""
    ends = rows.groupBy("indicator").agg(F.min("value").alias("_a"), F.max("value").alias("_z"))
    out = rows.join(ends, "indicator")
    x = F.when(F.col("_z") > F.col("_a"), 100 * (F.col("value") - F.col("_a")) / (F.col("_z") - F.col("_a"))).when(F.col("value").isNotNull(), 50.0)
    d = direction if isinstance(direction, Column) else F.lit(direction)
    return out.withColumn("score", F.when(d < 0, 100 - x).otherwise(x)).drop("_a", "_z")


def z_normalised(rows: DataFrame, direction: Column | int = 1) -> DataFrame:
    """50 plus 10 sample z-scores; a constant divides by 1."""
    stats = rows.groupBy("indicator").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    out = rows.join(stats, "indicator")
    z = 10 * (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    d = direction if isinstance(direction, Column) else F.lit(direction)
    return out.withColumn("score", 50 + F.when(d < 0, -z).otherwise(z)).drop("_m", "_s")


#: The normalisers by name: each takes long rows and a direction, and adds `score`.
NORMALISERS = {"rank": rank_normalised, "minmax": minmax_normalised, "z": z_normalised}


def normalised(rows: DataFrame, tree: DataFrame, method: str = "rank") -> DataFrame:
    """rows of the tree's indicators with pillar, direction and score. tree: indicator, pillar, direction."""
    return NORMALISERS[method](rows.join(F.broadcast(tree), "indicator"), F.col("direction"))


def pillars(rows: DataFrame, tree: DataFrame, method: str = "rank", without: str | None = None) -> DataFrame:
    """entity, pillar, score, n: the mean of the pillar's normalised indicators, nulls skipped. tree: indicator, pillar, direction."""
    kept = tree if without is None else tree.where(F.col("indicator") != without)
    return normalised(rows, kept, method).groupBy("entity", "pillar").agg(F.avg("score").alias("score"), F.count("score").alias("n"))
