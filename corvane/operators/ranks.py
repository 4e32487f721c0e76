"""Ranks and running totals over a whole table without a one-partition window.

A window without a partition key moves all rows to one task. Here values are first cut into buckets at approximate quantiles,
whose number is fixed; a window runs within each bucket, and the buckets' totals (a few rows) give what lies before each.
A value that many rows share is a bucket of its own, which ties are cut further by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order_statistics import below, quantiles
from .storage import written

BUCKETS = 64


def reused(df: DataFrame) -> DataFrame:
    """df written once, as a leaf of the plans that read it: several branches compute it once, read only the columns they need, and plans do not grow with its own."""
    return written(df, "leaf")


def average_ranks(rows: DataFrame, by: list[str], value: str = "value", buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """rows with `rank` (average of ties, ascending) and `n` (non-null values) within each `by` group; null values rank null. With a weight, a row counts as that many alike.

    Rows are shuffled once, by bucket, and are not joined back. A bucket of a single value has its rank from the totals, so a hot value costs nothing. The driver gets at most
    `buckets` cuts and twice as many totals for each group: groups are columns of a matrix or draws, not entities.
    """
    keys = by or ["_all"]
    whole = rows if by else rows.withColumn("_all", F.lit(0))
    points = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = whole.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, points, 10000)).alias("_cuts"))
    cuts = {tuple(r[k] for k in keys): [float(c) for c in r["_cuts"] or []] for r in cuts.collect()}
    placed = reused(whole.withColumn("_bucket", below(cuts, [F.col(k) for k in keys], F.col(value))))
    w = F.col(weight) if weight else F.lit(1)
    totals = placed.where("_bucket is not null").groupBy(*keys, "_bucket").agg(F.sum(w).cast("long").alias("_own"), (F.min(value) == F.max(value)).alias("_single")).collect()
    before, upto = [], {}
    for r in sorted(totals, key=lambda r: r["_bucket"]):
        key = tuple(r[k] for k in keys)
        before.append((key, r["_bucket"], upto.get(key, 0), r["_own"], r["_single"]))
        upto[key] = upto.get(key, 0) + r["_own"]
    more = T.StructType.fromDDL("_bucket int, _before long, _own long, _single boolean, n long, _slot int")
    offsets = [(*key, *own, upto[key], i) for i, (key, *own) in enumerate(before)]
    offsets = rows.sparkSession.createDataFrame(offsets, T.StructType([*placed.select(*keys).schema.fields, *more.fields]))
    found = placed.join(F.broadcast(offsets), [*keys, "_bucket"], "left")
    others = [c for c in rows.columns if c not in (*by, value)]
    ranked = lambda part, rank: part.select(*by, value, *others, rank.alias("rank"), "n")
    out = ranked(found.where(F.coalesce("_single", F.lit(True))), F.col("_before") + (F.col("_own") + 1) / 2)
    if all(single for *_, single in before):
        return out
    inner = Window.partitionBy("_slot").orderBy(value)
    last = F.sum(w).over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    middle = last - (F.sum(w).over(Window.partitionBy("_slot", value)) - 1) / 2 if weight else (F.rank().over(inner) + last) / 2
    return out.unionByName(ranked(found.where(~F.col("_single")), F.col("_before") + middle))


def percent_ranks(rows: DataFrame, by: list[str], value: str = "value", direction=1) -> DataFrame:
    """rows with `score`: 100 times the average rank over the count, 100 less than it for direction -1 (a number or a column)."""
    ranked = average_ranks(rows, by, value)
    r = F.col("rank") / F.col("n")
    d = F.lit(direction) if isinstance(direction, int) else direction
    return ranked.withColumn("score", 100 * F.when(d < 0, 1 - r).otherwise(r)).drop("rank", "n")


def in_order(rows: DataFrame, value: str, tie: str, sums: tuple[str, ...] = (), descending: bool = True, buckets: int = BUCKETS, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with `position` (1 on) by value and then tie ascending, and the running totals run_<column> up to each row, within each `by` group.

    value and tie are numbers, and value, tie and `by` together name a row. Null values come last. Groups are columns of a matrix or draws.
    """
    points = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    found = rows.groupBy(*by).agg(F.percentile_approx(value, points, 10000).alias("v"), F.percentile_approx(tie, points, 10000).alias("t")).collect()  # 2 * buckets numbers a group
    level, ties = ({tuple(r[k] for k in by): sorted({float(c) for c in r[x] or []}) for r in found} for x in ("v", "t"))
    place = below(level, [F.col(k) for k in by], F.col(value))
    tied = below(ties, [F.col(k) for k in by], F.col(tie))
    major = F.when(F.col("_major").isNull(), F.lit(1 << 20)).otherwise(-F.col("_major") if descending else F.col("_major"))
    minor = F.when(F.col("_major").isNull() | (F.col("_major") % 2 == 1), (F.col("_minor") / 2).cast("int")).otherwise(0)
    placed = rows.withColumns({"_major": place, "_minor": tied}).withColumns({"_minor": minor, "_major": major})
    placed = reused(placed)
    totals = placed.groupBy(*by, "_major", "_minor").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums)).orderBy("_major", "_minor").collect()
    runs, offsets = {}, []
    for r in totals:
        key = tuple(r[k] for k in by)
        run = runs.get(key, [0] + [0.0] * len(sums))
        offsets.append((*key, r["_major"], r["_minor"], *run))
        runs[key] = [run[0] + r["_n"], *(x + float(r[f"_s_{c}"] or 0.0) for x, c in zip(run[1:], sums))]
    more = T.StructType.fromDDL(", ".join(["_major int", "_minor int", "_n0 long", *(f"_b_{c} double" for c in sums)]))
    before = rows.sparkSession.createDataFrame(offsets, T.StructType([*rows.select(*by).schema.fields, *more.fields]))  # at most about 2 * buckets^2 rows a group
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    inner = Window.partitionBy(*by, "_major", "_minor").orderBy(order, F.col(tie))
    out = placed.join(F.broadcast(before), [*by, "_major", "_minor"]).withColumn("position", (F.col("_n0") + F.row_number().over(inner)).cast("long"))
    for c in sums:
        out = out.withColumn(f"run_{c}", F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return out.drop("_major", "_minor", "_n0", *(f"_b_{c}" for c in sums))


def quartile_edges(rows: DataFrame, value: str) -> DataFrame:
    """One row: `edges`, the exact linear-interpolated quartiles."""
    return quantiles(rows, [], value, [0.25, 0.5, 0.75]).select(F.col("quantiles").alias("edges"))


def with_scalar(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """rows with the columns of a one-row table, as a scalar subquery."""
    value = one_row.select(F.struct(*one_row.columns)).scalar()
    return rows.withColumn("_one", value).select(*rows.columns, *(F.col(f"_one.{c}").alias(c) for c in one_row.columns))
