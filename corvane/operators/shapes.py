"""Rings of points: what each point is worth, simplification by a tolerance, and the tolerance at which all rings fit a size."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ring_area
from .storage import written


def _worth(points: np.ndarray) -> np.ndarray:
    """The tolerance from which each point goes: its distance from the chord that it splits, at most that of the chords above it. End points never go."""
    out = np.full(len(points), np.inf)
    out[1:-1] = 0.0
    todo = [(0, len(points) - 1, np.inf)]
    while todo:
        a, b, above = todo.pop()
        if b - a < 2:
            continue
        chord, off = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length > 0 else np.hypot(off[:, 0], off[:, 1])
        i = int(far.argmax())
        out[a + 1 + i] = own = min(above, float(far[i]))
        if own > 0:
            todo += [(a, a + 1 + i, own), (a + 1 + i, b, own)]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def point_worth(rings: pd.Series) -> pd.Series:
    """For each point of a ring (array of [x, y]) the largest tolerance at which it still stands; null rings stay null, empty ones empty."""
    return rings.map(lambda r: None if r is None else _worth(np.array(r.tolist(), dtype=float).reshape(-1, 2)), na_action="ignore")


def closed(ring: Column) -> Column:
    """The ring with its first point at its end."""
    return F.when((F.size(ring) > 0) & (F.get(ring, F.lit(0)) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def kept_points(ring: Column, worth: Column, tolerance: Column | float) -> Column:
    """The points worth more than the tolerance, rounded to four places."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    pairs = F.filter(F.arrays_zip(ring.alias("p"), worth.alias("w")), lambda z: z["w"] > t)
    return F.transform(pairs, lambda z: F.transform(z["p"], lambda v: F.round(v, 4)))


def simplify(rings: DataFrame, ladder: list[float], cap: int, column: str = "ring") -> DataFrame:
    """rings with `simplified` and `tolerance`: the first tolerance of the ladder at which all rings together have at most `cap` points, else its last.

    Each point's worth is found once; the steps of the ladder are one aggregate over it, and one row of as many counts reaches the driver.
    """
    rows = rings.withColumn(column, closed(F.col(column)))
    rows = rows.withColumn("_worth", point_worth(column))
    left = lambda t: F.size(F.filter("_worth", lambda w: w > t))
    sizes = rows.agg(*(F.coalesce(F.sum(left(t)), F.lit(0)) for t in ladder)).first()
    tolerance = next((t for t, n in zip(ladder, sizes) if n <= cap), ladder[-1])
    return rows.select(*rings.columns, kept_points(F.col(column), F.col("_worth"), tolerance).alias("simplified"), F.lit(float(tolerance)).alias("tolerance"))


def without_placeholders(rings: DataFrame, column: str = "ring") -> DataFrame:
    """Rings of at least three corners and some area."""
    return rings.where((F.size(column) >= 4) & (ring_area(column) != 0))


def edges_of(polygons: DataFrame) -> DataFrame:
    """id, x1, y1, x2, y2 of all edges of polygons (id, rings: closed rings, holes among them)."""
    r = F.col("ring")
    pairs = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))
    each = polygons.select("id", F.explode("rings").alias("ring")).where(F.size("ring") >= 2).select("id", F.explode(pairs).alias("e"))
    return each.select("id", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def containing(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """point, id: the smallest id of the polygons that a point lies in, holes not counted as inside.

    Points meet polygons by the cells of their boxes, and of these only the edges in the point's own strip, whose crossings to its right are counted.
    """
    edges = edges_of(polygons)
    boxes = edges.groupBy("id").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    boxes = boxes.withColumn("cx", _cells(F.col("a"), F.col("b"), size)).withColumn("cy", _cells(F.col("c"), F.col("d"), size))
    placed = points.select("point", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    near = placed.join(boxes, ["cx", "cy"]).where("x between a and b and y between c and d").select("point", "x", "y", "id", "cy")
    strips = edges.withColumn("cy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    hits = near.join(strips, ["id", "cy"]).groupBy("point", "id").agg(F.count_if(crosses).alias("n")).where("n % 2 = 1")
    return hits.groupBy("point").agg(F.min("id").alias("id"))


def nearest_centre(points: DataFrame, centres: DataFrame, size: float) -> DataFrame:
    """point, id: the nearest of the centres (id, cx, cy), ties (to nine places) to the smaller id. Points look into the cells around their own; a distance (to nine places) below a cell's side is final there, as all that tie with it lie below it too, and
    what has none yet looks again in cells twice as wide, so no point meets all centres unless they are few."""
    left, out = written(points.select("point", "x", "y"), "points"), None
    if centres.isEmpty():
        return left.select("point").limit(0).join(centres.select("id").limit(0))
    cell = lambda c: F.floor(F.col(c) / size)
    while out is None or not left.isEmpty():
        around = centres.withColumn("i", F.explode(F.sequence(cell("cx") - 1, cell("cx") + 1))).withColumn("j", F.explode(F.sequence(cell("cy") - 1, cell("cy") + 1)))
        far = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
        met = left.withColumn("i", cell("x")).withColumn("j", cell("y")).join(around, ["i", "j"]).withColumn("d", F.round(far, 9)).where(F.col("d") < size)
        found = written(met.groupBy("point").agg(F.min(F.struct("d", "id")).alias("b")).select("point", "b.id"), "centres")
        out = found if out is None else out.unionByName(found)
        left, size = written(left.join(found, "point", "left_anti"), "points"), size * 2
    return out


def assign_points(points: DataFrame, polygons: DataFrame, limit: float, size: float) -> DataFrame:
    """point, id, how: the polygon (id, rings) that a point (point, x, y) belongs to: one that holds it ("inside"), else the one whose edge is nearest if that is nearer than
    `limit` ("edge"), else the one whose outer ring's centre of corners is nearest ("centre"). Distances that agree to nine places are ties, which go to the smaller id; a point without coordinates belongs to none."""
    points = written(points.where("x is not null and y is not null").select("point", "x", "y"), "points")
    inside = written(containing(points, polygons, size), "inside")
    rest = points.join(inside, "point", "left_anti")
    edges = edges_of(polygons)
    wide = edges.withColumn("cx", _cells(F.least("x1", "x2") - limit, F.greatest("x1", "x2") + limit, size)).withColumn("cy", _cells(F.least("y1", "y2") - limit, F.greatest("y1", "y2") + limit, size))
    d = segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    close = rest.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(wide, ["cx", "cy"]).withColumn("d", d).where(F.col("d") < limit)
    edge = written(close.groupBy("point").agg(F.min(F.struct(F.round("d", 9).alias("d"), "id")).alias("b")).select("point", "b.id"), "edge")
    ring = F.get("rings", F.lit(0))
    corners = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda i: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[i]) / F.size(corners)
    centres = polygons.where(F.size(ring) >= 2).select("id", mean(0).alias("cx"), mean(1).alias("cy"))
    centre = nearest_centre(rest.join(edge, "point", "left_anti"), centres, size)
    told = [(inside, "inside"), (edge, "edge"), (centre, "centre")]
    return reduce(DataFrame.unionByName, (df.select("point", "id", F.lit(how).alias("how")) for df, how in told))
