"""Hard-negative mining by bit-sliced integer products.

Components become integers, floor(scale * x), and each vector is kept as bit-planes of its two's complement: one 64-bit word for each plane and 64
components. Rows and anchors meet in blocks of a fixed size. Within a cell the rows' planes are taken most significant first: a plane's share of
all products is the weighted number of common bits with the anchor's planes. What is left of a component after plane j lies in
0 .. 2^j - 1, so each product lies in an interval that narrows from plane to plane, and a row is dropped once

* as a positive, its interval ends below the k-th largest lower end of the anchor's class, or
* as a negative, its interval misses the windows of all positives, or ends below the k-th largest lower end of those surely within.

A cell gives each anchor at most k rows, with exact products after the last plane, and the best k over all cells are the answer.

Defined edges: a row whose label, vector or vec_id is null, or that has a null or non-finite component, takes no part. A repeated row is a row of its
own: it may be the positive of its twin, and repeated anchors are answered each. Vectors of unequal length are filled up with zeros. A positive with a
negative score has an empty window, one with score 0 takes scores of 0. An empty table gives an empty result; extra columns are ignored. A component
so large that a product may pass 64 bits is an error, as scores are longs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialize

ROWS, ANCHORS = 8192, 16384
PACKED = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("planes", pa.binary()), ("over", pa.int64()), ("under", pa.int64())])
PACKED_DDL = "uid long, vec_id long, label long, anchor boolean, planes binary, over long, under long"
FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor long, positive int, uid long, vec_id long, score long"

#: (lower ends, upper ends) -> which of them stay
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, words) of uint64: plane j holds bit j of every component in two's complement."""
    wide = np.zeros((len(values), bits, -(-values.shape[1] // 64) * 64), dtype=bool)
    for j in range(bits):
        wide[:, j, : values.shape[1]] = (values >> j) & 1
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")


def plane_weights(bits: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(bits)
    weights[-1] = -weights[-1]
    return weights


def products(planes: np.ndarray, anchor: np.ndarray, over: int, under: int, stay: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(positions, exact products) of the rows that `stay` keeps while their intervals narrow.

    over, under: sums of the anchor's positive and of its negated negative components; what is still open of a component, times these, are the ends.
    """
    bits = planes.shape[1]
    weights = plane_weights(bits)
    live, known = np.arange(len(planes)), np.zeros(len(planes), dtype=np.int64)
    for j in range(bits - 1, -1, -1):
        common = np.bitwise_count(planes[live, j, None, :] & anchor[None]).sum(axis=2, dtype=np.int64)
        known = known + weights[j] * (common @ weights)
        rest = (1 << j) - 1
        kept = stay(known - rest * under, known + rest * over)
        live, known = live[kept], known[kept]
    return live, known


def best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which intervals may still be among the k largest."""
    return np.ones(len(low), dtype=bool) if len(low) <= k else high >= np.partition(low, len(low) - k)[len(low) - k]


def windows(low: np.ndarray, high: np.ndarray, bounds: list[tuple[int, int]], k: int) -> np.ndarray:
    """Which intervals may still be among the k largest within any of the bounds (both ends included)."""
    out = np.zeros(len(low), dtype=bool)
    for least, most in bounds:
        fits = (high >= least) & (low <= most)
        sure = low[fits & (low >= least) & (high <= most)]
        if len(sure) > k:
            fits &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
        out |= fits
    return out


def pack(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """Every row that takes part, numbered, as bit-planes, in the shared folder: uid, vec_id, label, anchor, planes, over, under."""
    real = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), real.alias("x"))
    inf = float("inf")
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    rows = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    size = F.array_max(F.transform("x", lambda x: F.abs(scale * x)))
    most, width = rows.agg(F.coalesce(F.max(size), F.lit(0.0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if 2 * np.log2(max(most, 1) + 1) + np.log2(max(width, 1)) > 62:
        raise ValueError("the products of such large components do not fit into 64 bits")
    bits = int(np.floor(most)).bit_length() + 2

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = np.zeros((part.num_rows, max(width, 1)), dtype=np.int64)
                flat, ends = part.column("x").values.to_numpy(), part.column("x").offsets.to_numpy()
                held = np.diff(ends)
                place = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], held)
                values[np.repeat(np.arange(len(held)), held), place] = np.floor(scale * flat[ends[0] : ends[-1]]).astype(np.int64)
                yield batch_of(
                    PACKED, planes=[p.tobytes() for p in bit_planes(values, bits)], over=np.maximum(values, 0).sum(axis=1), under=np.maximum(-values, 0).sum(axis=1),
                    **{c: part.column(c) for c in ("uid", "vec_id", "label", "anchor")},
                )

    out = materialize(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "anchor", "x").mapInArrow(run, PACKED_DDL))
    out.bits = bits
    return out


def cells(packed: DataFrame, anchors: DataFrame, answer: Callable[[dict, dict, int, int, int], list], least: int) -> DataFrame:
    """Every anchor against all rows, a block of anchors by a block of rows a cell; answer() gives one anchor's FOUND columns (own label at first..last).

    Blocks have about ROWS and ANCHORS rows, whatever the input; `least` blocks of rows spread small inputs over the cores.
    """
    n_rows, n_anchors = packed.count(), anchors.count()
    tall, wide, bits = max(least, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS)), packed.bits
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.withColumn("i", block(tall)).withColumn("j", every(wide)).groupBy("i", "j")
    # both sides come from one table: new names keep Spark from taking their columns for the same
    right = anchors.withColumn("j", block(wide)).withColumn("i", every(tall)).toDF(*(f"a_{c}" for c in [*anchors.columns, "j", "i"])).groupBy("a_i", "a_j")

    def columns(part: pa.Table) -> dict:
        part = part.rename_columns([c.removeprefix("a_") for c in part.column_names])
        out = {c: part.column(c).to_numpy() for c in ("uid", "vec_id", "label", "over", "under")}
        raw = b"".join(part.column("planes").to_pylist())
        return out | {"planes": np.frombuffer(raw, dtype="<u8").reshape(part.num_rows, bits, -1), "bounds": part.column("bounds").to_pylist() if "bounds" in part.column_names else None}

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return FOUND.empty_table()
        own, out = columns(rows), []
        by_label = np.argsort(own["label"], kind="stable")
        own = {k: v[by_label] if v is not None else None for k, v in own.items()}
        ask = columns(asks)
        for a in range(asks.num_rows):
            first, last = np.searchsorted(own["label"], [ask["label"][a], ask["label"][a] + 1])
            out += answer(own, ask, a, first, last)
        parts = [np.concatenate(x) for x in zip(*out)] if out else [[] for _ in FOUND]
        return pa.Table.from_batches([batch_of(FOUND, **dict(zip(FOUND.names, parts)))])

    return left.cogroup(right).applyInArrow(run, FOUND_DDL)


def top(own: dict, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions within `at` of the k best: higher score, then smaller vec_id."""
    return np.lexsort((own["uid"][at], own["vec_id"][at], -score))[:k]


def nearest_of_class(packed: DataFrame, k: int, least: int) -> DataFrame:
    """anchor (uid), and the k best other rows of its label: positive (number from 1), uid, vec_id, score."""

    def answer(own: dict, ask: dict, a: int, first: int, last: int) -> list:
        other = first + np.flatnonzero(own["uid"][first:last] != ask["uid"][a])
        live, score = products(own["planes"][other], ask["planes"][a], int(ask["over"][a]), int(ask["under"][a]), lambda low, high: best(low, high, k))
        at = other[live]
        chosen = top(own, at, score, k)
        at, score = at[chosen], score[chosen]
        return [(np.full(len(at), ask["uid"][a]), np.zeros(len(at), dtype=np.int32), own["uid"][at], own["vec_id"][at], score)]

    found = cells(packed, packed.where("anchor"), answer, least)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("positive", F.row_number().over(order)).where(F.col("positive") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, least_blocks: int = 6
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, embedding, label).

    Each row where `anchor` holds gets its best `positives` other rows of its label; each of these gets the best `negatives` rows of other labels whose score
    is between low_percent and high_percent of the positive's.
    """
    packed = pack(vectors, anchor, scale)
    near = materialize(nearest_of_class(packed, positives, least_blocks))
    bound = F.struct(
        F.col("positive").alias("n"), (-F.expr(f"(-score * {low_percent} - pmod(-score * {low_percent}, 100)) div 100")).alias("least"),
        F.expr(f"(score * {high_percent} - pmod(score * {high_percent}, 100)) div 100").alias("most"),
    )
    bounds = near.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(bound)).alias("bounds"))
    asks = packed.where("anchor").join(bounds, "uid")

    def answer(own: dict, ask: dict, a: int, first: int, last: int) -> list:
        limits = [(b["least"], b["most"]) for b in ask["bounds"][a]]
        other = np.concatenate([np.arange(first), np.arange(last, len(own["uid"]))])
        live, known = products(own["planes"][other], ask["planes"][a], int(ask["over"][a]), int(ask["under"][a]), lambda low, high: windows(low, high, limits, negatives))
        out = []
        for b in ask["bounds"][a]:
            inside = (known >= b["least"]) & (known <= b["most"])
            at, worth = other[live[inside]], known[inside]
            chosen = top(own, at, worth, negatives)
            at, worth = at[chosen], worth[chosen]
            out.append((np.full(len(at), ask["uid"][a]), np.full(len(at), b["n"], dtype=np.int32), own["uid"][at], own["vec_id"][at], worth))
        return out

    found = cells(packed, asks, answer, least_blocks)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = packed.where("anchor").select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = near.select("anchor", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "positive"]).join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def embedding_digests(vectors: DataFrame) -> DataFrame:
    """hard_negatives() of every hundredth vector, where every seventh row bears the next label, as if mislabelled."""
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", flipped.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""
