"""Exact quantiles against numpy, with ties, hot values, heavy tails, empty and one-row groups; no task sorts a group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators.order_statistics import medians, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize(("bins", "most"), [(4, 10), (16, 100), (256, 1 << 17)])
def test_quantiles_like_numpy(spark, bins, most):
    rng = random.Random(bins)
    rows = [("hot", 5.0 if i % 3 else rng.random() * 10) for i in range(3000)] + [("tail", math.exp(rng.gauss(0, 60))) for _ in range(1500)] + [("two", 1.0), ("two", -1.0), ("one", 7.0), ("none", None)]
    rows += [("flat", 2.5)] * 500 + [("nan", float("nan")), ("nan", 3.0)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in quantiles(frame, ["g"], "x", PROBS, bins, most).collect()}
    groups = {}
    for g, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and np.allclose(got[g][1], np.quantile(xs, PROBS), rtol=1e-12)


def test_quantiles_without_groups(spark):
    frame = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert quantiles(frame, [], "x", [0.25, 0.5, 0.755]).first().asDict() == {"n": 101, "quantiles": [25.0, 50.0, 75.5]}
    assert quantiles(frame.limit(0), [], "x", [0.5]).first().asDict() == {"n": 0, "quantiles": [None]}
    assert quantiles(frame.limit(0), ["x"], "x", [0.5]).count() == 0


def test_no_cell_is_larger_than_allowed(spark):
    """Values are put in order in cells of at most `most` distinct values, and no percentile of a group is asked for."""
    frame = spark.range(5000).select(F.pmod("id", F.lit(3)).alias("g"), F.sqrt(F.col("id").cast("double")).alias("x"))
    found = quantiles(frame, ["g"], "x", [0.5], bins=8, most=60)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    want = {g: float(np.median([math.sqrt(i) for i in range(g, 5000, 3)])) for g in range(3)}
    assert {r["g"]: r["quantiles"][0] for r in found.collect()} == pytest.approx(want)
    assert {r["g"]: r["m"] for r in medians(frame, ["g"], "x", "m").collect()} == pytest.approx(want)


def test_values_are_placed_without_lambdas(spark, monkeypatch):
    """A lambda over all cuts for each value cost most of a round; small groups stay as they are beside a large one, through several rounds."""
    monkeypatch.setattr(F, "filter", None)
    frame = spark.range(3000).select(F.when(F.col("id") < 40, F.col("id") % 2).alias("g"), F.sqrt(F.col("id").cast("double")).alias("x")).fillna(7)
    got = {r["g"]: r["quantiles"] for r in quantiles(frame, ["g"], "x", [0.1, 0.5, 0.11], bins=8, most=50).collect()}
    for g, ids in ((0, range(0, 40, 2)), (1, range(1, 40, 2)), (7, range(40, 3000))):
        assert got[g] == pytest.approx(list(np.quantile([math.sqrt(i) for i in ids], [0.1, 0.5, 0.11])))
