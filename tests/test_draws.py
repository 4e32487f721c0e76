"""Ranks within many draws at once, against pandas."""

import numpy as np
import pandas as pd

from corvane.operators import draws, ranks
from corvane.operators.order_statistics import medians


def test_ranks_in_draws_against_pandas(spark):
    """Hot values, nulls, NaN and classes that a draw leaves out; 4 buckets, so that rows meet in and over them."""
    rng = np.random.default_rng(3)
    n, d = 400, 5
    a = [None if k % 17 == 0 else float("nan") if k % 29 == 0 else float(k % 3 if k % 2 else rng.integers(0, 90)) for k in range(n)]
    b = [float(x) for x in rng.normal(size=n)]
    c = rng.integers(0, 3, size=(n, d))
    rows = spark.createDataFrame([(k, [int(x) for x in c[k]], a[k], b[k]) for k in range(n)], "cls long, c array<int>, a double, b double").repartition(3)
    got, sizes = draws.ranks_in_draws(rows, ["a", "b"], d, buckets=4)
    got = {(r["cls"], r["i"]): r["r"] for r in got.collect()}
    assert len(got) == n + sum(x is not None for x in a)
    for i, column in enumerate((a, b)):
        known = [k for k in range(n) if column[k] is not None]
        value = pd.Series([float("inf") if np.isnan(column[k]) else column[k] for k in known])  # NaN is the largest value, as in Spark's order
        for j in range(d):
            each = np.repeat(np.arange(len(known)), c[known, j])
            want = pd.Series(value.to_numpy()[each]).rank().groupby(each).first()
            assert sizes[i, j] == len(each)
            assert all(got[known[k], i][j] == 2 * want[k] for k in want.index)


def test_class_counts(spark):
    rows = spark.createDataFrame([(k % 4, [1, k % 2, 0]) for k in range(100)], "cls long, c array<tinyint>").repartition(7)
    assert {r["cls"]: r["c"] for r in draws.class_counts(rows, 3).collect()} == {0: [25, 0, 0], 1: [25, 25, 0], 2: [25, 0, 0], 3: [25, 25, 0]}


def test_weights_count_as_so_many_rows(spark):
    rows = spark.createDataFrame([("x", float(k % 7), k % 4 + 1) for k in range(60)] + [("y", 1.0, 2)], "g string, v double, w int")
    copies = rows.selectExpr("g", "v", "w", "explode(sequence(1, w))").select("g", "v", "w")
    found = lambda frame, **more: {(r["g"], r["v"], r["rank"], r["n"]) for r in ranks.average_ranks(frame, ["g"], "v", **more).collect()}
    assert found(rows, weight="w") == found(copies)
    assert sorted(medians(rows, ["g"], "v", "m", weight="w").collect()) == sorted(medians(copies, ["g"], "v", "m").collect())


def test_bootstrap_scores_classes_of_alike_entities(spark, tmp_path):
    """Three copies of the tables have as many rows to rank in a draw as one."""
    import os

    import duckdb
    import pytest

    from corvane.plans import validation

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no fixture tables")
    for t, moved in {"customer": "c_custkey + 1000 * i AS c_custkey", "orders": "o_orderkey + 10000 * i AS o_orderkey, o_custkey + 1000 * i AS o_custkey", "lineitem": "l_orderkey + 10000 * i AS l_orderkey"}.items():
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({moved}) FROM range(3) r(i), '{sf}/{t}.parquet' t) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    scores, members = validation._resampled_classes(spark, str(tmp_path), 2)
    once = validation._resampled_classes(spark, sf, 2)[1]
    assert members.select("cls").distinct().count() == once.select("cls").distinct().count() and members.count() == 3 * once.count()
    each = validation._resampled(spark, str(tmp_path), 2)
    assert scores.groupBy().sum("c").first()[0] == each.count() == each.select("draw", "entity").distinct().count()


def test_kendall_within_blocks_makes_no_pairs(spark):
    """Ties, missing values on one side only, blocks of one row and of ties alone; groups of 16 rows, so that blocks are cut."""
    import math

    from corvane.operators import stats

    rng = np.random.default_rng(5)
    rows = [("ab"[k % 2], k, None if k % 13 == 0 else float(rng.integers(0, 12)), None if k % 11 == 0 else float(rng.normal() if k % 3 else k % 5)) for k in range(240)]
    rows += [("one", 1000, 1.0, 2.0), *(("tied", 1001 + k, 1.0, float(k)) for k in range(3)), *(("none", 1010 + k, None, None) for k in range(2))]
    frame = spark.createDataFrame(rows, "g string, entity int, x double, y double").repartition(4)
    found = stats.kendall(frame, "x", "y", "g", size=16)
    got = {r["g"]: r["tau_b"] for r in found.collect()}
    assert set(got) == {"a", "b", "tied", "none"} and got["tied"] is None and got["none"] is None
    sign = lambda p, q: None if p is None or q is None else (p > q) - (p < q)
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        both = [(sign(p[2], q[2]), sign(p[3], q[3])) for i, p in enumerate(own) for q in own[:i]]
        s = sum(u * v for u, v in both if u is not None and v is not None)
        assert math.isclose(got[g], s / math.sqrt(sum(abs(u) for u, _ in both if u is not None) * sum(abs(v) for _, v in both if v is not None)), rel_tol=1e-12)
    assert "e1" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair of entities is made


def test_a_draw_reads_columns_of_the_whole_table(spark):
    """Shares of ranks among the rows of a draw, and the middle shift, against pandas; ties, missing values, files of 50 rows."""
    from corvane.operators.storage import block, in_blocks

    rng = np.random.default_rng(8)
    value = pd.Series([None if k % 13 == 0 else float(rng.integers(0, 40)) for k in range(400)], dtype=float)
    rows = [(k, 0 if np.isnan(r) else int(r), bool(rng.random() < 0.6)) for k, r in enumerate(value.rank())]
    files = in_blocks(spark.createDataFrame(rows, "entity long, k long, taken boolean").repartition(3), ["entity"], 50)
    read = lambda c: np.concatenate([block(f, [c])[0] for f in files])
    assert len(files) >= 8 and read("entity").tolist() == list(range(400)) and max(len(block(f, ["k"])[0]) for f in files) <= 50
    taken = read("taken")
    want = value[taken].rank(pct=True).to_numpy()
    assert np.allclose(draws.shares_in_draw(files, "k", taken), want, rtol=1e-12, equal_nan=True)
    score, position = rng.integers(0, 30, 90).astype(float), np.r_[rng.random(89) * 90, np.nan]
    shift = (pd.Series(score).rank(ascending=False) / 90 * 200 - position).abs()
    assert abs(draws.middle_shift(score, position, 200.0) - shift.median()) < 1e-9


def test_ranks_and_firsts_over_draws_without_rows_by_draw(spark):
    """Ties, draws cut into ranges of scores, files in pieces of 16 entities, against ranks made one by one."""
    rng = np.random.default_rng(6)
    n, d = 300, 20
    a, b = rng.integers(0, 30, n) * 3.0, np.where(rng.random(n) < 0.3, 50.0, rng.random(n) * 100)
    keys = rng.permutation(n * 3)[:n]
    rows = spark.createDataFrame([(int(k), float(x), float(y)) for k, x, y in zip(keys, a, b)], "entity long, a double, b double").repartition(3)
    share = np.linspace(0, 1, d)

    def score(columns, at):
        return np.round(np.outer(share[at], columns[0]) + np.outer(1 - share[at], columns[1]), 1)

    s = score([a, b], np.arange(d))
    orders = [np.lexsort((keys, -own)) for own in s]
    ranks_of = np.empty((d, n))
    for i, order in enumerate(orders):
        ranks_of[i, order] = np.arange(1, n + 1)
    want = dict(zip(keys.tolist(), np.quantile(ranks_of, [0.05, 0.95], axis=0).T.tolist()))
    for most in (1 << 22, 70):
        found = draws.rank_quantiles_in_draws(rows, ["a", "b"], d, score, [0.05, 0.95], piece=16, most=most)
        got = {r["entity"]: r["q"] for r in found.collect()}
        assert set(got) == set(want) and all(np.allclose(got[e], want[e], atol=1e-9) for e in want)
    top = draws.top_in_draws(rows, ["a", "b"], d, score, 7, step=50)
    assert sorted((r["draw"], r["entity"]) for r in top.collect()) == sorted((i, int(keys[k])) for i, order in enumerate(orders) for k in order[:7])
    assert "Generate" not in top._jdf.queryExecution().optimizedPlan().toString()  # no row is copied for a draw
