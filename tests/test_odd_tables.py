"""Queries against their SQL on odd tables: customers thrice under other keys (ties everywhere), two of them without orders, event numbers of more than two digests' levels."""

import duckdb
import pytest

from corvane import catalog
from corvane.operators import shapes
from test_queries import SF, TABLES, rows_of

KEYS = {"customer": {"c_custkey": 1000}, "orders": {"o_orderkey": 10_000, "o_custkey": 1000}, "lineitem": {"l_orderkey": 10_000}, "events": {"event_id": 70_000}}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folder and DuckDB connection."""
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        own = f"'{SF}/{t}.parquet'"
        types = dict(con.sql(f"SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM {own})").fetchall())
        moved = ", ".join(f"CAST({c} + i * {step} AS {types[c]}) AS {c}" for c, step in KEYS.get(t, {}).items())
        rows = f"SELECT t.* REPLACE ({moved}) FROM range(3) r(i), {own} t" if moved else f"SELECT * FROM {own}"
        if t == "orders":
            rows = f"SELECT * FROM ({rows}) WHERE o_custkey NOT IN (5, 1017)"
        con.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", "state_rollup merkle_digest index_geometric index_current_future outlook rank_and_tier template_brief three_indices tier_extent tier_fixed_edges rank_intervals v1_rank_intervals mc_weights mc_four_axis knn_impute imputation_churn imputation_sensitivity".split())
def test_odd_tables_against_sql(spark, odd, name):
    folder, duck = odd
    got = rows_of(catalog.QUERIES[name](spark, folder).toPandas())
    assert got == rows_of(duck.sql(catalog.ORACLES[name]).df())


def test_centres_that_tie_at_a_cells_side(spark):
    """Two centres at a distance of a cell's side, one of them a rounding error farther: the smaller id."""
    points = spark.createDataFrame([(1, 14.0, 16.0), (2, 13.0, 16.0)], "point long, x double, y double")
    centres = spark.createDataFrame([(23, 12.0 - 2e-15, 16.0), (24, 16.0, 16.0)], "id int, cx double, cy double")
    assert {r["point"]: r["id"] for r in shapes.nearest_centre(points, centres, 1.0).collect()} == {1: 23, 2: 23}


def test_rank_quantiles_where_classes_share_scores(spark):
    """Classes of several entities, some of which share a score in some draws, against ranks made one by one."""
    import numpy as np

    from corvane.plans.validation import firsts, rank_quantiles

    members = [(e, min(e % 7, 5)) for e in range(60)]
    first = {c: min(e for e, k in members if k == c) for _, c in members}
    score = {(d, c): float((c * (d + 3)) % (4 if d % 2 else 11)) for d in range(9) for c in first}
    scores = spark.createDataFrame([(d, first[c], sum(k == c for _, k in members), s) for (d, c), s in score.items()], "draw int, cls long, n long, s double")
    inside = spark.createDataFrame([(e, first[c]) for e, c in members], "entity long, cls long")
    orders = [sorted(members, key=lambda m: (-score[d, m[1]], m[0])) for d in range(9)]
    want = {e: list(np.quantile([o.index((e, c)) + 1 for o in orders], [0.05, 0.95])) for e, c in members}
    got = {r["entity"]: r["q"] for r in rank_quantiles(scores, inside, [0.05, 0.95]).collect()}
    assert set(got) == set(want) and all(got[e] == pytest.approx(want[e]) for e in want)
    assert {(r["draw"], r["entity"]) for r in firsts(scores, inside, 13).collect()} == {(d, e) for d, o in enumerate(orders) for e, _ in o[:13]}
