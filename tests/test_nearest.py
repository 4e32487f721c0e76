"""Nearest donors of missing cells against every pair."""

import numpy as np
import pytest

from corvane.operators import matrix
from corvane.operators.nearest import neighbours


def all_pairs(queries, values, ids, middle, spread, k):
    out = {}
    for i, q in enumerate((queries - middle) / spread):
        apart = ((values - middle) / spread - q) ** 2
        n = (~np.isnan(apart)).sum(axis=1)
        d = np.where(n > 0, np.sqrt(np.nansum(apart, axis=1) / np.maximum(n, 1) * queries.shape[1]), np.inf)
        for j in np.flatnonzero(np.isnan(queries[i])):
            fit = [(d[t], e, values[t, j]) for t in np.flatnonzero(~np.isnan(values[:, j]) & np.isfinite(d)) for e in ids[t][~np.isnan(ids[t])]]
            if fit:
                out[i, j] = np.mean([v for *_, v in sorted(fit)[:k]])
    return out


@pytest.mark.parametrize("kind", ["all differ", "ties", "far out", "few donors"])
def test_neighbours_are_those_of_all_pairs(kind):
    """Two blocks, tiles of 32 and groups of 16 rows; rows that know nothing, classes of one to five entities."""
    rng = np.random.default_rng(len(kind))
    n, p, k = (6 if kind == "few donors" else 500), 5, 5
    v = rng.integers(0, 4, size=(n, p)).astype(float) if kind == "ties" else rng.normal(size=(n, p)) ** (5 if kind == "far out" else 1)
    v[rng.random((n, p)) < 0.15] = np.nan
    v[:2] = np.nan
    ids = np.sort(rng.permutation(n * 5).reshape(n, 5).astype(float), axis=1)
    ids[rng.random(n) < 0.7, 1:] = np.nan
    middle, spread = np.nanmean(v, axis=0), np.nanstd(v, axis=0) + 0.1
    queries = v[np.isnan(v).any(axis=1)]
    row, column, mean = neighbours(queries, [(v[: n // 3], ids[: n // 3]), (v[n // 3 :], ids[n // 3 :])], middle, spread, k, tile=32, group=16)
    want = all_pairs(queries, v, ids, middle, spread, k)
    got = dict(zip(zip(row.tolist(), column.tolist()), mean))
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in want)


def test_queries_and_donors_in_many_files(spark):
    """Files of 16 queries and 40 donors give what one file does, and no donor is copied for a query's task."""
    rng = np.random.default_rng(4)
    cells = [(e, c, None if rng.random() < 0.2 else float(rng.normal())) for e in range(150) for c in "abcd"]
    rows = spark.createDataFrame(cells, "entity long, indicator string, value double")
    found = [{(r["entity"], r["indicator"]): r["value"] for r in matrix.impute_neighbours(rows, **more).collect()} for more in ({}, {"block_rows": 40, "query_rows": 16})]
    assert found[0] == found[1] and len(found[0]) == 600 and None not in found[0].values()
