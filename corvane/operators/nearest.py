"""Exact nearest rows of a matrix with missing cells: tiles of rows that lie close together, compared by matrix products; tiles that are too far off are skipped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TILE, GROUP = 512, 128


def along_curve(z: list[Column]) -> Column:
    """A number that orders rows so that those close together in z mostly lie side by side: bits of each column's sixteenth (of -2 to 2), interleaved."""
    level = [F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(F.floor((x + 2) * 4), F.lit(0)), F.lit(15))).cast("long") for x in z]
    bits = [F.shiftright(x, b).bitwiseAND(F.lit(1)) for b in (3, 2, 1, 0) for x in level][:62]
    return reduce(lambda a, b: a * 2 + b, bits, F.lit(0).cast("long"))


def _in_tiles(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows cut at the middle of the widest column until no part has more than `size`."""
    done, parts = [], [np.arange(len(x))] if len(x) else []
    while parts:
        own = parts.pop()
        if len(own) <= size:
            done.append(own)
            continue
        wide = int(np.argmax(np.ptp(x[own], axis=0)))
        order = np.argpartition(x[own, wide], len(own) // 2)
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


def _by_mask(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which columns are known, and the rows of which that holds."""
    known = ~np.isnan(v)
    packed = np.ascontiguousarray(np.packbits(known, axis=1))
    _, first, code = np.unique(packed.view(f"V{packed.shape[1]}").ravel() if packed.shape[1] > 1 else packed.ravel(), return_index=True, return_inverse=True)
    for i, at in enumerate(first):
        yield known[at], np.flatnonzero(code == i)


class _Asked:
    """Rows that lack column j and know the same columns: the k nearest donors found so far, with their first entity."""

    def __init__(self, rows: np.ndarray, j: int, known: np.ndarray, k: int, width: int):
        self.rows, self.j, self.known = rows, j, known
        self.d = np.full((len(rows), k), np.inf)
        self.first = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.ids = np.zeros((len(rows), k, width), dtype=float)
        self.given = np.zeros((len(rows), k))

    def add(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray, given: np.ndarray) -> None:
        at, k = np.unique(row), self.d.shape[1]
        all_row = np.r_[np.repeat(at, k), row]
        all_d, all_first = np.r_[self.d[at].ravel(), d], np.r_[self.first[at].ravel(), ids[:, 0].astype(np.int64)]
        all_ids, all_given = np.concatenate([self.ids[at].reshape(-1, self.ids.shape[2]), ids]), np.r_[self.given[at].ravel(), given]
        order = np.lexsort((all_first, all_d, all_row))
        place = np.arange(len(order)) - np.searchsorted(all_row[order], all_row[order])
        best = order[place < k].reshape(len(at), k)
        self.d[at], self.first[at], self.ids[at], self.given[at] = all_d[best], all_first[best], all_ids[best], all_given[best]


def neighbours(queries: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]], middle: np.ndarray, spread: np.ndarray, k: int, tile: int = TILE, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column, mean: for each missing cell of the queries (rows of values, NaN where missing) the mean of the k nearest donors that have it; cells without a donor are left out.

    blocks: donors' values and the entities that hold them (ascending, NaN after the last). Distance: root of the mean square of z over shared columns, times all columns; ties go to the smaller entity.
    A matrix product gives distances up to rounding, and what is within the k-th nearest found so far (with room for rounding) is computed again term by term, so ties are those of the plain formula.
    """
    p = queries.shape[1]
    q = (queries - middle) / spread
    asked = [_Asked(rows[own], int(j), mask, k, k) for mask, rows in _by_mask(queries) if mask.any() for j in np.flatnonzero(~mask) for own in _in_tiles(q[rows][:, mask], group)]
    for values, ids in blocks:
        z = (values - middle) / spread
        for mask, own in _by_mask(values):
            cut: dict[bytes, list] = {}
            for a in asked:
                shared = mask & a.known
                if not mask[a.j] or not shared.any():
                    continue
                if shared.tobytes() not in cut:
                    parts = [own[t] for t in _in_tiles(z[own][:, shared], tile)]
                    low, high = (np.stack([f(z[t][:, shared], axis=0) for t in parts]) for f in (np.min, np.max))
                    cut[shared.tobytes()] = [parts, low, high, [None] * len(parts)]
                _search(a, q, z, values, ids, shared, p, *cut[shared.tobytes()])
    row, column, mean = [], [], []
    for a in asked:
        for i in range(len(a.rows)):
            found = np.isfinite(a.d[i])
            if found.any():
                d, e, g = (x.ravel() for x in np.broadcast_arrays(a.d[i][found, None], a.ids[i][found], a.given[i][found, None]))
                some = ~np.isnan(e)
                best = np.lexsort((e[some], d[some]))[:k]
                row.append(a.rows[i])
                column.append(a.j)
                mean.append(float(np.mean(g[some][best])))
    return np.array(row, dtype=np.int64), np.array(column, dtype=np.int64), np.array(mean)


def _search(a: _Asked, q: np.ndarray, z: np.ndarray, values: np.ndarray, ids: np.ndarray, shared: np.ndarray, p: int, parts: list, low: np.ndarray, high: np.ndarray, made: list) -> None:
    """The donors' tiles from the nearest on, each for the queries whose k-th nearest so far is farther off than the tile's box."""
    x, n = q[a.rows][:, shared], int(shared.sum())
    scale, k = p / n, a.d.shape[1]
    least = np.zeros((len(parts), len(x)))
    for c in range(n):
        own = x[:, c]
        least += np.maximum(0.0, np.maximum(low[:, c, None] - own, own - high[:, c, None])) ** 2
    least *= scale
    own = (x**2).sum(axis=1)
    limit = a.d[:, -1] ** 2 * (1 + 1e-9) + 1e-9
    for t in np.argsort(least.min(axis=1), kind="stable"):
        rows = np.flatnonzero(least[t] <= limit)
        if not len(rows):
            continue
        if made[t] is None:
            y = np.ascontiguousarray(z[parts[t]][:, shared].T)
            made[t] = (y, (y**2).sum(axis=0))
        y, square = made[t]
        found = (own[rows, None] + square - 2 * (x[rows] @ y)) * scale
        room = 1e-9 + 1e-12 * scale * (own[rows] + square.max())  # the product's rounding
        upto = limit[rows]
        if np.isinf(upto).any() and found.shape[1] >= k:
            upto = np.minimum(upto, np.maximum(np.partition(found, k - 1, axis=1)[:, k - 1], 0) * (1 + 1e-9) + 2 * room)
        near = found <= (upto + room)[:, None]
        hit = np.flatnonzero(near.any(axis=1))
        if len(hit):
            row, at = np.nonzero(near[hit])
            row, donor = rows[hit[row]], parts[t][at]
            term = np.nan_to_num((z[donor] - q[a.rows[row]]) ** 2)
            a.add(row, np.sqrt(term.sum(axis=1) / n * p), ids[donor], values[donor, a.j])
            limit = np.minimum(limit, a.d[:, -1] ** 2 * (1 + 1e-9) + 1e-9)
