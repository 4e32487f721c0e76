"""Scores and ranks within many draws without a row for each entity and draw.

`top_in_draws` scores rows in all draws where they lie and keeps the best. `rank_quantiles_in_draws` puts draws in order in tasks that read the whole table's files.
`shares_in_draw` and `middle_shift` work on one draw's entities in one task (about 40 bytes each), which reads columns of the whole table's files.
`ranks_in_draws`: a row carries an array with its count in every draw, so no row is copied for a draw. Each column is put in order once, in buckets; what a draw's rows have before a value is a
running sum of the counts, for all draws side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import below, reused
from .storage import block, in_blocks, lengths

BUCKETS, CHUNK = 128, 4096


def shares_in_draw(files: list[str], column: str, taken: np.ndarray) -> np.ndarray:
    """The average rank over the count of the rows that a draw takes, among those that have a value; NaN where one has none. The column holds the whole part of a rank among all rows (0 without a value), which
    orders values and tells them apart, so a running count by it gives the ranks in the draw, and no value is sorted."""
    own = np.concatenate([block(f, [column])[0] for f in files])[taken]
    upto = np.bincount(own, minlength=1)
    upto[0] = 0
    np.cumsum(upto, out=upto)
    twice = np.where(own > 0, upto[own] + upto[np.maximum(own, 1) - 1] + 1, np.nan)
    return twice / 2 / max(int(upto[-1]), 1)


def middle_shift(score: np.ndarray, position: np.ndarray, whole: float) -> float:
    """The median distance of a draw's ranks (highest score first, average of ties), scaled to `whole`, from positions (NaN: none)."""
    order = np.argsort(score)
    inside = score[order]
    starts = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
    ends = np.r_[starts[1:], len(score)]
    rank = np.empty(len(score))
    rank[order] = np.repeat((starts + ends + 1) / 2, ends - starts)
    shift = np.abs((len(score) + 1 - rank) / len(score) * whole - position)
    known = shift[~np.isnan(shift)]
    return float(np.median(known)) if len(known) else float("nan")


def chunk_of(key: str, chunks: int):
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """One row a class: its members' arrays, added."""
    part = part.sort_values("cls", kind="stable")
    keys, starts = np.unique(part.cls.to_numpy(), return_index=True)
    return pd.DataFrame({"cls": keys, "c": list(np.add.reduceat(np.stack(part.c).astype(np.int32), starts, axis=0))})


def class_counts(members: DataFrame, chunks: int) -> DataFrame:
    """cls, c: the sum of the arrays c of each class's members. Batches are added up where they are, so a large class is a few rows when it meets."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield _summed(part[["cls", "c"]])

    few = members.select("cls", "c").mapInPandas(partial, "cls long, c array<int>")
    return few.groupBy(chunk_of("cls", chunks)).applyInPandas(_summed, "cls long, c array<int>")


def ranks_in_draws(rows: DataFrame, columns: list[str], draws: int, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray]:
    """cls, i, r of each class (cls, c: its count in every draw) and column number i where it has a value, and n[i, draw], the counts of all that have one.

    r is twice the average rank in each draw, as if each class were its count of rows. Cuts are approximate quantiles; a value that many classes share is a cut, and
    a bucket of its own, in which nothing has to be put in order: it is spread over tasks. The driver gets the buckets' totals, a fixed number for each draw and column.
    """
    points = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    found = rows.agg(*(F.percentile_approx(c, points, 10000).alias(c) for c in columns)).first()
    codes = [below({(): sorted({float(x) for x in found[c] or []})}, [], F.col(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
    placed = reused(rows.select("cls", "c", *columns, *codes))
    most = 2 * buckets

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((len(columns), most, draws), dtype=np.int64)
        for part in batches:
            if len(part):
                c = np.stack(part.c)
                for i in range(len(columns)):
                    k = part[f"_k{i}"].to_numpy(dtype=float)
                    known = np.flatnonzero(~np.isnan(k))
                    known = known[np.argsort(k[known], kind="stable")]
                    if len(known):
                        names, starts = np.unique(k[known].astype(int), return_index=True)
                        own[i, names] += np.add.reduceat(c[known], starts, axis=0, dtype=np.int64)
        at = np.argwhere(own.any(axis=2))
        yield pd.DataFrame({"i": at[:, 0].astype(np.int32), "k": at[:, 1].astype(np.int32), "own": [own[i, k] for i, k in at]})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part.i.iloc[:1], "k": part.k.iloc[:1], "own": [np.stack(part.own).sum(axis=0)]})

    shape = "i int, k int, own array<bigint>"
    own = np.zeros((len(columns), most, draws), dtype=np.int64)
    for r in placed.select("c", *(f"_k{i}" for i in range(len(columns)))).mapInPandas(totals, shape).groupBy("i", "k").applyInPandas(added, shape).collect():
        own[r["i"], r["k"]] = r["own"]
    before = np.cumsum(own, axis=1) - own

    def ranked(part: pd.DataFrame) -> pd.DataFrame:
        i, k = int(part.i.iloc[0]), int(part.k.iloc[0])
        if k % 2:  # one value
            return pd.DataFrame({"cls": part.cls, "i": part.i, "r": [(2 * before[i, k] + own[i, k] + 1).astype(np.int32)] * len(part)})
        part = part.sort_values("value", kind="stable")
        v = part.value.to_numpy(dtype=float)
        new = np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))]
        starts = np.flatnonzero(new)
        ties = np.add.reduceat(np.stack(part.c), starts, axis=0, dtype=np.int64)
        twice = (2 * (before[i, k] + np.cumsum(ties, axis=0) - ties) + ties + 1).astype(np.int32)
        return pd.DataFrame({"cls": part.cls, "i": part.i, "r": list(twice[np.cumsum(new) - 1])})

    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_k{i}").alias("k"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)))
    long = placed.select("cls", "c", F.inline(cells)).where("k is not null")
    spread = F.when(F.col("k") % 2 == 1, chunk_of("cls", 64)).otherwise(0)
    return long.groupBy("i", "k", spread.alias("_s")).applyInPandas(ranked, "cls long, i int, r array<int>"), own.sum(axis=1)


#: A scorer: the arrays of some columns, and the numbers of some draws, give a matrix of draws by rows.
Scorer = Callable[[list[np.ndarray], np.ndarray], np.ndarray]


def _firsts(draw: np.ndarray, score: np.ndarray, entity: np.ndarray, k: int) -> np.ndarray:
    """Places of each draw's k highest scores, ties to the smaller entity, in order."""
    order = np.lexsort((entity, -score, draw))
    inside = draw[order]
    return order[np.arange(len(inside)) - np.searchsorted(inside, inside) < k]


def top_in_draws(rows: DataFrame, columns: list[str], draws: int, score: Scorer, k: int, step: int = 2048) -> DataFrame:
    """draw, entity: the k entities of each draw with the highest scores, ties to the smaller entity. A task scores `step` rows in all draws at a time and keeps the k best of each draw; these alone leave it."""
    every = np.arange(draws)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw, found, entity = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        least = np.full(draws, -np.inf)
        for part in batches:
            names = part["entity"].to_numpy()
            arrays = [part[c].to_numpy() for c in columns]
            for a in range(0, len(part), step):
                s = score([x[a : a + step] for x in arrays], every)
                floor = np.maximum(least, np.partition(s, -k, axis=1)[:, -k]) if s.shape[1] > k and np.isinf(least).any() else least
                at, row = np.nonzero(s >= floor[:, None])
                if not len(at):
                    continue
                draw, found, entity = np.r_[draw, at], np.r_[found, s[at, row]], np.r_[entity, names[a + row]]
                keep = _firsts(draw, found, entity, k)
                draw, found, entity = draw[keep], found[keep], entity[keep]
                n = np.bincount(draw, minlength=draws)
                full = n == k
                least[full] = found[np.cumsum(n)[full] - 1]
        yield pd.DataFrame({"draw": draw.astype(np.int32), "s": found, "entity": entity})

    def of_all(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[_firsts(part.draw.to_numpy(), part.s.to_numpy(), part.entity.to_numpy(), k)][["draw", "entity"]]

    few = rows.select(F.col("entity").cast("long").alias("entity"), *columns).mapInPandas(best, "draw int, s double, entity long")
    return few.groupBy("draw").applyInPandas(of_all, "draw int, entity long")


CELLS, PIECE, MOST = 1 << 16, 1 << 14, 1 << 22


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that high bytes, mostly zero, compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(x: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def rank_quantiles_in_draws(rows: DataFrame, columns: list[str], draws: int, score: Scorer, probs: list[float], piece: int = PIECE, most: int = MOST) -> DataFrame:
    """entity, q: quantiles over the draws of an entity's rank, by score (0 to 100), highest first, ties to the smaller entity.

    A task reads the columns of all entities from files, in order of entity, and puts one or a few draws' scores in order; where there are over `most` entities it takes those between two cuts of the draw, found
    by counting all in `CELLS` cells, so that its memory does not grow (but by entities in one cell). Only ranks are shuffled, as four bytes each for pieces of entities.
    """
    files = in_blocks(reused(rows.select(F.col("entity").cast("long").alias("entity"), *columns)), ["entity"], 1 << 18)
    sizes = lengths(files)
    n = sum(sizes)
    parts = max(1, -(-n // most))
    group = max(1, min(most // max(n, 1), draws // 64))
    kind = np.int32 if n < 2**31 else np.int64
    cell = lambda s: np.clip(s * (CELLS / 100), 0, CELLS - 1).astype(np.int64)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            for item in ids.id:
                g, part = divmod(int(item), parts)
                at = np.arange(g * group, min(draws, (g + 1) * group))
                scores = lambda f: score(block(f, columns), at)
                label, above = None, np.zeros(len(at), dtype=np.int64)
                if parts > 1:
                    bins = np.zeros((len(at), CELLS), dtype=np.int64)
                    for f in files:
                        for i, s in enumerate(scores(f)):
                            bins[i] += np.bincount(cell(s), minlength=CELLS)
                    higher = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1] - bins
                    label = higher * parts // n
                    above = (bins * (label < part)).sum(axis=1)
                own = [[] for _ in at]
                for f in files:
                    for i, s in enumerate(scores(f)):
                        inside = np.flatnonzero(label[i][cell(s)] == part) if parts > 1 else None
                        own[i].append((s if inside is None else s[inside], inside))
                for i, d in enumerate(at):
                    s = np.concatenate([x for x, _ in own[i]])
                    order = np.argsort(-s, kind="stable")
                    rank = np.empty(len(s), dtype=kind)
                    rank[order] = np.arange(above[i] + 1, above[i] + 1 + len(s), dtype=kind)
                    out, start = [], 0
                    for f, (x, inside) in enumerate(own[i]):
                        mine = rank[start : start + len(x)]
                        start += len(x)
                        for p in range(-(-sizes[f] // piece)):
                            a, z = (p * piece, (p + 1) * piece) if inside is None else np.searchsorted(inside, (p * piece, (p + 1) * piece))
                            if len(mine[a:z]):
                                out.append((f, p, int(d), b"" if inside is None else _planes((inside[a:z] - p * piece).astype(np.int32)), _planes(mine[a:z])))
                    own[i] = None
                    yield pd.DataFrame(out, columns=["f", "p", "draw", "at", "r"])

    def quantiles(part: pd.DataFrame) -> pd.DataFrame:
        f, p = int(part.f.iloc[0]), int(part.p.iloc[0])
        entity = block(files[f], ["entity"])[0][p * piece : (p + 1) * piece]
        r = np.zeros((draws, len(entity)), dtype=kind)
        for d, at, x in zip(part.draw, part["at"], part.r):
            if len(at):
                r[d, _unplaned(at, np.int32)] = _unplaned(x, kind)
            else:
                r[d] = _unplaned(x, kind)
        ends = [(int(q * (draws - 1)), min(int(q * (draws - 1)) + 1, draws - 1), q * (draws - 1) - int(q * (draws - 1))) for q in probs]
        r.partition(sorted({i for low, high, _ in ends for i in (low, high)}), axis=0)
        q = np.stack([r[low] + (r[high].astype(float) - r[low]) * share for low, high, share in ends], axis=1)
        return pd.DataFrame({"entity": entity, "q": list(q)})

    items = -(-draws // group) * parts if n else 0
    found = rows.sparkSession.range(0, items, numPartitions=max(1, items)).mapInPandas(ranked, "f int, p int, draw int, at binary, r binary")
    return found.groupBy("f", "p").applyInPandas(quantiles, "entity long, q array<double>")
