"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of word-shingle hashes; texts with equal sets form a class, whose smallest doc_id stands for it.
2. Banded MinHash puts classes into buckets. The number of bands follows from the threshold and `band_miss`.
3. Each bucket's members are compared with its smallest (a star, not all pairs); verified links give first components.
4. Buckets that still hold several components are compared across components, in cells of bounded size, so that no link between
   different texts is lost whichever member it joins.
5. Verifying a pair: signatures are compared in batches; after each, the pair goes if the posterior probability (uniform prior)
   that its likeness reaches the threshold is under `miss` (a posterior at each batch, not a rate over all). Survivors are counted out on full sets.

Defined edges: a text without words (null, empty, white space) has an empty set and links with nothing. Fewer words than a
shingle takes are one shingle. Rows without doc_id link with nothing and stay. A doc_id that repeats with other texts is
judged row by row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, texts_in_blocks
from .graphs import connected_components

ROWS, BATCH, BATCHES, CELL = 3, 64, 12, 4096
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1
HASH_XOR = _rng.integers(0, 1 << 32, 4096, dtype=np.uint32)
HASH_MUL = _rng.integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = (np.full(n, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are stretches of data, as UTF-8."""
    text = FOLD[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    solid = ~BLANK[text]
    edge = np.zeros(len(text) + 1, dtype=bool)  # where a word may not go on
    edge[at] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))) if len(text) else np.empty(0, dtype=np.int64)
    end = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1 if len(text) else begin
    powers.reach(len(text) + 1)
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[text] * powers.up[: len(text)], out=total[1:])
    word = mix((total[end] - total[begin]) * powers.down[begin] + (end - begin).astype(np.uint64))
    bound = np.searchsorted(begin, at)
    out = []
    rolled = word.copy() if len(word) < words else sum_shingles(word, words)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix(sum_short(word[a:b])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def sum_shingles(word: np.ndarray, words: int) -> np.ndarray:
    acc = np.zeros(len(word) - words + 1, dtype=np.uint64)
    for j in range(words):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - words + 1 + j]
    return mix(acc)


def sum_short(word: np.ndarray) -> np.ndarray:
    acc = np.uint64(len(word) * 0x51ED27)
    with np.errstate(over="ignore"):
        for w in word:
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + w
    return np.array([acc], dtype=np.uint64)


def minima(shingles: np.ndarray, first: int, n: int) -> np.ndarray:
    """n MinHash values (uint32), from hash function `first` on."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    a, m = HASH_XOR[first : first + n], HASH_MUL[first : first + n]
    for at in range(0, len(x), 1024):
        part = (x[at : at + 1024, None] ^ a) * m
        part ^= part >> np.uint32(15)
        np.minimum(out, (part * np.uint32(0x2C1B3C6D)).min(axis=0), out=out)
    return out


def n_bands(threshold: float, band_miss: float) -> int:
    """Bands of ROWS values so that a pair at the threshold shares none with probability at most band_miss."""
    return math.ceil(math.log(band_miss) / math.log(1 - threshold**ROWS))


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each number of batches: the fewest matches that keep a pair. P(likeness >= threshold | m of n) is P(Bin(n+1, t) <= m)."""
    t, out = threshold + (1 - threshold) / 256, []
    for k in range(1, BATCHES + 1):
        n, total = k * BATCH + 1, 0.0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(t) + (n - m) * math.log(1 - t))
            if total >= miss:
                out.append(m)
                break
    return np.array(out)


def survivors(one: np.ndarray, others: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of others (uint8 signatures) may still reach the threshold against one, batch by batch."""
    live, seen = np.arange(len(others)), np.zeros(len(others), dtype=np.int64)
    for k in range(BATCHES):
        if not len(live):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (others[live, part] == one[part]).sum(axis=1)
        fine = seen >= least[k]
        live, seen = live[fine], seen[fine]
    return live


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
NODE = pa.schema([("rep", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])
PAIR_DDL = "a long, b long"


def band_keys(shingles: np.ndarray, bands: int) -> np.ndarray:
    values = minima(shingles, 0, bands * ROWS).astype(np.uint64).reshape(bands, ROWS)
    acc = np.arange(bands, dtype=np.uint64)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return acc.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets; null for the empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column("doc_id")
            n, keys, values = [], [], []
            for _, _, data, at in texts_in_blocks(batch):
                for s in shingle_sets(data, at, words, powers):
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    values.append(band_keys(s, bands) if len(s) else [])
            yield batch_of(SKETCH, doc_id=ids, n_shingles=n, set_key=keys, bands=values)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def nodes_of(docs: DataFrame, reps: DataFrame, words: int, bands: int) -> DataFrame:
    """rep, signature, shingles of the classes that share a bucket with another, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column("rep")
            for first, last, data, at in texts_in_blocks(batch):
                sets = shingle_sets(data, at, words, powers)
                yield batch_of(NODE, rep=ids.slice(first, last - first), signature=[minima(s, bands * ROWS, BATCH * BATCHES).astype(np.uint8).tobytes() for s in sets], shingles=[s.tobytes() for s in sets])

    texts = docs.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(reps, "rep", "left_semi").mapInArrow(run, "rep long, signature binary, shingles binary")


def verified(pairs: DataFrame, nodes: DataFrame, percent: int, least: np.ndarray, pruned: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def side(column: str, name: str) -> DataFrame:
        return nodes.select(F.col("rep").alias(name), F.col(column).alias(f"x{name}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("xa", "xb"))
                live, seen = np.arange(len(one)), np.zeros(len(one), dtype=np.int64)
                for k in range(BATCHES):
                    part = slice(k * BATCH, (k + 1) * BATCH)
                    seen = seen + (one[live, part] == two[live, part]).sum(axis=1)
                    live, seen = live[seen >= least[k]], seen[seen >= least[k]]
                yield batch.select(["a", "b"]).take(pa.array(live))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, type=pa.int64()))

    if not pruned:
        pairs = pairs.join(side("signature", "a"), "a").join(side("signature", "b"), "b").select("a", "b", "xa", "xb").mapInArrow(prune, PAIR_DDL)
    return pairs.join(side("shingles", "a"), "a").join(side("shingles", "b"), "b").select("a", "b", "xa", "xb").mapInArrow(exact, PAIR_DDL)


def cell_pairs(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by cell: the pairs of different components in each cell that the posterior leaves, each in the first band it shares."""
    key, rows = None, []

    def close() -> pa.RecordBatch:
        a, b = [], []
        block, rep, comp, band = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 3))
        keys = np.array([r[4] for r in rows])
        sigs = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        low, high = key[1], key[2]
        order = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in order[0].tolist():
            other = order[1] if low != high else order[1][order[1] > i]
            other = other[comp[other] != comp[i]]
            other = other[~(keys[other, : band[i]] == keys[i, : band[i]]).any(axis=1)]
            if len(other):
                hit = other[survivors(sigs[i], sigs[other], least)]
                a.append(np.minimum(rep[hit], rep[i]))
                b.append(np.maximum(rep[hit], rep[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), type=pa.int64()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high", "block", "rep", "comp", "band", "bands", "signature"))):
            if row[:3] != key:
                if rows:
                    yield close()
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield close()


def components(docs: DataFrame, words: int = 3, percent: int = 85, band_miss: float = 1e-8, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; documents are linked from `percent` of 100 likeness on."""
    threshold = percent / 100
    bands, least = n_bands(threshold, band_miss), least_matches(threshold, miss)
    made = materialize(sketches(docs, words, bands))
    known = made.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    firsts = known.join(classes.select("set_key", "rep"), "set_key").where("doc_id = rep").select("rep", "bands").distinct()
    dealt = firsts.select("rep", "bands", F.posexplode("bands").alias("band", "bucket"))
    narrow = materialize(dealt.select("bucket", "rep", "band"))
    buckets = narrow.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("other")).where("leader <> other").drop("other")
    members = materialize(narrow.join(buckets, "bucket"))
    nodes = materialize(nodes_of(docs, members.select("rep").distinct(), words, bands))
    stars = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(verified(stars, nodes, percent, least))
    found = connected_components(links)
    # buckets that hold several components still
    placed = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    rest = materialize(placed.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    full = rest.join(nodes.select("rep", "signature"), "rep").join(firsts.join(rest.select("rep").distinct(), "rep", "left_semi"), "rep")
    cells = full.withColumn("far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "far")).withColumn("high", F.greatest("block", "far"))
    cells = cells.select("bucket", "low", "high", "block", "rep", "comp", "band", "bands", "signature").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep")
    across = materialize(cells.mapInArrow(lambda it: cell_pairs(it, least), PAIR_DDL).distinct())
    more = verified(across, nodes, percent, least, pruned=True)
    final = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("component").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.least("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, **how) -> DataFrame:
    """One document of each component stays, the one with its smallest doc_id, as it is.

    A doc_id that repeats goes if none of its texts is kept, else all its rows stay. Rows without doc_id stay.
    """
    found = components(docs, words, percent, **how).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return docs.join(materialize(found.where("not kept").select("doc_id")), "doc_id", "left_anti")
