"""Runs of repeated words by tandem repeats: LZ blocks, suffix-link walks, located occurrences.

Documents are taken in batches; a word's code belongs to its document, so one suffix array over a batch is a forest of the documents' suffix trees.

1. Prefix doubling sorts the suffixes. Its levels (classes of substrings of 1, 2, 4, ... words) answer how far two places agree, forwards and backwards.
2. The longest earlier match at each place cuts a document into LZ blocks. The leftmost occurrence of any square lies across one border of a block, so
   agreement before and behind the borders gives squares that cover the leftmost occurrences of all (at most one a border and half length).
3. A square's place in the suffix tree is the interval of its suffixes. From each covering square a walk follows suffix links: drop the first word, go down
   by the same word. As long as there is such a node the rotation is a square as well; a walk ends where no node is or where another one has been.
   This completes the vocabulary of squares with primitive roots; others only repeat a shorter period.
4. The suffixes of the intervals are all occurrences. Occurrences of one half length at consecutive places are one run with that smallest period.

Batches hold about `batch_words` words, one document at least: memory follows the longest document.

Defined edges: a null or empty text, or one of blanks, has no words and no run; its collapsed text is empty. A row without doc_id is taken as it is
(nothing is planted). Repeated rows are answered each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of

BATCH_WORDS = 1 << 18


class Forest:
    """Suffix array, levels of substring classes and neighbours of the documents of a batch (codes, first place of each document)."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.n, self.codes = len(codes), codes
        self.ends = np.repeat(np.append(starts[1:], self.n), np.diff(np.append(starts, self.n)))  # of the document that a place is in
        order = np.argsort(codes, kind="stable")
        rank, crowded = self.classes(order, codes[order])
        self.levels, size = [], 1
        while True:
            self.levels.append(np.append(rank, -1))  # the place behind the last is like no other
            if not len(crowded):
                break
            behind = np.where(crowded + size < self.n, rank[np.minimum(crowded + size, self.n - 1)], -1)
            by = np.lexsort((behind, rank[crowded]))
            at, new = crowded[by], rank.copy()
            same_class = np.append(False, rank[at[1:]] == rank[at[:-1]])
            same = same_class & np.append(False, behind[by][1:] == behind[by][:-1])
            # a class keeps the number of suffixes before it, so classes of one need no more sorting
            slots = np.arange(len(at))
            first_of_class = np.maximum.accumulate(np.where(same_class, 0, slots))
            first_of_new = np.maximum.accumulate(np.where(same, 0, slots))
            new[at] = rank[at] + first_of_new - first_of_class
            alone = ~same & ~np.append(same[1:], False)
            rank, crowded, size = new, np.sort(at[~alone]), size * 2
        self.rank = rank
        self.suffix = np.empty(self.n, dtype=np.int64)
        self.suffix[rank] = np.arange(self.n)
        self.shared = np.zeros(self.n + 1, dtype=np.int64)  # of the suffixes at i - 1 and i
        self.shared[1 : self.n] = self.forward(self.suffix[:-1], self.suffix[1:])

    @staticmethod
    def classes(order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.append(True, values[1:] != values[:-1])
        slots = np.arange(len(order))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        return rank, np.sort(order[~alone])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from two different places of a document on."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        x, y, got = a[live], b[live], np.zeros(len(live), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            own = self.levels[level]
            step = (own[x] == own[y]) << level
            x, y, got = x + step, y + step, got + step
        out[live] = got
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree up to and with two different places of a document, going back."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero((a >= 0) & (b >= 0) & (self.levels[0][a] == self.levels[0][b]))
        x, y, got = a[live] + 1, b[live] + 1, np.zeros(len(live), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            own, size = self.levels[level], 1 << level
            inside = (x >= size) & (y >= size)
            step = (inside & (own[np.maximum(x - size, 0)] == own[np.maximum(y - size, 0)])) << level
            x, y, got = x - step, y - step, got + step
        out[live] = got
        return out

    def nearest_smaller(self, table: list[np.ndarray], up: bool) -> np.ndarray:
        """For each slot the nearest one before (or after) it whose value is smaller, or -1; table[k] holds minima of 2^k slots from a slot on."""
        values, n = table[0], self.n
        at = np.arange(n)  # all slots between at and the own one are not smaller
        for k in range(len(table) - 1, -1, -1):
            size = 1 << k
            first = at + 1 if up else at - size
            inside = (first >= 0) & (first + size <= n)
            clear = inside & (table[k][np.clip(first, 0, len(table[k]) - 1)] > values)
            at = np.where(clear, at + size if up else at - size, at)
        found = at + 1 if up else at - 1
        return np.where((found >= 0) & (found < n), found, -1)

    @staticmethod
    def minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
        table, size = [values], 1
        while 2 * size <= min(longest, len(values)):
            last = table[-1]
            table.append(np.minimum(last[:-size], last[size:]))
            size *= 2
        return table

    def earlier_match(self) -> np.ndarray:
        """The longest match of each place with an earlier one of its document (they may overlap)."""
        longest = int(np.diff(np.unique(np.append(self.ends, 0))).max())
        table, best = self.minima(self.suffix, longest), np.zeros(self.n, dtype=np.int64)
        for up in (False, True):
            near = self.nearest_smaller(table, up)
            slot = np.flatnonzero(near >= 0)
            # documents are stretches of slots in their own order, so what is smaller may lie in the one before: it agrees in nothing
            best[self.suffix[slot]] = np.maximum(best[self.suffix[slot]], self.forward(self.suffix[slot], self.suffix[near[slot]]))
        return best

    def interval(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last slot of the suffixes that begin with the `length` words at `place`."""
        if not hasattr(self, "shared_table"):
            self.shared_table = self.minima(self.shared, self.n + 1)
        low, high = self.rank[place].copy(), self.rank[place].copy()
        for k in range(len(self.shared_table) - 1, -1, -1):
            size, own = 1 << k, self.shared_table[k]
            down = (low - size >= 0) & (own[np.clip(low - size + 1, 0, len(own) - 1)] >= length)
            low = np.where(down, low - size, low)
            up = (high + size < self.n) & (own[np.clip(high + 1, 0, len(own) - 1)] >= length)
            high = np.where(up, high + size, high)
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The first slot within low..high whose suffix has `code` at `depth`, or -1: the way down by one word (suffixes there are in its order)."""
        a, z = low.copy(), high + 1
        while (open_ := a < z).any():
            middle = (a + z) // 2
            place = self.suffix[np.minimum(middle, self.n - 1)] + depth
            less = np.where(place < self.n, self.codes[np.minimum(place, self.n - 1)], -1) < code  # the batch's end sorts first
            a, z = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, z)
        place = self.suffix[np.minimum(a, self.n - 1)] + depth
        hit = (a <= high) & (place < self.n)
        return np.where(hit & (self.codes[np.minimum(place, self.n - 1)] == code), a, -1)


def lz_blocks(match: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first places of all blocks: a block is the longest earlier match, or a new word."""
    step, out, at = np.maximum(match, 1).tolist(), [], 0
    while at < n:
        out.append(at)
        at += step[at]
    return np.array(out, dtype=np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, number from 1 within it) of each member of groups of such sizes."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering_squares(forest: Forest, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, half length) of squares that cover the leftmost occurrence of every square."""
    n, codes = forest.n, forest.codes
    after = np.append(blocks[1:], n)
    size = after - blocks
    same_doc = np.append(forest.ends[blocks[:-1]] == forest.ends[blocks[1:]], False)
    following = np.where(same_doc, np.append(size[1:], 0), 0)
    found = []
    # the next block's first word is in the right half
    b, k = spread(np.where(same_doc, size, 0))
    border, q = after[b], after[b] - k
    keep = codes[np.minimum(border, n - 1)] == codes[q]
    k, border, q = k[keep], border[keep], q[keep]
    ahead, back = forest.forward(border, q), forest.backward(border - 1, q - 1)
    start, fits = np.maximum(q - back, q - k + 1), ahead + back >= k
    found.append((start[fits], k[fits]))
    # the block's first word is in the left half, and the square starts before it
    begins = np.append(True, ~same_doc[:-1])
    b, k = spread(np.where(begins, 0, size + following))
    border, q = blocks[b], blocks[b] + k
    keep = q < forest.ends[border]
    b, k, border, q = b[keep], k[keep], border[keep], q[keep]
    keep = (codes[border] == codes[q]) & (codes[border - 1] == codes[q - 1])
    k, border, q = k[keep], border[keep], q[keep]
    ahead, back = forest.forward(border, q), forest.backward(border - 1, q - 1)
    start, fits = np.maximum(border - back, border - k + 1), ahead + back >= k
    found.append((start[fits], k[fits]))
    place, half = (np.concatenate(x) for x in zip(*found))
    return place, half


def primitive(forest: Forest, place: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether a square's half is no repetition of something shorter: no prime part of it is a period of the square."""
    out, rest, prime = np.ones(len(place), dtype=bool), half.copy(), 2
    while (rest > 1).any():
        if prime * prime > rest.max():  # what is left is prime or 1
            shares = np.where(rest > 1, half // np.maximum(rest, 1), 0)
            rest = np.ones_like(rest)
        else:
            divides = (rest % prime == 0) & (rest > 1)
            alone = (rest > 1) & (prime * prime > rest)
            shares = np.where(divides, half // prime, np.where(alone, half // np.maximum(rest, 1), 0))
            while (divides := (rest % prime == 0) & (rest > 1)).any():
                rest = np.where(divides, rest // prime, rest)
            rest = np.where(alone, 1, rest)
            prime += 1
        ask = np.flatnonzero((shares > 0) & out)
        out[ask[forest.forward(place[ask], place[ask] + shares[ask]) >= 2 * half[ask] - shares[ask]]] = False
    return out


def vocabulary(forest: Forest, place: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first slot, last slot, half length) of every square's node, by walks along suffix links from the covering squares."""
    n, seen, found = forest.n, np.empty(0, dtype=np.int64), []
    while len(place):
        # the links that stay within the run at hand lead to its next places: these steps are taken at once
        group, number = spread(np.minimum(forest.forward(place, place + half) - half + 1, half))
        place, half = place[group] + number - 1, half[group]
        low, high = forest.interval(place, 2 * half)
        key, first = np.unique(half * (n + 1) + low, return_index=True)
        first = first[~np.isin(key, seen, assume_unique=True)]
        low, high, half = low[first], high[first], half[first]
        found.append((low, high, half))
        seen = np.union1d(seen, half * (n + 1) + low)
        head = forest.suffix[low]
        a, z = forest.interval(head + 1, 2 * half - 1)
        slot = forest.child(a, z, 2 * half - 1, forest.codes[head])
        known = np.isin(half * (n + 1) + slot, seen)
        place, half = forest.suffix[slot[(slot >= 0) & ~known]], half[(slot >= 0) & ~known]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3


def runs_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods and more, by start and period. Codes of different documents differ and grow with the document."""
    none = np.empty(0, dtype=np.int64)
    if len(codes) < 2:
        return none, none, none
    forest = Forest(codes, starts)
    place, half = covering_squares(forest, lz_blocks(forest.earlier_match(), starts, len(codes)))
    if not len(place):
        return none, none, none
    own = primitive(forest, place, half)
    low, high, half = vocabulary(forest, place[own], half[own])
    group, number = spread(high - low + 1)
    place, half = forest.suffix[low[group] + number - 1], half[group]
    by = np.lexsort((place, half))
    place, half = place[by], half[by]
    new = np.append(True, (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)
    start, period = place[first], half[first]
    length = place[last] - start + 2 * period
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document that is one of the tenth whose rest is made periodic, else the words themselves."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])
DIGESTS_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def batch_runs(docs: list[list[bytes]], least_length: int, least_exponent: int) -> Iterator[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's long runs, all documents together."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    codes, _ = pd.factorize(np.array([w for d in docs for w in d], dtype=object)) if sizes.sum() else (np.empty(0, dtype=np.int64), None)
    doc = np.repeat(np.arange(len(docs)), sizes)
    _, codes = np.unique(doc * (codes.max(initial=0) + 1) + codes, return_inverse=True)
    start, length, period = runs_of(codes.astype(np.int64), starts[sizes > 0])
    long = (length >= least_length) & (length >= least_exponent * period)
    start, length, period = start[long], length[long], period[long]
    at = np.searchsorted(start, np.append(starts, sizes.sum()))
    for i, first in enumerate(starts.tolist()):
        own = slice(at[i], at[i + 1])
        yield list(zip((start[own] - first).tolist(), length[own].tolist(), period[own].tolist()))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(change).tolist()) if not covered]


def in_batches(batches: Iterator[pa.RecordBatch], plant: bool, batch_words: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(doc_ids, words) of stretches of rows with about so many words."""
    ids, docs, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = text.as_py().encode().split() if text.is_valid else []  # bytes split at the six ASCII blanks only
            ids.append(doc_id)
            docs.append(planted(words, doc_id) if plant else words)
            held += len(words)
            if held >= batch_words or len(docs) >= 4096:
                yield ids, docs
                ids, docs, held = [], [], 0
    if docs:
        yield ids, docs


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(batches, False, batch_words):
            found = list(batch_runs(texts, least_length, least_exponent))
            yield batch_of(
                schema, doc_id=ids, n_words=[len(w) for w in texts], runs=[[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found],
                collapsed=[b" ".join(collapsed(w, runs)).decode() for w, runs in zip(texts, found)],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS_DDL)


def run_digests(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and hashes of all runs and of the collapsed text; planted() applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(batches, True, batch_words):
            out: dict[str, list] = {f.name: [] for f in DIGESTS}
            for doc_id, words, runs in zip(ids, texts, batch_runs(texts, least_length, least_exponent)):
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                row = (
                    doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
                )
                for name, value in zip(out, row):
                    out[name].append(value)
            yield batch_of(DIGESTS, **out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS_DDL)
