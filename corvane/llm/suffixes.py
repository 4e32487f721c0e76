"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier in the corpus.

1. Every start of a `length`-byte string belongs to the least hash of its SEED-byte strings (its seed). Starts that follow each other
   under one and the same place of it are a piece; equal strings have equal seeds, so they meet wherever they stand.
2. Pieces meet in order of seed and bytes. Pieces of equal bytes are one piece (compared by two 64-bit hashes): its first place stands
   for it, all others are covered.
3. The distinct pieces of a seed go through the column-wise construction: each round inserts one symbol of every piece, from its
   end, into the Burrows-Wheeler transform of the collection and keeps the common prefixes of neighbours, an
   external file that a round reads and writes in blocks. Neighbours with common prefixes of `length` are one string. The files are
   scratch of one task attempt, like Spark's own spills: no other task reads them, and a task that is run again makes them anew.
4. Seeds with more than `cell` distinct pieces (a frequent line within ever new text) would gather in one task. Their pieces are taken apart
   into whole strings, which are put in order by hash over many tasks; all but the first of each are covered. The result is the same.

"Earlier" is a smaller doc_id, or the same document and a smaller start. Defined edges: a null text is empty; texts shorter than
`length` lose nothing; rows without doc_id lose nothing and cover nothing. A repeated row is one document. A doc_id that repeats
with other texts is several documents in the order of their texts' hashes. Extra columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_column, materialize, with_new_text

LENGTH, SEED, CELL, CHUNK, BLOCK = 100, 48, 50_000, 8192, 1 << 17
END = 255  # no UTF-8 text holds this byte
_rng = np.random.default_rng(20240301)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1

#: A place is a stretch of starts in one document: 25 bits of the text's hash, 31 of the first start, 7 of how many follow it.
PIECE = pa.schema([("seed", pa.int64()), ("piece", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
PIECE_DDL = "seed long, piece long, doc_id long, place long"
FOUND = pa.schema([("kind", pa.int32()), ("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64())])
FOUND_DDL = "kind int, seed long, doc_id long, place long, n long"
STRINGS = pa.schema([("kind", pa.int32()), *PIECE])
STRINGS_DDL = f"kind int, {PIECE_DDL}"
COVER = pa.schema([("doc_id", pa.int64()), ("place", pa.int64())])
COVERED, SHARED, CROWDED, OPEN, RUN = range(5)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 17)
            self.up, self.down = (np.full(n, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)


def pieces_of(text: np.ndarray, powers: Powers, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, piece hash, first start, number of starts) of each piece of one text (uint8)."""
    n, wide = len(text), length - SEED + 1
    if n < length:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    powers.reach(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[text] * powers.up[:n], out=total[1:])
    hashes = mix((total[SEED:] - total[:-SEED]) * powers.down[: n - SEED + 1])
    starts = n - length + 1
    rows = np.full(-(-len(hashes) // wide) * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[: len(hashes)] = hashes
    rows = rows.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts])
    # a start whose least string is its own first is the last of its piece: no two starts of a piece have equal strings
    cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hashes[: starts - 1] == least[:-1])]))
    size = np.diff(np.append(cut, starts))
    end = cut + size + length - 1
    piece = mix((total[end] - total[cut]) * powers.down[cut] + size.astype(np.uint64))
    return least[cut], piece, cut, size


def place_of(text_key: int | np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (text_key << 38) | (start << 7) | (size - 1)


def split_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 38, (place >> 7) & 0x7FFFFFFF, (place & 127) + 1


def short_key(text: str = "text"):
    return F.shiftrightunsigned(F.xxhash64(text), 39)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (25 bits) and text of the rows that have a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select("doc_id", text.alias("text")).select("doc_id", short_key().alias("text_key"), "text")


def seed_pieces(texts: DataFrame, length: int) -> DataFrame:
    """seed, piece, doc_id, place of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            parts: list[tuple] = []
            for doc, key, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                seed, piece, start, size = pieces_of(data[a:b], powers, length)
                parts.append((seed.view(np.int64), piece.view(np.int64), np.full(len(seed), doc, dtype=np.int64), place_of(key, start, size)))
            if parts:
                yield batch_of(PIECE, **dict(zip(PIECE.names, (np.concatenate(x) for x in zip(*parts)))))

    return texts.mapInArrow(run, PIECE_DDL)


class Rows:
    """The last row of a sorted stream, to tell which rows repeat the one before."""

    def __init__(self):
        self.last: tuple | None = None

    def firsts_and_copies(self, seed: np.ndarray, piece: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are the first of their (seed, piece), and which are another place of it; rows that repeat a place are neither."""
        before = [np.concatenate([[x[0] if self.last is None else y], x[:-1]]) for x, y in zip((seed, piece, doc, place), self.last or (0, 0, 0, 0))]
        same = (seed == before[0]) & (piece == before[1])
        again = same & (doc == before[2]) & (place == before[3])
        if self.last is None:
            same[0] = again[0] = False
        self.last = (seed[-1], piece[-1], doc[-1], place[-1])
        return ~same, same & ~again


def found_rows(kind: int, seed: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int = 0) -> pa.RecordBatch:
    return batch_of(FOUND, kind=np.full(len(seed), kind, np.int32), seed=seed, doc_id=doc, place=place, n=np.full(len(seed), n, np.int64))


def run_row(seed: int, n: int) -> pa.RecordBatch:
    return batch_of(FOUND, kind=[RUN], seed=[seed], doc_id=[None], place=[None], n=[n])


def meet(batches: Iterator[pa.RecordBatch], cell: int) -> Iterator[pa.RecordBatch]:
    """Over a partition's rows in order of seed, piece, doc_id, place: what an equal piece covers, and the distinct pieces of shared seeds.

    The partition's first and last seed may go on beyond its border: their distinct pieces stay open, with the number of them here in
    a summary row. Only the last row and the distinct pieces of the last seed wait, at most `cell` of them: more are known to be crowded.
    """
    rows, head, n_head, closed, crowded, n_out = Rows(), None, 0, False, None, 0
    wait = [np.empty(0, np.int64) for _ in range(3)]
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, piece, doc, place = (batch.column(n).to_numpy() for n in PIECE.names)
        first, copy = rows.firsts_and_copies(seed, piece, doc, place)
        yield found_rows(COVERED, seed[copy], doc[copy], place[copy])
        s, d, p = (np.concatenate([w, x[first]]) for w, x in zip(wait, (seed, doc, place)))
        head = int(seed[0]) if head is None else head
        if not closed:
            own = int(np.count_nonzero(s == head))
            n_head += own
            yield found_rows(OPEN, s[:own], d[:own], p[:own])
            s, d, p = s[own:], d[own:], p[own:]
            if len(s):
                closed = True
                yield run_row(head, n_head)
        wait = [s, d, p]
        if not len(s):
            continue
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(edge, len(s)))
        kind = np.where(count > cell, CROWDED, np.where(count > 1, SHARED, -1))
        kind[s[edge] == crowded] = CROWDED
        if kind[-1] != CROWDED:  # its seed may go on
            done, kind[-1] = edge[-1], -1
        else:
            n_out = int(count[-1]) + (n_out if s[-1] == crowded else 0)
            done, crowded = len(s), int(s[-1])
        kind = np.repeat(kind, count)
        wait = [s[done:], d[done:], p[done:]]
        for k in (SHARED, CROWDED):
            yield found_rows(k, s[kind == k], d[kind == k], p[kind == k])
    if closed:
        seed = int(wait[0][-1]) if len(wait[0]) else crowded
        yield run_row(seed, len(wait[0]) + (n_out if seed == crowded else 0))
        yield found_rows(OPEN, *wait)
    elif head is not None:
        yield run_row(head, n_head)


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition's strings in order of seed, piece (their hash), doc_id, place: all but the first of each.

    A string that goes on from the partition before has its first row here marked OPEN, and each partition's first and last string a RUN row.
    """
    rows, head, tail = Rows(), None, None
    mark = lambda kind, row: batch_of(STRINGS, kind=[kind], **{n: [x] for n, x in zip(PIECE.names, row)})
    for batch in batches:
        if batch.num_rows:
            seed, piece, doc, place = (batch.column(n).to_numpy() for n in PIECE.names)
            first, copy = rows.firsts_and_copies(seed, piece, doc, place)
            yield batch_of(STRINGS, kind=np.full(copy.sum(), COVERED, np.int32), seed=seed[copy], piece=piece[copy], doc_id=doc[copy], place=place[copy])
            if first.any():
                at = np.flatnonzero(first)
                row = lambda i: tuple(int(x[i]) for x in (seed, piece, doc, place))  # noqa: B023, E731
                if head is None:
                    head = row(at[0])
                    yield mark(OPEN, head)
                    yield mark(RUN, head)
                tail = row(at[-1])
    if tail is not None and tail != head:
        yield mark(RUN, tail)


class Construction:
    """Burrows-Wheeler transform and common prefixes of a collection, built column by column through an external file.

    Rows 0 to m-1 are the empty suffixes. Each round extends the suffix that every unfinished text got in the round before by the
    symbol that precedes it: its place follows from the symbols' counts before it, its common prefix with the
    row above is one more than the least common prefix since the symbol's last place. The same holds for the row below.
    A row of the file is a pair (symbol, common prefix). Each round reads it in blocks twice and writes the next one into a second
    file; in memory there are one block, a few numbers for each text, and 256 counters.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, folder: str, block: int = BLOCK):
        self.symbols, self.at, self.block, self.m = symbols, offsets, block, len(offsets) - 1
        self.file, self.spare = (open(os.path.join(folder, name), "w+b") for name in ("one", "two"))
        self.rows, self.depth = self.m, 0
        self.live, self.spot = np.arange(self.m), np.arange(self.m)
        first = self.preceding(self.live)
        self.counts = np.bincount(first, minlength=256)
        first.astype(np.uint16).tofile(self.file)

    def preceding(self, texts: np.ndarray) -> np.ndarray:
        """The symbol before the current suffix of each text, END if there is none."""
        where = self.at[texts + 1] - 1 - self.depth
        ended = where < self.at[texts]
        out = self.symbols[np.where(ended, 0, where)] if len(self.symbols) else np.zeros(len(texts), np.uint8)
        return np.where(ended, np.uint8(END), out)

    def build(self) -> None:
        while True:
            going = self.preceding(self.live) != END
            self.live, self.spot = self.live[going], self.spot[going]
            if not len(self.live):
                return
            self.insert(*self.targets())

    def targets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One pass over the file: the new rows' places and common prefixes, and the rows whose prefix changes, with it."""
        base = self.m + np.cumsum(self.counts) - self.counts
        least, known, lively = np.full(256, 255, np.uint8), np.zeros(256, bool), np.zeros(256, bool)
        places, prefixes, sources, changed, changes = [], [], [], [], []
        self.file.seek(0)
        for first in range(0, self.rows, self.block):
            pair = np.fromfile(self.file, np.uint16, min(self.block, self.rows - first))
            b, c = (pair & 255).astype(np.uint8), (pair >> 8).astype(np.uint8)
            active = np.zeros(len(b), dtype=bool)
            lo, hi = np.searchsorted(self.spot, (first, first + len(b)))
            active[self.spot[lo:hi] - first] = True
            size = np.bincount(b, minlength=256)
            order = np.argsort(b, kind="stable")[: len(b) - size[END]]
            size[END] = 0
            names = np.flatnonzero(size)
            tails = np.cumsum(size[names])
            heads = tails - size[names]
            begin, end = order[heads], order[tails - 1]
            act = active[order]
            # a row counts if it or the row with the same symbol before it is active
            wanted = act.copy()
            wanted[1:] |= act[:-1]
            wanted[heads] = act[heads] | lively[names]
            q = np.flatnonzero(wanted)
            at_head = np.zeros(len(order) + 1, dtype=bool)
            at_head[heads] = True
            value = np.zeros(len(q), dtype=np.uint8)
            inner = np.flatnonzero(~at_head[q])
            lower = order[q[inner] - 1] + 1
            by = np.argsort(-lower, kind="stable")  # so that the stretches between two queries cost nothing
            spans = np.empty(2 * len(by), dtype=np.int64)
            spans[::2], spans[1::2] = lower[by], order[q[inner[by]]] + 1
            if len(by):
                value[inner[by]] = np.minimum.reduceat(np.append(c, np.uint8(0)), spans)[::2] + np.uint8(1)
            # the first place of a symbol here follows its last one in earlier blocks
            ahead = self.least_up_to(c, begin)
            head_value = np.where(known[names], np.minimum(least[names], ahead) + np.uint8(1), 0).astype(np.uint8)
            value[np.flatnonzero(at_head[q])] = head_value[wanted[heads]]
            symbol = b[order[q]]
            row = base[symbol] + q
            shift = np.zeros(256, dtype=np.int64)
            shift[names] = heads
            row -= shift[symbol]
            mine = act[q]
            places.append(row[mine])
            prefixes.append(value[mine])
            sources.append(order[q[mine]] + first)
            changed.append(row[~mine])
            changes.append(value[~mine])
            # what the next blocks need
            least = np.minimum(least, c.min())
            least[names], known[names], lively[names] = self.least_after(c, end), True, act[tails - 1]
            base += size
        place = np.concatenate(places)
        by = np.argsort(place)
        self.live = self.live[np.searchsorted(self.spot, np.concatenate(sources))][by]
        rows, values = np.concatenate(changed), np.concatenate(changes)
        also = np.argsort(rows)
        return place[by], np.concatenate(prefixes)[by], rows[also], values[also]

    @staticmethod
    def least_up_to(c: np.ndarray, to: np.ndarray) -> np.ndarray:
        """min(c[: i + 1]) for each i."""
        if not len(to):
            return np.empty(0, dtype=np.uint8)
        by = np.argsort(to)
        return np.minimum.accumulate(np.minimum.reduceat(c[: to[by[-1]] + 1], np.concatenate([[0], to[by[:-1]] + 1])))[np.argsort(by)]

    @classmethod
    def least_after(cls, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """min(c[i + 1 :]) for each i, 255 where nothing follows."""
        return cls.least_up_to(np.append(c, np.uint8(255))[::-1], len(c) - at - 1)

    def insert(self, place: np.ndarray, prefix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """The second pass: old and new rows in order, into the other file."""
        self.depth += 1
        symbol = self.preceding(self.live)
        self.counts += np.bincount(symbol, minlength=256)
        pair, total = symbol.astype(np.uint16) | (prefix.astype(np.uint16) << 8), self.rows + len(place)
        self.file.seek(0)
        self.spare.seek(0)
        for first in range(0, total, self.block):
            n = min(self.block, total - first)
            a, z = np.searchsorted(place, (first, first + n))
            here = place[a:z] - first
            old, out = np.ones(n, dtype=bool), np.empty(n, dtype=np.uint16)
            old[here] = False
            out[old], out[here] = np.fromfile(self.file, np.uint16, n - len(here)), pair[a:z]
            a, z = np.searchsorted(rows, (first, first + n))
            here = rows[a:z] - first
            out[here] = (out[here] & 255) | (values[a:z].astype(np.uint16) << 8)
            out.tofile(self.spare)
        self.spare.flush()
        self.file, self.spare, self.rows, self.spot = self.spare, self.file, total, place

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The transform and the common prefixes."""
        self.file.seek(0)
        pair = np.fromfile(self.file, np.uint16, self.rows)
        self.file.close(), self.spare.close()
        return (pair & 255).astype(np.uint8), (pair >> 8).astype(np.uint8)


def suffixes(transform: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, rows) of all suffixes, by walking the transform from the m empty suffixes on."""
    order = np.argsort(transform, kind="stable")[: len(transform) - np.count_nonzero(transform == END)]
    ahead = np.full(len(transform), -1, dtype=np.int64)
    ahead[order] = m + np.arange(len(order))
    text, row, n = np.arange(m), np.arange(m), 0
    while len(text):
        yield n, text, row
        row, n = ahead[row], n + 1
        text, row = text[row >= 0], row[row >= 0]


def repeated_starts(pieces: list[bytes], order: np.ndarray, length: int = LENGTH, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of each `length`-byte string that also starts earlier; `order` ranks the pieces' first starts by (doc, start).

    order is an (n, 2) array of doc ranks and starts. All strings of `length` must be shorter than 255 bytes with their piece.
    """
    symbols = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    with tempfile.TemporaryDirectory(dir=folder) as own:
        made = Construction(symbols, np.concatenate([[0], np.cumsum(sizes)]), own)
        made.build()
        transform, lcp = made.result()
        link = lcp >= length
        inside = link | np.append(link[1:], False)
        group = np.cumsum(~link)
        found = [(t[k], sizes[t[k]] - n, group[r[k]]) for n, t, r in suffixes(transform, len(pieces)) if n >= length for k in [inside[r]] if k.any()]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    piece, start, group = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((order[piece, 1] + start, order[piece, 0], group))
    piece, start, group = piece[by], start[by], group[by]
    where = np.stack([group, order[piece, 0], order[piece, 1] + start])
    first = np.concatenate([[True], group[1:] != group[:-1]])
    # another row of the first place itself is no copy of it
    lead = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    copy = (where != where[:, lead]).any(axis=0)
    return piece[copy], start[copy]


def starts_to_places(piece: np.ndarray, start: np.ndarray, key: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of the runs of consecutive starts."""
    by = np.lexsort((start, piece))
    piece, start = piece[by], start[by]
    head = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)])) if len(piece) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(piece)))
    return piece[head], place_of(key[piece[head]], begin[piece[head]] + start[head], size)


def construct(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by seed: the places that another piece covers. Whole seeds are gathered up to about `chunk` pieces."""
    rows: list[tuple] = []

    def close(part: list[tuple]) -> pa.RecordBatch:
        doc, place = (np.array([r[i] for r in part], dtype=np.int64) for i in (1, 2))
        key, begin, _ = split_place(place)
        # documents in order: by doc_id, then by the text's key
        rank = np.unique(np.stack([doc, key], axis=1), axis=0, return_inverse=True)[1].ravel()
        piece, start = repeated_starts([r[3] for r in part], np.stack([rank, begin], axis=1), length)
        piece, covered = starts_to_places(piece, start, key, begin)
        return batch_of(COVER, doc_id=doc[piece], place=covered)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "doc_id", "place", "bytes"))):
            if len(rows) >= chunk and row[0] != rows[-1][0]:
                yield close(rows)
                rows = []
            rows.append(row)
    if rows:
        yield close(rows)


def cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """seed, doc_id, place, bytes of the wanted pieces of each text."""
    schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
            raw = text.encode()
            for item in wanted:
                _, start, size = split_place(item["place"])
                out["seed"].append(item["seed"]), out["doc_id"].append(doc), out["place"].append(item["place"]), out["bytes"].append(raw[start : start + size + length - 1])
        yield batch_of(schema, **out)


def strings_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """seed, piece, doc_id, place of every string of the wanted pieces; seed and piece are the string's 128-bit hash."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PIECE}
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
            raw = text.encode()
            for item in wanted:
                key, start, size = split_place(item["place"])
                for i in range(start, start + size):
                    own = xxhash.xxh3_128_digest(raw[i : i + length])
                    for name, value in zip(out, (int.from_bytes(own[:8], "big", signed=True), int.from_bytes(own[8:], "big", signed=True), doc, place_of(key, i, 1))):
                        out[name].append(value)
        yield batch_of(PIECE, **out)


def covered_places(docs: DataFrame, length: int = LENGTH, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key, places array<long>: the starts of each document whose string also starts earlier.

    Ranges are cut by seed, piece, doc_id and place, so a passage that a third of all documents hold spreads over many tasks; what goes on beyond
    a range's border meets in a summary of two rows a range, small enough to be broadcast.
    """
    texts, order = texts_of(docs), ["seed", "piece", "doc_id", "place"]
    keyed = seed_pieces(texts, length).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(keyed.mapInArrow(lambda it: meet(it, cell), FOUND_DDL))
    kind = F.col("kind")
    copies = found.where(kind == COVERED).select("doc_id", "place")
    border = found.where(kind == RUN).groupBy("seed").agg(F.sum("n").alias("in_all"))
    late = found.where(kind == OPEN).join(F.broadcast(border), "seed")
    late = late.select(F.when(F.col("in_all") > cell, CROWDED).when(F.col("in_all") > 1, SHARED).otherwise(OPEN).alias("kind"), "seed", "doc_id", "place")
    both = found.where(kind.isin(SHARED, CROWDED)).select("kind", "seed", "doc_id", "place").unionByName(late)

    def wanted(which: int) -> DataFrame:
        own = both.where(kind == which).withColumn("text_key", F.shiftright("place", 38))
        own = own.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("seed", "place")).alias("wanted"))
        return texts.join(own, ["doc_id", "text_key"]).select("doc_id", "text", "wanted")

    ddl = "seed long, doc_id long, place long, bytes binary"
    shared = wanted(SHARED).mapInArrow(lambda it: cut_out(it, length), ddl).repartition("seed").sortWithinPartitions("seed", "doc_id", "place")
    every = copies.unionByName(shared.mapInArrow(lambda it: construct(it, length, chunk), "doc_id long, place long"))
    if not both.where(kind == CROWDED).isEmpty():
        strings = wanted(CROWDED).mapInArrow(lambda it: strings_of(it, length), PIECE_DDL).repartitionByRange(*order).sortWithinPartitions(*order)
        told = materialize(strings.mapInArrow(repeats, STRINGS_DDL))
        first = told.where(kind == RUN).groupBy("seed", "piece").agg(F.min(F.struct("doc_id", "place")).alias("first"))
        late = told.where(kind == OPEN).join(F.broadcast(first), ["seed", "piece"]).where("struct(doc_id, place) <> first")
        every = every.unionByName(told.where(kind == COVERED).select("doc_id", "place")).unionByName(late.select("doc_id", "place"))
    return every.withColumn("text_key", F.shiftright("place", 38)).groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"))


def removed_mask(n_bytes: int, places: list[int] | None, length: int) -> np.ndarray:
    """Which bytes of a text go."""
    edge = np.zeros(n_bytes + 1, dtype=np.int64)
    if places:
        _, start, size = split_place(np.array(places, dtype=np.int64))
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def joined_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text (as it is), the whole row as a struct and its places (null: none)."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k"), "text", F.struct(*docs.columns).alias("row"))
    keyed = keyed.select("doc_id", F.shiftrightunsigned("k", 39).alias("text_key"), "text", "row")
    return keyed.join(places, ["doc_id", "text_key"], "left")


def suffix_digests(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                raw = (text or "").encode()
                gone = removed_mask(len(raw), places, length)
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                for name, value in zip(out, (doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
            yield batch_of(schema, **out)

    # the same side of the same join as in covered_places: Spark deals the texts out once
    both = texts_of(docs).join(covered_places(docs, length, **how), ["doc_id", "text_key"], "left").select("doc_id", "text", "places")
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("places"))
    return both.unionByName(rest).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_bytes(text: str, places: list[int], length: int = LENGTH) -> str:
    """The text without the characters all of whose bytes go."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    gone = removed_mask(len(raw), places, length)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, heads) if len(heads) else gone
    return raw[~np.repeat(whole, np.diff(np.append(heads, len(raw))))].tobytes().decode()


def drop_repeated_passages(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """docs with each text cut down to its first occurrences; characters are kept whole; other columns stay, n_chars follows."""

    @F.pandas_udf("string")
    def cut(text, places):
        return text.combine(places, lambda t, p: t if t is None or p is None else without_bytes(t, [int(x) for x in p], length))

    out = joined_places(docs, covered_places(docs, length, **how))
    out = out.withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(cut("text", "places")))
    return with_new_text(out, docs.columns)
