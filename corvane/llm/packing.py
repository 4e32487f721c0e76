"""Best-fit packing: a configuration linear program over the length histogram, multiplicative weights, knapsack pricing, rounding.

Each document is its token ids and a closing id 0. Only documents longer than `capacity` are cut, the first piece takes the
remainder. The program sees the histogram of piece lengths (at most `capacity` rows, whatever the input). Its fractional solution grows by
rounds: lengths that lag behind weigh more, a knapsack by dynamic programming prices all capacities at these weights, and
configurations within `slack` of the best price are taken in fractional amounts, each filled to the last token where a longer piece allows it.
Any round's prices also bound what any packing needs. The solution is then rounded to whole amounts. Configurations keep theirs from the
fullest on, as many as leave the fewest sequences once best fit decreasing has packed what is left over (among equals, the most).
Slots of a length are ranges of ranks, so pieces find their place by a distributed rank.

Defined edges: a null or empty text is one piece of one token. Repeated rows are packed like any others. An empty table gives an empty
result. Extra columns are ignored. A text is tokenized whole; its memory is what one task needs at least. A special token's string in a
text becomes the special token's id, as the tokenizer has it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialize

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters that every Unicode version in use here classes alike as letters, digits, spaces or others.
SETTLED = re.compile(r"[\x00-\x7f\xa0-\u0377\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20ac\u3000-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


class TextTokenizer:
    """Token ids of whole texts, as little-endian uint32 bytes: what the tokenizer's encode(text, add_special_tokens=False) gives.

    Merging runs in tiktoken's core over the tokenizer's own vocabulary, at about a third of the CPU time. The two differ only in the Unicode
    version that splits words and in special tokens: texts with a character outside SETTLED or a special token's string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if (text.isascii() or SETTLED.fullmatch(text)) and not any(s in text for s in self.special):
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be short."""
    head = total % capacity
    return ([head] if head else []) + [capacity] * (total // capacity)


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextTokenizer(path)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids, start = coder.encode(text.as_py()) + b"\0\0\0\0", 0
                for n, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for name, value in zip(out, (doc, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        out[name].append(value)
                    start += length
            yield batch_of(PIECES, **out)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES_DDL)


Config = tuple[tuple[int, int], ...]


def price(value: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity, the largest value of a multiset of lengths that fits, by dynamic programming."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (best[c - 1 :: -1][:c] + value[1 : c + 1]).max())
    return best


def configuration(value: np.ndarray, best: np.ndarray, free: np.ndarray, capacity: int, least: float) -> dict[int, int] | None:
    """A multiset of lengths, each at most free[length] times, followed through the prices; None if it is worth less than `least`."""
    room, own, worth = capacity, {}, 0.0
    while room > 0:
        gains = np.where(free[1 : room + 1] > own_counts(own, room), value[1 : room + 1] + best[room - 1 :: -1][:room], -1.0)
        length = int(gains.argmax()) + 1
        if gains[length - 1] < 0 or worth + gains[length - 1] < least:
            break
        own[length] = own.get(length, 0) + 1
        worth, room = worth + value[length], room - length
    return filled(own, value, free, room) if own and worth >= least else None


def filled(own: dict[int, int], value: np.ndarray, free: np.ndarray, room: int) -> dict[int, int]:
    """A configuration with `room` tokens to spare, one of its pieces exchanged for the longest free one that still fits."""
    for gap in range(room, 0, -1):
        shorter = [i for i in own if free[i + gap] > own.get(i + gap, 0)]
        if shorter:
            i = max(shorter, key=lambda i: (value[i + gap] - value[i], i))
            out = own | {i: own[i] - 1, i + gap: own.get(i + gap, 0) + 1}
            return {k: n for k, n in out.items() if n}
    return own


def own_counts(own: dict[int, int], room: int) -> np.ndarray:
    out = np.zeros(room)
    for length, k in own.items():
        if length <= room:
            out[length - 1] = k
    return out


def fractional(demand: np.ndarray, capacity: int, slack: float = 0.02, eta: float = 2.0, tilt: float = 1.0, rounds: int = 500, each: int = 100) -> tuple[dict[Config, float], float]:
    """(amount of each configuration, lower bound): the covering program min sum(x) with every length's demand met.

    It ends once 1 % of the tokens are left. Weights are exp(eta * share still to cover); a round takes up to `each` configurations, none beyond half of what a length still needs. Any
    prices y give the bound sum(demand * y) / (best price of a configuration), as the program's dual.
    """
    share = np.arange(capacity + 1) / capacity
    start, left, total = np.maximum(demand, 1).astype(float), demand.astype(float), float(demand.sum())
    tokens = float((demand * share).sum())
    amounts: dict[Config, float] = {}
    bound = tokens
    for _ in range(rounds):
        if (left * share).sum() <= 0.01 * tokens:
            break
        value = np.where(left > 0, share * (1 + tilt * share) * np.exp(eta * (left / start - left.sum() / total)), 0.0)
        best = price(value, capacity)
        bound = max(bound, float((demand * value).sum() / best[capacity]))
        budget = left / 2
        for turn in range(each):
            free = np.where(budget > 0, np.maximum(1, np.floor(budget)), 0)
            own = configuration(value, best, free, capacity, (1 - slack) * best[capacity]) or (configuration(value, best, free, capacity, 0.0) if not turn else None)
            if not own:
                break
            amount = min(budget[i] / k for i, k in own.items())
            for i, k in own.items():
                left[i] -= amount * k
                budget[i] = budget[i] - amount * k if budget[i] - amount * k > 1e-9 * start[i] else 0.0
                left[i] = left[i] if left[i] > 1e-6 else 0.0
            key = tuple(sorted(own.items(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + amount
    return amounts, bound


def rounded(demand: np.ndarray, amounts: dict[Config, float]) -> list[tuple[Config, int]]:
    """Whole amounts of the configurations used most, none beyond the demand: rounded down, then the larger fractions up."""
    left, out = demand.copy(), []
    for up in (False, True):
        for config, amount in sorted(amounts.items(), key=lambda item: (-item[1], item[0])):
            want = int(amount % 1 >= 0.5) if up else int(amount)
            times = min(want, *(int(left[i]) // k for i, k in config))
            if times > 0:
                for i, k in config:
                    left[i] -= k * times
                out.append((config, times))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, cuts: int = 16) -> tuple[list[tuple[Config, int]], int, int]:
    """([(configuration as ((length, copies), ...), multiplicity)] that packs the histogram exactly, a bound that no packing is below, how many of its sequences the program gave)."""
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        demand[length] += n
    whole = int(demand[capacity])
    demand[capacity] = 0
    amounts, bound = fractional(demand, capacity) if demand.any() else ({}, 0.0)
    waste = lambda config: capacity - sum(i * k for i, k in config)
    groups = sorted(rounded(demand, amounts), key=lambda g: (waste(g[0]), sum(k for _, k in g[0]), g[0]))  # full ones first, small pieces left to what is packed last
    found, given, need = [], 0, None
    for part in range(cuts + 1):  # how far rounding goes: what packs into the fewest sequences
        kept, rest = groups[: len(groups) * part // cuts], demand.copy()
        for config, times in kept:
            for i, k in config:
                rest[i] -= k * times
        packed = kept + best_fit(rest, capacity)
        n = sum(times for _, times in packed)
        if need is None or n <= need:
            found, given, need = packed, sum(times for _, times in kept), n
    full = [(((capacity, 1),), whole)] if whole else []
    return full + found, whole + math.ceil(bound - 1e-6), given


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best fit decreasing on a histogram: equal bins are kept as one group with a count."""
    open_bins: dict[int, list[tuple[Config, int]]] = defaultdict(list)
    done = []
    for length in range(capacity, 0, -1):
        n = int(demand[length])
        for room in sorted(r for r in open_bins if r >= length):
            while n and open_bins[room]:
                config, bins = open_bins[room].pop()
                each = room // length
                full = min(bins, n // each)
                if full:
                    open_bins[room - each * length].append(((*config, (length, each)), full))
                    n -= full * each
                if bins > full and 0 < n < each:
                    open_bins[room - n * length].append(((*config, (length, n)), 1))
                    full, n = full + 1, 0
                if bins > full:
                    open_bins[room].append((config, bins - full))
            if not n:
                break
        each = capacity // length
        if n // each:
            open_bins[capacity - each * length].append((((length, each),), n // each))
        if n % each:
            open_bins[capacity - n % each * length].append((((length, n % each),), 1))
        done += [(c, k) for c, k in open_bins.pop(0, [])]
    return done + [x for own in open_bins.values() for x in own]


def slots(groups: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each configuration and length: which ranks of that length it takes, and where they stand."""
    used, base, rows = Counter(), 0, []
    for config, times in groups:
        offset = 0
        for length, copies in config:
            rows.append((length, used[length], copies, base, offset))
            used[length] += copies * times
            offset += length * copies
        base += times
    rows.sort()
    return dict(zip(("length", "first", "copies", "base", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    pieces = materialize(tokenized_pieces(docs, capacity, tokenizer))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = slots(solve(histogram, capacity)[0])
    # rank of a piece within its length: places in its file block, and the counts of the blocks before
    block = F.xxhash64("doc_id", "piece", "start", "ids_crc32").bitwiseAND(F.lit(1023))
    dealt = pieces.withColumn("block", block)
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside"))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    wide = np.int64(1) << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = places["length"] * wide + places["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length * wide + rank, side="right") - 1
            turn = rank - places["first"][at]
            copies = np.maximum(places["copies"][at], 1)
            out = {n: batch.column(n) for n in PIECES.names}
            yield batch_of(schema, **out, sequence_id=places["base"][at] + turn // copies, offset=places["offset"][at] + turn % copies * length)

    return ranked.select(*PIECES.names, "rank").mapInArrow(place, f"{PIECES_DDL}, sequence_id long, offset long")
