"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives each document's perplexity.

1. Texts are spelled in the corpus's own alphabet, whose symbols are its code points, packed, and dealt into blocks of about `block_bytes`.
   The n-grams' order grows with the corpus (layout).
2. Each block counts the n-grams of its trusted texts (labelled as good and not toxic) and names the n-grams that its texts hold, as
   sorted, packed bundles, one for each shard. There are FOLDS models: what a block counts goes to the models of the other folds, and its
   texts ask the model of its own fold, so no text meets its own counts.
3. A shard has all n-grams whose last few context symbols hash to it. There, every order above those few finds its n-gram counts, its
   contexts and its shorter n-grams, and so each asked n-gram's p = a + b * q, q being its probability by the orders below. These
   have shards of their own (levels), with fewer context symbols, whose counts come from the shards above.
4. Each block gets its bundles back as a and b, joins its levels, and scores its texts: perplexity by code point.
5. A text is rejected if its perplexity is above the `high` quantile or below the `low` one of its language's trusted texts (null is a
   language too). Languages without trusted text take the quantiles of all trusted texts; without any trusted text nothing is rejected.

Defined edges: null and empty texts have no code points, no perplexity (null) and are rejected where there is trusted text; so are texts
without a letter or digit. Repeated rows get equal results. Rows without doc_id are scored but never trusted. Extra columns are ignored. An
empty table gives an empty result. a and b are rounded to 1/2048 of their logarithm on their way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, forget, materialize, texts_in_blocks

#: Bytes of text to a block and to a shard, n-grams that one task answers at most, and symbols that a task works on at once.
BLOCK_BYTES, SHARD_BYTES, ASKED, STRETCH = 1 << 25, 1 << 25, 1 << 23, 1 << 20
#: Quantiles of the trusted texts' held-out perplexities; EDGE is for rounding only.
LOW, HIGH, EDGE = 0.01, 0.99, 1e-9
CODE_POINTS, CODE_BITS, WIDEST, FOLDS, SALTS = 0x110000, 62, 15, 2, 32
#: Where the alphabet is wider than WIDEST bits, this many of its most frequent code points are one symbol, all others are two.
SINGLE = 24576
#: Whether a code point is a letter or digit; all beyond ASCII count as such.
SPOKEN = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])

PACKED = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("n_spoken", pa.int64()), ("packed", pa.binary())])
PACKED_DDL = "block int, doc_id long, text_key long, lang string, n_symbols long, n_spoken long, packed binary"
#: A bundle of n n-grams (or of answers to them) of one level, fold and shard; block says who asks.
BUNDLE = pa.schema([("level", pa.int32()), ("fold", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
BUNDLE_DDL = "level int, fold int, shard int, kind int, block int, n long, body binary"
ASK, COUNT, MODEL = 0, 1, 2
SCORES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("n_spoken", pa.int64()), ("nll", pa.float64())])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def alphabet(docs: DataFrame) -> np.ndarray:
    """The code points of all texts, the most frequent first: at most as many numbers as Unicode has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CODE_POINTS, dtype=np.int64)
        for batch in batches:
            for _, _, data, at in texts_in_blocks(batch):
                own = np.bincount(code_points(data[at[0] : at[-1]].tobytes().decode("utf-8", "surrogatepass")))
                n[: len(own)] += own
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["point", "n"])

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return np.array([r["point"] for r in counts.orderBy(F.col("n").desc(), "point").select("point").collect()], dtype=np.int64)


def layout(letters: int, chars: int) -> tuple[int, int]:
    """(bits, order): the width of symbols follows from the alphabet, the order grows with the text, as far as codes have room; at least 4."""
    bits = min(WIDEST, max(1, letters.bit_length()))
    return bits, min(CODE_BITS // bits, max(4, len(str(chars)) - 3))


def levels(order: int) -> list[tuple[int, int]]:
    """(highest, below) from the top: a level has the orders from highest down to below + 1, dealt out by their last `below` context symbols."""
    out = []
    while order:
        out.append((order, (order - 1) // 2))
        order = (order - 1) // 2
    return out


def spelled(points: np.ndarray, places: np.ndarray, letters: int) -> np.ndarray:
    """The symbols of code points: place in the alphabet from 1 on; in a wide alphabet, two symbols from SINGLE on. No two spellings are equal."""
    own = places[points]
    if letters >> WIDEST == 0:
        return own
    rare = own >= SINGLE
    high, low = SINGLE + ((own - SINGLE) >> 8), SINGLE + 6144 + ((own - SINGLE) & 255)
    out = np.repeat(np.where(rare, high, own), 1 + rare)
    out[(np.cumsum(1 + rare) - 1)[rare]] = low[rare]
    return out


def packed_texts(docs: DataFrame, blocks: int, letters: np.ndarray) -> DataFrame:
    """block, doc_id, text_key, lang, sizes, and the text's symbols, compressed, so that dealing them out costs little."""
    width = symbol_type(layout(len(letters), 0)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        places = np.zeros(CODE_POINTS, dtype=np.int64)
        places[letters] = np.arange(1, len(letters) + 1)
        for batch in batches:
            n, spoken, packed = [], [], []
            for text in batch.column("text").to_pylist():
                points = code_points(text)
                n.append(len(points))
                spoken.append(int(SPOKEN[np.minimum(points, 255)].sum()))
                packed.append(pack.compress(spelled(points, places, len(letters)).astype(width).tobytes()))
            yield batch_of(PACKED, n_symbols=n, n_spoken=spoken, packed=packed, **{c: batch.column(c) for c in ("block", "doc_id", "text_key", "lang")})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"), F.col("lang").cast("string").alias("lang"))
    block = block_of(F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(F.xxhash64("doc_id")), blocks)
    return rows.withColumn("block", block).mapInArrow(run, PACKED_DDL)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def symbol_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16


def last(k: int, bits: int) -> np.int64:
    """The bits of the last k symbols."""
    return np.int64((1 << (k * bits)) - 1)


def stretches(texts: pa.Table, bits: int, order: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first text, symbols of each text, codes): the n-grams that end at each symbol of some texts, about STRETCH symbols; edges (0) stand before a text."""
    unpack, edge = zstandard.ZstdDecompressor(), np.zeros(order - 1, dtype=symbol_type(bits))
    first, own, waiting = 0, [], 0

    def closed() -> np.ndarray:
        x = np.concatenate([y for s in own for y in (edge, s)]).astype(np.int64)
        out = np.zeros(len(x) - order + 1, dtype=np.int64)
        for k in range(order):
            out = (out << bits) | x[k : k + len(out)]
        return out[x[order - 1 :] != 0]

    for i, value in enumerate(texts.column("packed")):
        if waiting > STRETCH:
            yield first, [len(s) for s in own], closed()
            first, own, waiting = i, [], 0
        own.append(np.frombuffer(unpack.decompress(value.as_py()), dtype=symbol_type(bits)))
        waiting += len(own[-1])
    if own:
        yield first, [len(s) for s in own], closed()


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    if not len(code):
        return code, n
    by = np.argsort(code, kind="stable")
    code, n = code[by], n[by]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[head], np.add.reduceat(n, head)


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers from 0 on, their bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_numbers(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def packed_codes(code: np.ndarray) -> bytes:
    return packed_numbers(np.diff(code, prepend=0))


def unpacked_codes(body: bytes) -> np.ndarray:
    return np.cumsum(unpacked_numbers(body))


def packed_counts(code: np.ndarray, n: np.ndarray) -> bytes:
    """Codes and their counts in one body."""
    return packed_numbers(np.concatenate([np.diff(code, prepend=0), n]))


def unpacked_counts(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = unpacked_numbers(body)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def shard_of(code: np.ndarray, below: int, bits: int, shards: int) -> np.ndarray:
    """By the `below` symbols before the last one."""
    key = ((code >> np.int64(bits)) & last(below, bits)).astype(np.uint64) + np.uint64(1)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def dealt(code: np.ndarray, below: int, bits: int, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts codes of one shard together, and (shard, first, end) of each."""
    own = shard_of(code, below, bits, shards)
    by = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=1)).tolist()
    return by, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]


def named_codes(texts: pa.Table, bits: int, order: int) -> list[np.ndarray]:
    """For each level the distinct n-grams of its highest order that a block's texts hold."""
    found: list[np.ndarray] = []
    for _, _, code in stretches(texts, bits, order):
        found.append(distinct(code))
        if sum(map(len, found)) > 4 * STRETCH:
            found = [distinct(np.concatenate(found))]
    top = distinct(np.concatenate([np.empty(0, np.int64), *found]))
    return [top if high == order else distinct(top & last(high, bits)) for high, _ in levels(order)]


def block_grams(texts: pa.Table, trusted: pa.Table, bits: int, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The bundles that a block asks for, and the counts of its trusted texts for the other folds' models."""
    block = texts.column("block")[0].as_py() if texts.num_rows else 0
    out: dict[str, list] = {f.name: [] for f in BUNDLE}

    def add(*row) -> None:
        for name, value in zip(out, row):
            out[name].append(value)

    for level, ((_, below), code) in enumerate(zip(levels(order), named_codes(texts, bits, order))):
        by, parts = dealt(code, below, bits, shards)
        for shard, a, b in parts:
            add(level, block % FOLDS, shard, ASK, block, b - a, packed_codes(code[by[a:b]]))
    good, done = set(trusted.column("doc_id").to_pylist()), set()
    pick = []
    for i, row in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("text_key").to_pylist())):
        if row[0] is not None and row[0] in good and row not in done:
            done.add(row)
            pick.append(i)
    code, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for _, _, more in stretches(texts.select(["packed"]).take(pa.array(pick, type=pa.int64())), bits, order):
        own, times = np.unique(more, return_counts=True)
        code, n = summed(np.concatenate([code, own]), np.concatenate([n, times]))
    by, parts = dealt(code, levels(order)[0][1], bits, shards)
    for shard, a, b in parts:
        body = packed_counts(code[by[a:b]], n[by[a:b]])
        for fold in range(FOLDS):
            if fold != block % FOLDS:
                add(0, fold, shard, COUNT, block, b - a, body)
    yield batch_of(BUNDLE, **out)


def orders_of(code: np.ndarray, n: np.ndarray, bits: int, high: int, below: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, n-grams, counts) from the highest order down to below + 1: below the highest, a count is one of distinct left neighbours."""
    for k in range(high, below, -1):
        yield k, code, n
        if k > below + 1:
            code, n = np.unique(code & last(k - 1, bits), return_counts=True)


def merged(bundles: pa.Table, bits: int, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A shard's model from all blocks' counts, and its counts for the level below."""
    level, fold, shard = (bundles.column(c)[0].as_py() for c in ("level", "fold", "shard"))
    high, below = levels(order)[level]
    code, n, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []
    for body in bundles.column("body"):
        waiting.append(unpacked_counts(body.as_py()))
        if sum(len(c) for c, _ in waiting) > 4 * STRETCH:
            code, n = summed(*(np.concatenate([x, *y]) for x, y in zip((code, n), zip(*waiting))))
            waiting = []
    code, n = summed(*(np.concatenate([x, *y]) for x, y in zip((code, n), zip(*waiting)))) if waiting else (code, n)
    rows = [(level, fold, shard, MODEL, -1, len(code), packed_counts(code, n))]
    if below:
        *_, (_, shortest, _) = orders_of(code, n, bits, high, below)
        own, lefts = np.unique(shortest & last(below, bits), return_counts=True)
        by, parts = dealt(own, levels(order)[level + 1][1], bits, shards)
        rows += [(level + 1, fold, to, COUNT, shard, b - a, packed_counts(own[by[a:b]], lefts[by[a:b]])) for to, a, b in parts]
    yield batch_of(BUNDLE, **dict(zip(BUNDLE.names, zip(*rows))))


def models(grams: DataFrame, bits: int, order: int, shards: int) -> list[DataFrame]:
    """Each level's written bundles: its models, and the counts that the level below starts from."""
    out, counts = [], grams.where(F.col("kind") == COUNT)
    for level in range(len(levels(order))):
        made = counts.where(F.col("level") == level).groupBy("level", "fold", "shard").applyInArrow(lambda t: pa.Table.from_batches(list(merged(t, bits, order, shards)), BUNDLE), BUNDLE_DDL)
        out.append(materialize(made))
        counts = out[-1].where(F.col("kind") == COUNT)
    return out


def discounts(own: DataFrame, bits: int, order: int) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(fold, order): d1, d2, d3 of modified Kneser-Ney from the model's counts of counts, within bounds that keep probabilities positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for level, fold, body in zip(*(batch.column(c).to_pylist() for c in ("level", "fold", "body"))):
                for k, _, n in orders_of(*unpacked_counts(body), bits, *levels(order)[level]):
                    rows.append((fold, k, *np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(6)], ["fold", "k", "n1", "n2", "n3", "n4"])

    counts = own.where(F.col("kind") == MODEL).mapInArrow(run, "fold long, k long, n1 long, n2 long, n3 long, n4 long")
    found = counts.groupBy("fold", "k").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4))).collect()  # FOLDS * order rows
    return {(r["fold"], r["k"]): discount(r["n1"], r["n2"], r["n3"], r["n4"]) for r in found}


def discount(*n: int) -> tuple[float, float, float]:
    """What is cut from counts of 1, of 2, and of 3 or more, given how many n-grams have counts of 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else None
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(x, 0.1 * k), 0.95 * k) for k, x in enumerate(raw, 1))


class Shard:
    """One level's tables of one shard: what p(n-gram) = a + b * p(its last `below` symbols) needs."""

    def __init__(self, code: np.ndarray, n: np.ndarray, bits: int, high: int, below: int, cuts: dict[int, tuple[float, float, float]]):
        self.bits, self.orders = np.int64(bits), []
        for k, own, count in orders_of(code, n, bits, high, below):
            if len(own):
                cut = np.minimum(np.array(cuts[k])[np.minimum(count, 3) - 1], count)
                context = own >> self.bits
                head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                total = np.add.reduceat(count, head).astype(np.float64)
                self.orders.append((last(k, bits), own, count - cut, context[head], total, np.add.reduceat(cut, head)))

    def weights(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of each asked n-gram."""
        a, b = np.zeros(len(asked)), np.ones(len(asked))
        for mask, code, left, context, total, spread in self.orders:
            own = asked & mask
            at = np.minimum(np.searchsorted(context, own >> self.bits), len(context) - 1)
            seen = context[at] == own >> self.bits
            i = np.minimum(np.searchsorted(code, own), len(code) - 1)
            a += np.where(seen, b * np.where(code[i] == own, left[i], 0.0) / total[at], 0.0)
            b *= np.where(seen, spread[at] / total[at], 1.0)
        return a, b


def rounded_logs(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 as 16 bits of their logarithm; 0 is the largest."""
    return np.where(x > 0, np.minimum(np.round(-np.log(np.maximum(x, 1e-300)) * 2048), 65534), 65535).astype("<u2")


def from_logs(x: np.ndarray) -> np.ndarray:
    return np.where(x == 65535, 0.0, np.exp(x / -2048))


def answered(bundles: pa.Table, bits: int, order: int, cuts: dict[tuple[int, int], tuple[float, float, float]]) -> Iterator[pa.RecordBatch]:
    """block, level, shard, body: a and b of every n-gram that blocks ask a shard for."""
    level, fold, shard = (bundles.column(c)[0].as_py() for c in ("level", "fold", "shard"))
    model = bundles.filter(pc.equal(bundles.column("kind"), MODEL)).column("body").to_pylist()
    code, n = unpacked_counts(model[0]) if model else (np.empty(0, np.int64), np.empty(0, np.int64))
    own = Shard(code, n, bits, *levels(order)[level], {k: c for (f, k), c in cuts.items() if f == fold})
    asks = bundles.filter(pc.equal(bundles.column("kind"), ASK))
    for block, body in zip(asks.column("block").to_pylist(), asks.column("body")):
        both = np.concatenate([rounded_logs(x) for x in own.weights(unpacked_codes(body.as_py()))])
        body = zstandard.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 2).T).tobytes(), 1)
        yield batch_of(ANSWER, block=[block], level=[level], shard=[shard], body=[body])


ANSWER = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])
ANSWER_DDL = "block int, level int, shard int, body binary"


def answers(grams: DataFrame, made: list[DataFrame], bits: int, order: int, cuts: dict) -> DataFrame:
    """Every ask meets its shard's model. Shards that more than ASKED n-grams are asked of are split by block, each part with the model."""
    where = ["level", "fold", "shard"]
    asks = grams.where(F.col("kind") == ASK)
    parts = materialize(asks.groupBy(*where).agg(F.ceil(F.sum("n") / ASKED).cast("int").alias("parts")))
    model = made[0].where(F.col("kind") == MODEL)
    for more in made[1:]:
        model = model.unionByName(more.where(F.col("kind") == MODEL))
    both = asks.join(parts, where).withColumn("part", F.pmod("block", "parts")).drop("parts")
    both = both.unionByName(model.join(parts, where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    return both.groupBy(*where, "part").applyInArrow(lambda t: pa.Table.from_batches(list(answered(t, bits, order, cuts)), ANSWER), ANSWER_DDL)


def block_scores(texts: pa.Table, known: pa.Table, bits: int, order: int, shards: int) -> pa.Table:
    """doc_id, text_key, lang, n_symbols, n_spoken, nll (sum of negative log probabilities) of a block's texts."""
    bodies = {(level, shard): body for level, shard, body in zip(*(known.column(c).to_pylist() for c in ("level", "shard", "body")))}
    named, p = named_codes(texts, bits, order), None
    for level, (high, below) in reversed(list(enumerate(levels(order)))):
        code = named[level]
        a, b = np.empty(len(code)), np.empty(len(code))
        by, parts = dealt(code, below, bits, shards)
        for shard, first, end in parts:
            flat = np.frombuffer(zstandard.decompress(bodies[level, shard]), dtype=np.uint8).reshape(2, -1)
            own = from_logs(np.ascontiguousarray(flat.T).view("<u2").ravel())
            a[by[first:end]], b[by[first:end]] = own[: end - first], own[end - first :]
        p = a + b * (1 / (1 << bits) if p is None else p[np.searchsorted(named[level + 1], code & last(below, bits))])
    cost, code, nll = -np.log(p), named[0], np.zeros(texts.num_rows)
    for first, sizes, own in stretches(texts, bits, order):
        total = np.concatenate([[0.0], np.cumsum(cost[np.searchsorted(code, own)])])
        ends = np.cumsum([0, *sizes])
        nll[first : first + len(sizes)] = np.diff(total[ends])
    own = {c: texts.column(c).combine_chunks() for c in ("doc_id", "text_key", "lang", "n_symbols", "n_spoken")}
    return pa.Table.from_batches([batch_of(SCORES, nll=nll, **own)])


def perplexities(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_key, lang, n_symbols, n_spoken, perplexity, trusted of each row of docs, as a written table."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(FOLDS, -(-chars // block_bytes)), max(1, -(-chars // shard_bytes))
    letters = alphabet(docs)
    bits, order = layout(len(letters), chars)
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 and toxic = 0")
    good = materialize(good.select(block_of(F.xxhash64("doc_id"), blocks).alias("block"), "doc_id"))
    texts, trusted = packed_texts(docs, blocks, letters).groupBy("block"), good.groupBy("block")
    grams = materialize(texts.cogroup(trusted).applyInArrow(lambda a, b: pa.Table.from_batches(list(block_grams(a, b, bits, order, shards)), BUNDLE), BUNDLE_DDL))
    made = models(grams, bits, order, shards)
    own = made[0]
    for more in made[1:]:
        own = own.unionByName(more)
    cuts = discounts(own, bits, order)
    known = materialize(answers(grams, made, bits, order, cuts))
    forget(grams, *made)
    scores = texts.cogroup(known.groupBy("block")).applyInArrow(lambda a, b: block_scores(a, b, bits, order, shards), "doc_id long, text_key long, lang string, n_symbols long, n_spoken long, nll double")
    scores = scores.withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.exp(F.col("nll") / F.col("n_symbols")))).drop("nll")
    out = materialize(scores.join(good.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    forget(known, good)
    return out


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, **how) -> DataFrame:
    """perplexities() with low_limit, high_limit and kept."""
    scores = perplexities(docs, labels, **how)
    logs = scores.where("trusted and perplexity is not null").select("lang", F.log("perplexity").alias("x"))

    def limits(rows: DataFrame) -> DataFrame:
        q = rows.agg(F.percentile_approx("x", F.array(F.lit(low), F.lit(high)), 10000).alias("q"))
        return q.withColumn("low_limit", F.exp(F.col("q")[0] - EDGE)).withColumn("high_limit", F.exp(F.col("q")[1] + EDGE)).drop("q")

    # a language may hold a third of all rows: its limits stand in SALTS rows, which its texts are dealt over
    own = limits(logs.groupBy("lang")).select(F.col("lang").alias("of"), F.struct("low_limit", "high_limit").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = limits(logs.groupBy(F.lit(1).alias("one"))).select(F.struct("low_limit", "high_limit").alias("every")).scalar()
    salted = scores.withColumn("dealt", F.pmod("text_key", F.lit(SALTS)).cast("int"))
    out = salted.join(own, (salted["dealt"] == own["salt"]) & salted["lang"].eqNullSafe(own["of"]), "left")
    out = out.withColumn("limit", F.coalesce("own", every)).select(*scores.columns, "limit.low_limit", "limit.high_limit")
    fits = F.coalesce(F.col("perplexity").between(F.col("low_limit"), F.col("high_limit")) & (F.col("n_spoken") > 0), F.lit(False))
    return out.withColumn("kept", F.col("high_limit").isNull() | fits)


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, low_limit, high_limit, trusted, kept of every row."""
    return judged(docs, labels, **how).select("doc_id", "lang", "n_symbols", "perplexity", "low_limit", "high_limit", "trusted", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, as they are."""
    gone = materialize(judged(docs, labels, **how).where("not kept").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("lang").alias("l")).distinct())
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & (key == gone["k"]) & docs["lang"].cast("string").eqNullSafe(gone["l"]), "left_anti")
