"""The quality classifier against a plain Kneser-Ney model, and what it keeps and rejects."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import quality

EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "Ünïcode — text"), (1004, "Ünïcode — text"), (None, "no id at all here"), (1005, "word " * 30000)]


def plain_model(grams, order, width):
    """p(symbol | context) of tuples by interpolated modified Kneser-Ney, from the counts of `order`-grams; lower orders count left neighbours."""
    counts = {order: Counter(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {k: quality.discount(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for k, c in counts.items()}
    total, spread = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1]] += n
            spread[g[:-1]] += min(cuts[k][min(n, 3) - 1], n)

    def p(g):
        if not g:
            return 1 / width
        below = p(g[1:])
        if g[:-1] not in total:
            return below
        n = counts[len(g)][g]
        own = n - min(cuts[len(g)][min(n, 3) - 1], n) if n else 0.0
        return (own + spread[g[:-1]] * below) / total[g[:-1]]

    return p


def near_corpus(n=220):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randint(20, 150))] for _ in range(40)]
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("size", [{}, {"block_bytes": 4000, "shard_bytes": 3000}])
def test_perplexity_against_a_plain_model(spark, size):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    scores = quality.perplexities(docs, labels, **size)
    got = {r["doc_id"]: r for r in scores.collect()}
    chars = sum(len((t or "").encode()) for _, t in rows)
    letters = Counter("".join(t or "" for _, t in rows))
    bits, order = quality.layout(len(letters), chars)
    assert order == 4 and len(quality.levels(order)) == 2
    blocks = max(2, -(-chars // size.get("block_bytes", quality.BLOCK_BYTES)))
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", (quality.block_of(F.xxhash64("doc_id"), blocks) % 2).alias("f")).collect()}
    gram = lambda t: [tuple(("\0" * (order - 1) + t)[i : i + order]) for i in range(len(t))]
    model = {f: plain_model([g for d, t in rows if d < 150 and d % 2 == 0 and fold[d] != f for g in gram(t)], order, 1 << bits) for f in (0, 1)}
    for d, t in rows:
        want = math.exp(-sum(math.log(model[fold[d]](g)) for g in gram(t)) / len(t)) if t else None
        assert got[d]["perplexity"] == want if want is None else abs(math.log(got[d]["perplexity"] / want)) < 2e-3, d


def test_kneser_ney_sums_to_one():
    """Over all continuations of a seen and of an unseen context, whatever the levels, probabilities sum to one."""
    rng, bits = np.random.default_rng(5), 4
    for order in (4, 6, 8):
        symbols = np.minimum(rng.geometric(0.3, 30_000), 15)
        code = np.zeros(len(symbols) - order + 1, dtype=np.int64)
        for k in range(order):
            code = (code << bits) | symbols[k : k + len(code)]
        code, n = np.unique(code, return_counts=True)
        tables = []
        for high, below in quality.levels(order):
            cuts = {k: quality.discount(*np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()) for k, _, c in quality.orders_of(code, n, bits, high, below)}
            tables.append((below, quality.Shard(code, n, bits, high, below, cuts)))
            *_, (_, shortest, _) = quality.orders_of(code, n, bits, high, below)
            code, n = np.unique(shortest & quality.last(below, bits), return_counts=True)
        for context in (tables[0][1].orders[0][3][7], np.int64(1 << (bits * (order - 1))) - 1):
            asked, p = (context << bits) | np.arange(1 << bits), 1 / (1 << bits)
            for below, own in reversed(tables):
                a, b = own.weights(asked)
                p = a + b * p
            assert p.min() > 0 and abs(p.sum() - 1) < 1e-9


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        code = np.unique(rng.integers(0, 1 << 60, n))
        count = rng.integers(1, 1 << 40, len(code))
        assert (quality.unpacked_codes(quality.packed_codes(code)) == code).all()
        a, b = quality.unpacked_counts(quality.packed_counts(code, count))
        assert (a == code).all() and (b == count).all()
    x = np.array([0.0, 1.0, 0.5, 1e-9])
    back = quality.from_logs(quality.rounded_logs(x))
    assert back[0] == 0 and np.abs(np.log(back[1:] / x[1:])).max() < 1 / 2048


def test_quality(spark):
    good = near_corpus()
    bad = [(2000 + i, "%%% $$$ ### @@@ !!! ^^^ &&& *** " * (i + 5)) for i in range(5)]
    table = spark.createDataFrame([(d, t, "en") for d, t in good + bad + EDGES], "doc_id long, text string, lang string").withColumn("p", F.lit(1))
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[::2]] + [(good[1][0], None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(table, labels).collect()}
    assert not any(got[d]["kept"] for d, _ in bad) and np.mean([got[d]["kept"] for d, _ in good]) > 0.97
    assert got[1000]["perplexity"] is None and not got[1001]["kept"]
    kept = quality.drop_rejected(table, labels)
    assert kept.columns == table.columns and 2000 not in {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert all(r["kept"] for r in quality.quality_scores(table, labels.limit(0)).collect())
    assert quality.quality_scores(table.limit(0), labels).count() == 0


def test_quality_tells_letters_of_every_script(spark):
    """Shuffled letters of a script without a-z are less likely than its words, though every letter is the same kind."""
    rng = random.Random(11)
    words = ["".join(rng.choice("бвгдклмнпрст") + rng.choice("аеиоу") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    good = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    odd = []
    for i in range(10):
        letters = list("".join(rng.choice(words) for _ in range(60)))
        rng.shuffle(letters)
        odd.append((1000 + i, " ".join("".join(letters[k : k + 5]) for k in range(0, len(letters), 5))))
    table = spark.createDataFrame([(d, t, "xx") for d, t in good + odd], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[::2]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(table, labels).collect()}
    assert min(got[d]["perplexity"] for d, _ in odd) > 2 * max(got[d]["perplexity"] for d, _ in good)
    assert not any(got[d]["kept"] for d, _ in odd)


def test_quality_spells_wide_alphabets_without_loss():
    """Any number of code points has spellings that differ, in symbols that fit, and an order of 4 at least."""
    for letters in (1, 100, 20_000, 32_767, 32_768, 0x110000 - 1):
        bits, order = quality.layout(letters, 10**9)
        places = np.arange(letters + 1)
        own = quality.spelled(np.arange(1, letters + 1), places, letters)
        assert order >= 4 and bits * order <= 62 and own.min() > 0 and own.max() < 1 << bits
        one = own < quality.SINGLE if len(own) > letters else np.ones(len(own), bool)
        pairs = own[~one].reshape(-1, 2)
        assert len(set(own[one])) + len(set(map(tuple, pairs))) == letters


def test_quality_limits_come_from_texts_without_their_own_counts(spark):
    """A trusted text that is unlike all others is as unlikely as the same text without a label."""
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(200)]
    odd = " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(50))
    table = spark.createDataFrame([*rows, (900, odd)], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    known = [(d, 1, 0) for d, _ in rows]
    runs = [{r["doc_id"]: r for r in quality.quality_scores(table, spark.createDataFrame(k, "doc_id long, quality int, toxic int")).collect()} for k in (known, [*known, (900, 1, 0)])]
    first, second = runs[0][900], runs[1][900]
    assert not first["trusted"] and second["trusted"] and abs(np.log(first["perplexity"] / second["perplexity"])) < 0.01
    assert not first["kept"] and np.mean([r["kept"] for r in runs[0].values()]) > 0.95
