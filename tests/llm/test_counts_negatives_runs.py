"""Token counts, hard negatives and periodic runs against the library, SQL and plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import hard_negatives, periodic, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


# token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


AWKWARD = [
    None, "", " ", "a", "<s> and </s> and <unk>", "a\x00b", "▁▁ literal marks ▁", "é é ﬁ 漢字仮名 👩‍👩‍👧 \U0001f600" * 9, "​ \ttabs\r\nand lines\n\n\n" * 8,
    "ab" * 300, "a" * 2000, " " * 700, "\n" * 400, "\U0001f9ff" * 300, "the quick brown fox " * 60, "a" * 500 + " tail of other words " + "-" * 900,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (100, 3), (37, 1), (16384, 64)])
def test_token_counts_equal_the_library(spark, library, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows}


def test_token_query_over_its_table(spark, duck, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, SF).collect()}
    want = {}
    for doc_id, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        n = len(library.encode(text or ""))
        want[doc_id] = (len((text or "").encode()), n, n > 4096)
    assert got == want


def test_token_counts_edges(spark):
    schema = "doc_id long, text string, n_tokens string, uid string, chunk int"
    docs = spark.createDataFrame([(1, "x " * 300, "clash", "u", 1), (1, "x " * 300, "clash", "u", 1), (None, "y", None, None, None), (2, None, None, None, None)], schema)
    got = sorted((r["doc_id"] or 0, r["n_bytes"]) for r in token_counts.token_digests(docs, chunk=50, overlap=4).collect())
    assert got == [(0, 1), (1, 600), (1, 600), (2, 0)]
    empty = token_counts.token_digests(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_seams_need_a_shared_token():
    own = token_counts.counter(__import__("public_tokenizers").path(token_counts.MODEL))
    pack = lambda *rows: token_counts.packed(*(np.array(x, dtype=np.int64) for x in zip(*rows)))
    assert token_counts.seam(pack((0, 500), (3, 600), (5, 700)), pack((-1, 300), (0, 501), (3, 600), (5, 700)), own) == (1, 3)
    assert token_counts.seam(pack((0, 500), (4, 600)), pack((-1, 300), (1, 500), (3, 600)), own) is None
    byte = own.model.piece_to_id("<0xF0>")
    assert token_counts.seam(pack((0, byte)), pack((-1, 300), (0, byte)), own) is None, "bytes within a character are no border"


# hard negatives


def plain_negatives(rows, anchor, k=5, m=10):
    """rows: (vec_id, vector, label). The rule, pair by pair."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, va, la) in enumerate(kept):
        if anchor(a):
            scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for j, (i, v, lab) in enumerate(kept) if j != n]
            for p, pos, _ in sorted(s for s in scored if s[2] == la)[:k]:
                fit = sorted(s for s in scored if s[2] != la and 30 * -p <= 100 * -s[0] <= 90 * -p)[:m]
                out += [(a, pos, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_equal_sql(spark, duck):
    want = sorted(duck.sql(hard_negatives.ORACLE).fetchall())
    assert mined(queries.op12_hard_negatives(spark, SF)) == want and len(want) > 100


@pytest.mark.parametrize("blocks", [1, 3])
def test_hard_negatives_equal_the_rule(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = random.Random(blocks)
    rows = [(i, [rng.choice([rng.gauss(0.1, 0.4), 0.25]) for _ in range(70)], rng.randrange(3)) for i in range(150)]
    rows += [(200 + i, rows[10][1], i % 2) for i in range(40)]  # equal vectors: ties
    rows += [(300, None, 1), (301, [0.1] * 69 + [None], 1), (302, [float("nan")] * 70, 1), (303, [float("inf")] * 70, 1), (None, rows[0][1], 1), (304, rows[1][1], None), (305, [0.0] * 70, 1)]
    rows += [(306, [0.5, 1.5], 2), (307, [], 2)]  # shorter vectors
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    frame = spark.createDataFrame(rows, VECTORS)
    got = mined(hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, least_blocks=blocks))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edges(spark):
    empty = hard_negatives.embedding_digests(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and empty.count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "x", 2)], VECTORS + ", score string, anchor int")
    assert hard_negatives.embedding_digests(alone).count() == 0
    # a repeated anchor is its twin's positive, and each twin is answered
    twins = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [0.5, 0.0], 2), (4, [0.95, 0.0], 2)]
    assert mined(hard_negatives.hard_negatives(spark.createDataFrame(twins, VECTORS), F.col("vec_id") % 100 == 0)) == [(100, 100, 1, 3, 65536, 32768)] * 2
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.embedding_digests(spark.createDataFrame([(1, [1e30], 1)], VECTORS))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 130), st.sampled_from([3, 9, 20]))
def test_intervals_hold_the_product_and_end_at_it(seed, width, bits):
    rng = np.random.default_rng(seed)
    edge = 1 << (bits - 1)
    rows, anchor = rng.integers(-edge, edge, (20, width)), rng.integers(-edge, edge, width)
    exact, seen = rows @ anchor, []

    def watch(low, high):
        assert (low <= exact).all() and (exact <= high).all()
        seen.append(int((high - low).max()))
        return np.ones(len(low), dtype=bool)

    planes = hard_negatives.bit_planes(rows, bits)
    _, got = hard_negatives.products(planes, hard_negatives.bit_planes(anchor[None], bits)[0], int(np.maximum(anchor, 0).sum()), int(np.maximum(-anchor, 0).sum()), watch)
    assert (got == exact).all() and seen == sorted(seen, reverse=True) and seen[-1] == 0


# periodic runs


def plain_runs(w, least=0, exponent=2):
    """All runs by comparing every period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, s = j - i + q, w[i : j + q]
            if length >= max(least, exponent * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=40), st.integers(0, 12), st.integers(1, 6)), min_size=1, max_size=4))
def test_runs_equal_the_plain_rule(parts):
    docs = [[c.encode() for c in text[:cut] + text[cut:] * times] for text, cut, times in parts]
    assert list(periodic.batch_runs(docs, 0, 2)) == [plain_runs(d) for d in docs]


def test_runs_of_special_words():
    fib, tm = "a", "a"
    b = "ab"
    for _ in range(8):
        fib, b = b, b + fib
    for _ in range(7):
        tm += tm.translate(str.maketrans("ab", "ba"))
    docs = [[c.encode() for c in s] for s in (fib, tm, "a" * 300, "ab" * 150 + "a", "abcab" * 40 + "x" + "cab" * 30, "")]
    assert list(periodic.batch_runs(docs, 0, 2)) == [plain_runs(d) for d in docs]


def plain_digest(doc_id, text):
    words = (text or "").encode()
    for blank in b"\x09\x0a\x0b\x0c\x0d":
        words = words.replace(bytes([blank]), b" ")
    words = [w for w in words.split(b" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 6, 4)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    first = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, 1000 * first[1] // first[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_query_equals_the_plain_rule(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents WHERE coalesce(length(text), 0) < 4000").fetchall()
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", " \t\r\n", "one", "a " * 500, "a b\x1c " * 30, "x y " * 9, "w" * 50000, "a b c d " * 6 + "a a a a a a a"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, periodic.BATCH_WORDS):
        got = sorted(tuple(r) for r in periodic.run_digests(docs, batch_words=size).collect())
        assert got == sorted(plain_digest(*r) for r in rows)


def test_run_edges(spark):
    schema = "doc_id long, text string, n_runs string, start int"
    docs = spark.createDataFrame([(None, "a a a a a a", "x", 1), (7, "b " * 9, None, None), (7, "b " * 9, None, None), (8, None, None, None)], schema)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(None, 6, [(0, 6, 1)], "a"), (7, 9, [(0, 9, 1)], "b"), (7, 9, [(0, 9, 1)], "b"), (8, 0, [], "")], key=str)
    empty = spark.createDataFrame([], schema)
    assert periodic.run_digests(empty).count() == 0 and periodic.periodic_runs(empty).count() == 0
    assert queries.op13_periodic_runs(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
