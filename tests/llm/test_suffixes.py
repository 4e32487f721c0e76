"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from corvane.llm import suffixes


def brute(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] of (doc_id, text) rows."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            if key in seen:
                gone[i : i + length] = True
            seen.add(key)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_construction(block, monkeypatch):
    random.seed(block)
    monkeypatch.setattr(suffixes.Construction.__init__, "__defaults__", (block,))
    for _ in range(5):
        parts = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 50))) for _ in range(10)]
        pieces = [random.choice(parts) + random.choice(parts)[:20] for _ in range(20)]
        seen, want = set(), set()
        for i, piece in enumerate(pieces):
            for j in range(len(piece) - 11):
                if piece[j : j + 12] in seen:
                    want.add((i, j))
                seen.add(piece[j : j + 12])
        order = np.stack([np.arange(len(pieces)), np.zeros(len(pieces), dtype=np.int64)], axis=1)
        assert set(zip(*(x.tolist() for x in suffixes.repeated_starts(pieces, order, 12)))) == want


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(40) for _ in range(6)]
    texts = [None, "", "short", "x" * 700, "ab" * 300, "x" * 120, shared[0], shared[0], shared[1] + shared[1]]
    for _ in range(60):
        texts.append(make(rng.randint(5, 80)) + rng.choice(shared)[rng.randint(0, 20) :] + make(rng.randint(0, 60)))
    hot = make(60)
    texts += [make(3) + hot[: rng.choice([90, 200, 400])] + make(2) for _ in range(80)]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"cell": 3}, {"cell": 0}, {"chunk": 1}])
def test_digests(spark, how):
    """The hot passage stands in most documents, so its copies reach over the borders of ranges."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in suffixes.suffix_digests(docs, **how).collect())
    assert got == brute(rows, 100)


def test_edges(spark):
    rows = [(1, "a" * 150), (1, "a" * 150), (2, "é" * 80), (None, "a" * 150), (3, "é" * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as place", "'x' as bytes", "2 as text_key", "3 as n_chars")
    got = sorted((tuple(r)[:4] for r in suffixes.suffix_digests(docs).collect()), key=str)
    assert got == sorted([(1, 150, 149, 1), (1, 150, 149, 1), (2, 160, 158, 1), (None, 150, 0, 0), (3, 160, 160, 1)], key=str)
    kept = {r["doc_id"]: r for r in suffixes.drop_repeated_passages(docs).collect()}
    assert kept[3]["text"] == "" and kept[2]["text"] == "é" and kept[2]["n_chars"] == 1 and kept[None]["text"] == "a" * 150
    assert suffixes.suffix_digests(docs.limit(0)).count() == 0
