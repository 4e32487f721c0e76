"""Each stage of the pipeline at its own settings against brute force, over fixture texts with planted copies, lines, passages and odd rows."""

import os
import random
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
STAGE = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, kept int, piece string, places string, n_chars long"


def planted():
    """(doc_id, text): fixture texts, near copies of some of them, a passage and a line that many share, odd rows."""
    import pyarrow.parquet as pq

    rng, table = random.Random(11), pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table[:120]]
    long = [t for _, t in rows if t and len(t.split()) > 60]
    passage, line = " ".join(long[0].split()[:55]), "This line stands in many documents of the set"
    for i in range(12):
        words = rng.choice(long).split()
        words[rng.randrange(len(words))] = "exchanged"
        rows.append((100_000 + i, " ".join(words)))
        rows.append((200_000 + i, " ".join(rng.sample(long[1].split(), 30)) + " " + passage + " " + " ".join(rng.sample(long[2].split(), 30))))
        rows.append((300_000 + i, f"{rng.random()} own\n  {line.upper()} \n{rng.random()} end"))
    return rows + [(400_000, None), (400_001, ""), (400_002, " \n\t "), (400_003, "one"), (400_004, long[3]), (400_004, long[3]), (None, "a row without any id"), (400_005, "word " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "x", "y", None if t is None else len(t)) for d, t in rows], SHAPE).repartition(4)


def texts(out):
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_lines(spark):
    rows = planted()
    key = lambda s: re.sub(r"[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    holders: dict[str, set] = {}
    for d, t in rows:
        if d is not None:
            for s in (t or "").split("\n"):
                holders.setdefault(key(s), set()).add(d)
    drops = {k for k, own in holders.items() if len(k) >= 20 and len(own) >= 3}
    assert len(drops) >= 1
    want = [(d, t if t is None or d is None else "\n".join(s for s in t.split("\n") if key(s) not in drops or d == max(holders[key(s)]))) for d, t in rows]
    docs = frame(spark, rows)
    out = STAGE["lines"](spark, docs, SF)
    assert out.columns == docs.columns and texts(out) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_near_duplicates(spark):
    """Five words, 0.8 or more: one document of each group stays."""
    rows = planted()
    sets = {}
    for d, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    ids = sorted(d for d in sets if d is not None)
    first = {d: d for d in ids}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    want = sorted(((d, t) for d, t in rows if d is None or root(d) == d), key=str)
    assert len(want) <= len(rows) - 12
    docs = frame(spark, rows)
    out = STAGE["near_duplicates"](spark, docs, SF)
    assert out.columns == docs.columns and texts(out) == want


def test_passages(spark):
    rows = [(d, t) for d, t in planted() if d is not None and d != 400_004]
    seen, want = set(), []
    for d, t in sorted(rows):
        if t is None:
            want.append((d, t))
            continue
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        want.append((d, "".join(c for c, at in zip(t, np.cumsum([0] + [len(c.encode()) for c in t])) if not gone[at : at + len(c.encode())].all())))
    docs = frame(spark, rows)
    out = STAGE["passages"](spark, docs, SF)
    assert out.columns == docs.columns and texts(out) == sorted(want, key=str)
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in rows)


def test_quality(spark):
    """What the operator judges as kept stays, as it is, and almost all that is labelled good does."""
    from corvane.llm import quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = STAGE["quality"](spark, docs, SF)
    kept = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["kept"]}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} & {r["doc_id"] for r in docs.collect()}
    assert good and len(good & kept) >= 0.95 * len(good)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in planted() if d != 400_004 and d is not None]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    need = {d: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    got: dict[int, int] = {}
    use: dict[int, int] = {}
    for r in STAGE["packing"](spark, frame(spark, rows), SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        use[r["sequence_id"]] = use.get(r["sequence_id"], 0) + r["length"]
    assert got == need and max(use.values()) <= 2048 and len(use) <= -(-sum(need.values()) // 2048) + 2


def test_empty_tables(spark):
    """No documents: every stage gives no rows, with the columns of its input."""
    docs = frame(spark, planted()[:1]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_all_stages_over_odd_rows(spark):
    docs = frame(spark, planted())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
