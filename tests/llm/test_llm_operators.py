"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import fingerprints, langid, licenses, lines, media, near_dup, packing, sentencepiece

EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "Ünïcode — text"), (1004, "Ünïcode — text"), (None, "no id at all here"), (1005, "word " * 30000)]


def near_corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randint(20, 150))] for _ in range(40)]
    for i in range(220):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = near_corpus() + EDGES
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("signature", F.lit(1)).withColumn("block", F.lit("x")).repartition(4)


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_near_duplicates(spark, docs):
    rows = [(d, t) for d, t in near_corpus() + EDGES if d is not None]
    sets = {d: shingles(t, 3) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {d: (len(sets[d]), root(d), root(d) == d) for d in ids}
    got = near_dup.components(docs, 3, 85).where("doc_id is not null").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert near_dup.components(docs.limit(0), 3, 85).count() == 0
    kept = near_dup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d in ids if want[d][2]} | {None}


def test_lines(spark):
    rows = [(1, "a shared line of text here\nown"), (2, " A shared line of TEXT here \nother\nother"), (3, "x\na shared line of text here"), (4, None), (5, ""), (None, "a shared line of text here"), (6, "tiny\ntiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.line_digests(docs).collect()}
    assert got == {1: (2, 1, sha("own")), 2: (3, 1, sha("other\nother")), 3: (2, 0, sha(rows[2][1])), 4: (1, 0, sha("")), 5: (1, 0, sha("")), 6: (2, 0, sha("tiny\ntiny")), None: (1, 0, sha(rows[5][1]))}
    kept = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs).collect()}
    assert kept[1] == "own" and kept[4] is None and lines.line_digests(docs.limit(0)).count() == 0


def test_licenses(spark, docs):
    rows = [(1, "Under the MIT License, and the Apache License 2.0"), (2, "GNU General Public License general public license"), (3, None), (4, "nothing"), (5, "mitlicense")]
    got = {r["doc_id"]: r for r in licenses.license_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 2, 6, "apache,mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (2, 1, 4, 7)
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert got[5]["n_base"] == 0 and licenses.license_digests(docs).count() == docs.count()


def test_media_round_trip(docs):
    rows = media.media_digests(docs).collect()
    texts = {d: (t or "").encode() for d, t in near_corpus() + EDGES}
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(rows) == docs.count() and media.media_digests(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [(d, t) for d, t in near_corpus()[:30]] + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = dict(enumerate(ODD_TEXTS, 5000)) | {d: t or "" for d, t in near_corpus()[:60] + EDGES if d is not None} | {7000: None}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("piece", F.lit(1)).repartition(3)
    out = packing.pack(table)
    assert dict(out.dtypes)["piece"] == "int"
    rows = out.collect()
    by_doc: dict[int, list] = {}
    use: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        use.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids, start = coder.encode(text or "", add_special_tokens=False).ids + [0], 0
        for n, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, start, zlib.crc32(np.array(ids[start : start + r["length"]], "<u4").tobytes())), text and text[:50]
            assert r["length"] == 2048 or n == 0
            start += r["length"]
        assert start == len(ids) and (len(ids) <= 2048) == (len(by_doc[doc]) == 1)
    for spans in use.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    histogram = np.bincount([r["length"] for r in rows])
    assert len(use) <= sum(n for _, n in packing.best_fit(np.pad(histogram, (0, 2049 - len(histogram))), 2048))
    assert len(packing.pack(docs).collect()) >= docs.count() and packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["wide", "middle", "halves", "few", "none"])
def test_configuration_program(kind):
    """Every piece is placed once, no sequence is overfull, the bound holds, and no more sequences are needed than by best fit."""
    rng = np.random.default_rng(6)
    lengths = {"wide": rng.integers(1, 257, 3000), "middle": np.clip(rng.normal(90, 30, 3000).astype(int), 1, 256), "halves": rng.integers(80, 140, 2000), "few": rng.integers(1, 257, 40), "none": np.full(7, 256)}[kind]
    histogram = np.bincount(lengths, minlength=257)
    groups, bound, given = packing.solve(dict(enumerate(histogram.tolist())), 256)
    used = np.zeros(257, dtype=int)
    for config, times in groups:
        assert sum(i * k for i, k in config) <= 256 and times > 0
        for i, k in config:
            used[i] += k * times
    n, plain = sum(times for _, times in groups), sum(times for _, times in packing.best_fit(histogram.copy(), 256))
    assert (used == histogram).all() and bound <= n <= plain
    if kind == "halves":
        assert n < plain
    if kind in ("wide", "middle", "halves"):
        assert given > n / 2  # the program gives most sequences, best fit packs what is left
    amounts, low = packing.fractional(histogram * (np.arange(257) < 256), 256)
    share = np.zeros(257)
    for config, amount in amounts.items():
        for i, k in config:
            share[i] += k * amount
    assert (share <= histogram + 1e-6).all() and low <= n


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    odd = langid.held_out_languages(docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang"))
    assert {r["lang_pred"] for r in odd.collect()} == {"und"}


ODD_TEXTS = [
    "", " ", "  two  spaces ", "Hello, world!", "naïve café — “quoted” …", "日本語のテキスト。", "Привет, мир!", "🙂🙃 emoji 👩‍👩‍👧", "a\nb\n\nc", "\ttab\x00null", "x" * 5000, "ab" * 3000, "1234567890 1.5e-10 $%&",
    "<s> </s> <unk> <|endoftext|>", "ÀÉÎÕÜ ßẞ ŉ ǆ", "مرحبا بالعالم", "עברית", "हिन्दी", "ﬁ ligature", "e\u0301 combining", "ᚠᛇᚻ", "\U0001d518\U0001d52b", "ٱلْعَرَبِيَّة 123", "snake_case_name CamelCase", "don't won't it's",
]


def test_sentencepiece_like_the_library(spark):
    import public_tokenizers
    import sentencepiece as library

    texts = ODD_TEXTS + [t for _, t in near_corpus()[:40]] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    model = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == model.encode(text), text[:60]
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(sentencepiece.encode(docs)).collect()}
    assert back == {i: model.decode(got[i]) for i in back}
    digests = {r["doc_id"]: r for r in sentencepiece.round_trip_digests(docs).collect()}
    for i, text in enumerate(texts):
        assert digests[i]["n_ids"] == len(got[i]) and digests[i]["ids_crc32"] == zlib.crc32(np.array(got[i], "<u4").tobytes()) and digests[i]["exact"] == (back[i] == text)
        assert digests[i]["decoded_sha256"] == hashlib.sha256(back[i].encode()).hexdigest()


def test_sentencepiece_round_trip(docs):
    rows = sentencepiece.round_trip_digests(docs).collect()
    assert len(rows) == docs.count() and all(r["exact"] for r in rows) and sentencepiece.round_trip_digests(docs.limit(0)).count() == 0


def test_sentencepiece_long_word():
    import time

    import public_tokenizers
    import sentencepiece as library

    own, word = sentencepiece.pieces(public_tokenizers.path(sentencepiece.MODEL)), "".join(random.Random(4).choice("abcdeé") for _ in range(200_000))
    began = time.time()
    got = np.frombuffer(own.encode([word], {})[0], dtype="<u4").tolist()
    assert time.time() - began < 60
    assert got == library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL)).encode(word)


def test_language_id_learns_from_copies_and_long_texts(spark):
    """Languages that are one text in many copies, or only long texts, have dictionaries too."""
    rows = [(f"l{k}", f"only text of language number {k}") for k in range(8) for _ in range(3000)]
    rows += [("long", "a very long text of many words, piece %d " % i * 20000) for i in range(3)]
    learned = langid.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert set(learned) == {f"l{k}" for k in range(8)} | {"long"}
    assert all(8 <= len(d) <= 65536 for d in learned.values()) and len(learned["long"]) == 65536
    with pytest.raises(ValueError, match="more than 5 languages"):
        langid.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"), max_langs=5)


def test_language_id_margins_and_edges(spark):
    """Against the encoder itself: the smallest encoding wins, ties go to the first name with no margin, one setting for all lengths."""
    rng = random.Random(9)
    one, two = ([("".join(rng.choice(c) for _ in range(5))) for _ in range(60)] for c in ("abcdefg", "mnopqrst"))
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    dictionaries = {"aa": say(one, 4000).encode(), "bb": say(two, 4000).encode()}
    rows = [(1, say(one, 50)), (2, say(two, 12)), (3, say(two, 60000)), (4, say(one, 50).upper()), (5, "4711 !?"), (6, None), (7, ""), (8, "ж"), (None, say(two, 30)), (9, say(one, 200) + say(two, 200)), (1, say(two, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("letters", F.lit(1))
    got = langid.classify(docs, dictionaries).collect()
    assert len(got) == len(rows)
    coders = {lang: langid.coder(d) for lang, d in dictionaries.items()}
    by_size = {}
    for doc, text in rows:
        sizes = {lang: len(c.compress(langid.folded(text or ""))) for lang, c in coders.items()}
        best, second = sorted(sizes.values())
        letter = any(c.isalpha() for c in text or "")
        lang = min(lang for lang, n in sizes.items() if n == best) if letter else "und"
        by_size.setdefault(doc, []).append((lang, min(1.0, 4 * (second - best) / best) if letter else 0.0))
    for r in got:
        assert any(r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12 for lang, score in by_size[r["doc_id"]])
        assert r["rejected"] == (r["lang_pred"] != "und" and r["score"] < 0.02)
    told = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 1)}
    assert (told[2]["lang_pred"], told[3]["lang_pred"], told[4]["lang_pred"]) == ("bb", "bb", "aa") and told[8]["lang_pred"] == "aa" and told[8]["rejected"]
    assert langid.classify(docs, {}).where("lang_pred <> 'und'").count() == 0 and langid.classify(docs.limit(0), dictionaries).count() == 0


def test_fingerprint_estimates(spark):
    """Sketches, likeness, containment and counts against plain sets; parts of a text's shingles merge to the sketch of all."""
    rng = random.Random(12)
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 30, 300, 3000])))) for i in range(60)]
    rows += [(i + 100, rows[i][1] + " " + rows[i + 1][1]) for i in range(20)] + [(300, rows[3][1]), (300, rows[3][1]), (301, "  "), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit("clash")).repartition(4)
    hashed = docs.select("text", F.split(F.lower("text"), r"\s+").alias("w")).distinct().collect()
    grams = {r["text"]: [tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))] for r in hashed for own in [[w for w in r["w"] if w]] if own}
    flat = sorted({g for own in grams.values() for g in own}, key=str)
    codes = spark.createDataFrame([(i, *g, *[None] * (5 - len(g))) for i, g in enumerate(flat)], "i int, a string, b string, c string, d string, e string")
    code = {flat[r["i"]]: r["h"] for r in codes.select("i", F.shiftrightunsigned(F.xxhash64("a", "b", "c", "d", "e"), 16).alias("h")).collect()}
    sets = {t: {code[g] for g in own} for t, own in grams.items()}
    plain = {t: sorted(sets.get(t, set()))[:64] for t in {t for _, t in rows}}
    got = fingerprints.fingerprint_digests(docs).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    assert len(got) == len(rows)
    by_hex = lambda own: "".join(f"{h:012x}" for h in own)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    after = {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}

    def like(a, b):
        both = sorted(set(a) | set(b))[:64]
        return sum(h in a and h in b for h in both) / len(both) if both else 1.0

    for r in got:
        own = plain[texts[r["doc_id"]]]
        assert r["fingerprint"] == by_hex(own)
        if r["doc_id"] != 300:
            assert abs(r["near_next"] - like(own, plain[after[r["doc_id"]]])) < 1e-12
        n = len(sets.get(texts[r["doc_id"]], ()))
        assert r["n_shingles_estimate"] == n if n < 64 else abs(r["n_shingles_estimate"] / n - 1) < 0.5
        edited = [int(r["edited_fingerprint"][i : i + 12], 16) for i in range(0, len(r["edited_fingerprint"]), 12)]
        assert abs(r["near_edited"] - like(own, edited)) < 1e-12 and 0 <= r["contained_in_edited"] <= 1
    made = docs.where("doc_id is not null").withColumn("sketch", fingerprints.sketch(F.col("text"))).withColumn("part", F.col("doc_id") % 3)
    merged = {r["part"]: r["sketch"] for r in fingerprints.merge_sketches(made, ["part"]).collect()}
    for part, own in merged.items():
        assert own == sorted(set().union(*(sets.get(t, set()) for d, t in rows if d is not None and d % 3 == part)))[:64]
    assert fingerprints.fingerprint_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part_bytes", [1, 300, 1 << 25])
def test_next_row(spark, part_bytes):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "none"), (50, "again"), (50, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(docs, ["text"], part_bytes).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got, key=str) == sorted(((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)), key=str)


def test_media_features_by_hand(docs):
    """Resampling against zero-stuffing and full convolution, frames against a plain DFT, segments against a scan, and what is stored."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=1000).astype(np.float32)
    taps = media.polyphase(media.UP, media.DOWN)
    flat = taps.T.ravel()
    stuffed = np.zeros(len(x) * media.UP, np.float32)
    stuffed[:: media.UP] = x
    whole = np.convolve(stuffed, flat)
    y, lead = media.resample(x), taps.shape[1] // 2
    want = whole[lead * media.UP :][:: media.DOWN][: len(y)]
    assert taps.shape[0] == media.UP > 1 and len(y) == -(-len(x) * media.UP // media.DOWN) and np.abs(y - want).max() < 1e-4
    mel, db = media.log_mel(y, 12000.0)
    padded = np.pad(y, (0, (len(mel) - 1) * media.HOP + media.FRAME - len(y)))
    assert len(mel) == 1 + max(0, -(-(len(y) - media.FRAME) // media.HOP)) and (len(mel) - 1) * media.HOP + media.FRAME >= len(y)
    n = np.arange(media.FRAME)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), n) / media.FRAME)
    for i in range(len(mel)):
        frame = padded[i * media.HOP : i * media.HOP + media.FRAME] * np.hanning(media.FRAME)
        assert np.abs(np.log(np.abs(dft @ frame) ** 2 @ media.mel_filters(12000.0) + 1e-6) - mel[i]).max() < 1e-2
    levels = [0, 0, 2, 4, 2, 0, 2, 2, 0, 0, 5, 0, 0, 0, 0]
    assert media.hysteresis(np.array(levels, float)) == [(2, 5), (10, 11)]
    tensors, starts, ends = media.tensors_from_bytes(media.tensors_to_bytes(media.tensor_blocks(mel), np.zeros(len(media.tensor_blocks(mel))), np.ones(len(media.tensor_blocks(mel)))))
    assert tensors.shape[1:] == (media.FRAMES, media.MELS) and (tensors.reshape(-1, media.MELS)[: len(mel)] == mel).all() and ends.sum() == len(ends)
    texts = {d: (t or "").encode() for d, t in near_corpus() + EDGES}
    seen = {}
    for r in media.media_digests(docs).collect():
        stored = media.to_wave(media.padded(texts[r["doc_id"]]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        f = media.media_features(stored)
        assert r["n_frames"] == f["n_frames"] and r["feature"].startswith(f"{f['n_frames']}x{media.MELS}:{len(f['spans'])}:")
        assert seen.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]
    stored = media.audio_features(media.store_texts(docs.where("doc_id = 3"))).first()
    values, starts, ends = media.tensors_from_bytes(bytes(stored["tensors"]))
    assert values.shape == (len(starts), media.FRAMES, media.MELS) and (ends > starts).all() and media.TENSORS.field("tensor").type.shape == [media.FRAMES, media.MELS]


def test_licenses_overlap_and_long_lists(spark):
    from corvane.llm import signatures

    own = signatures.signatures()
    assert len(own) > 250 and len({(label, words) for label, *_, words in own}) == len(own)
    texts = [(1, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0"), (2, "the mit license " * 3000), (3, "GNU Lesser General Public License version 2.1")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("detections", F.lit("clash"))).collect()}
    kept = [(d["label"], d["start"], d["end"]) for d in got[1]["detections"] if d["kept"]]
    assert kept == [("apache-2.0", 0, 8), ("apache-2.0", 8, 14)] and any(d["label"] == "apache" and not d["kept"] for d in got[1]["detections"])
    starts = [d["start"] for d in got[2]["detections"] if d["rule"] == "base/mit"]
    assert starts == list(range(1, 9000, 3))
    assert {d["label"] for d in got[3]["detections"] if d["kept"]} == {"lgpl-2.1"}


def variants(words):
    """Every text that a rule's words match: each choice, with and without the words that may be missing."""
    out = [[]]
    for token in words.split():
        options = [[w] for w in token.rstrip("?").replace("*", "xyz").split("|")] + ([[]] if token.endswith("?") else [])
        out = [text + o for text in out for o in options]
    return [" ".join(text) for text in out]


def test_license_gates_hide_no_match():
    """Keywords and roots are in every text that a rule matches, whichever choice is taken and whatever may be missing is missing."""
    import re

    from corvane.llm import signatures

    roots, n = licenses.roots(), 0
    for _, _, _, keyword, words in [*signatures.signatures(), *((label, 1, 0.6, "license", words) for label, words in licenses.BASE)]:
        for text in variants(words):
            n += 1
            assert re.search(licenses.pattern(words), f" {text.replace(' ', '  ')} "), text
            assert keyword in text and any(r in text for r in roots), (keyword, text)
    assert n > 1000 and len(roots) < 40


def test_licenses_that_hold_no_usual_word(spark):
    said = ["CC BY 4.0 International", "BSD Zero Clause License", "NASA Open Source Agreement version 1.3", "For research use only license", "MIT No Attribution", "CC0 1.0 Universal", "plain prose", None]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = [r["labels"] for r in licenses.license_digests(docs).orderBy("doc_id").collect()]
    assert got == ["cc-by-4.0", "0bsd", "nasa-1.3", "academic-use", "mit-0", "cc0-1.0", "", ""]
    assert licenses.license_digests(docs.limit(0)).count() == 0


def test_lines_over_borders(spark):
    """A line that every document holds spreads over many ranges; the result is that of one range."""
    rows = [(i, "the very common line of all documents\nown line number %d of this text\n\nthe very common line of all documents" % i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.line_digests(docs).collect()}
    assert got == {i: 2 if i < 399 else 0 for i in range(400)}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_program_gives_most_sequences(sf):
    """On the fixtures' own lengths: never above best fit, within two of the bound, and over half of the sequences are the program's."""
    import public_tokenizers
    import pyarrow.parquet as pq

    coder, histogram = packing.TextTokenizer(public_tokenizers.path(packing.TOKENIZER)), np.zeros(2049, dtype=np.int64)
    for text in pq.read_table(f"/root/testdata/sf{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        for length in packing.cut_lengths(len(coder.encode(text or "")) // 4 + 1, 2048):
            histogram[length] += 1
    groups, bound, given = packing.solve(dict(enumerate(histogram.tolist())))
    n = sum(times for _, times in groups)
    assert bound <= n <= bound + 2 and n <= sum(times for _, times in packing.best_fit(histogram.copy(), 2048))
    assert given > (n - histogram[2048]) / 2
