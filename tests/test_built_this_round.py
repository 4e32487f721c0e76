"""Paged scans, carried folds, fuzzy joins, one-to-one matching, Kendall, braces, digests and polygons against plain versions."""

import difflib
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import resolve, shapes, stats
from corvane.plans import models
from corvane.sources import paged, readers
from corvane.streaming import jobs

# paged scans


def pages(folder, n, limit, skip=(), torn=None):
    for p in range(-(-n // limit)):
        if p not in skip:
            (folder / f"page={p}").mkdir(parents=True)
            records = [{"code": f"{i:04d}", "n": i, "extra": None} for i in range(p * limit, min(n, (p + 1) * limit))]
            said = json.dumps({"result": {"total": n, "records": records}})
            (folder / f"page={p}" / "part.json").write_text(said[: len(said) // 2] if p == torn else said)
    return str(folder)


def test_scan_reads_each_page_in_a_task_of_its_own(spark, tmp_path):
    end = pages(tmp_path, 23, 5)
    found = paged.scan(spark, end, ["code", "n", "nothing", "_page", "_total"], 5, required=["code"], least=20, most=30)
    assert found.rdd.getNumPartitions() == 5
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(f"{i:04d}", str(i), None, str(i // 5), "23") for i in range(23)]


def test_scan_verifies_before_it_reads(spark, tmp_path):
    end = pages(tmp_path, 23, 5)
    for wrong, what in (({"least": 24}, "a total of 23"), ({"most": 22}, "a total of 23"), ({"required": ["code", "absent"]}, "absent")):
        with pytest.raises(Exception, match=what):
            paged.scan(spark, end, ["code"], 5, **wrong).count()
    with pytest.raises(Exception, match="records, not"):
        paged.scan(spark, end, ["code"], 4).count()


@pytest.mark.parametrize(("landed", "first"), [([0, 1, 2], 2), ([0], 0), ([0, 2, 3], 0), ([1, 2], 0), (range(5), 4)])
def test_resume_keeps_what_is_sound(spark, tmp_path, landed, first):
    end, there = pages(tmp_path / "a", 23, 5), pages(tmp_path / "b", 23, 5, skip=[p for p in range(5) if p not in landed], torn=max(landed))
    rows, at = paged.resumed(spark, end, there, ["code"], 5)
    assert at == first and sorted(r["code"] for r in rows.collect()) == [f"{i:04d}" for i in range(23)]


def test_unchanged_total_reads_nothing(spark, tmp_path):
    end = pages(tmp_path, 7, 5)
    rows, did = paged.scan_if_changed(spark, "s", end, ["code"], 5)
    assert rows.count() == 7 and not did.unchanged and did.content_hash == hashlib.sha256(b"s:total=7").hexdigest()
    again, told = paged.scan_if_changed(spark, "s", end, ["code"], 5, did.content_hash)
    assert again is None and told.unchanged and told.note == "unchanged (total=7 matches previous ingest)"


# the carried fold

EVENTS = "key long, field string, value double, at timestamp, order long"


def test_fold_over_batches_and_a_restart_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.choice("ab"), rng.choice([None, 1.0, 2.5]), f"2024-01-{rng.randint(1, 28):02d} 00:00:00", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "key long, field string, value double, at string, order long").withColumn("at", F.col("at").cast("timestamp"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(source).withWatermark("at", "400 days")
    for part in range(3):  # each turn is a query of its own that goes on from the state of the one before
        frame.where(F.col("order") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        jobs.run_fold(stream, out, state, idle=900 * 86400.0)
    got = {(r["key"], r["field"]): (r["n"], r["total"], r["last"], r["first_at"], r["last_at"], r["sealed"]) for r in jobs.folded(spark, out).collect()}
    ends = {r["key"]: (r["a"], r["z"]) for r in frame.groupBy("key").agg(F.min("at").alias("a"), F.max("at").alias("z")).collect()}
    want = frame.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("t"), F.max_by(F.struct("value"), F.struct("at", "order")).alias("l"))
    assert got == {(r["key"], r["field"]): (r["n"], r["t"], r["l"]["value"], *ends[r["key"]], False) for r in want.collect()}


def test_idle_keys_are_sealed(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(source).withWatermark("at", "1 hour")
    for rows in ([(1, "a", 1.0, "2024-01-01", 1)], [(2, "a", 5.0, "2024-03-01", 2)], [(2, "b", 5.0, "2024-03-02", 3)]):
        spark.createDataFrame(rows, "key long, field string, value double, at string, order long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        jobs.run_fold(stream, out, state, idle=86400.0)
    got = {(r["key"], r["field"]): (r["n"], r["sealed"]) for r in jobs.folded(spark, out).collect()}
    assert got[1, "a"] == (1, True) and not got[2, "b"][1]


# names


@pytest.mark.parametrize("cutoff", [0.88, 0.75, 0.6])
def test_similar_names_equal_the_full_comparison(spark, cutoff):
    rng = random.Random(3)
    labels = sorted({(rng.choice("xy"), "".join(rng.choice("abcd ef") for _ in range(rng.randint(0, 14)))) for _ in range(120)})
    spine = set()
    for block, name in labels:
        own = list(name)
        for _ in range(rng.randint(0, 3)):
            if own:
                own[rng.randrange(len(own))] = rng.choice("abcd")
            if rng.random() < 0.4:
                own.insert(rng.randrange(len(own) + 1), rng.choice("ab"))
        spine.add((block, "".join(own)))
    found = resolve.similar_in_block(spark.createDataFrame(labels, "block string, label string"), spark.createDataFrame(sorted(spine), "block string, nname string"), "label", cutoff)
    want = {(b, a, n): r for b, a in labels for c, n in spine if b == c and (r := difflib.SequenceMatcher(None, n, a).ratio()) >= cutoff}
    assert {(r["block"], r["label"], r["nname"]): r["ratio"] for r in found.collect()} == want and want


def test_one_to_one_equals_taking_pairs_in_order(spark):
    rng = random.Random(9)
    rows = list({(rng.choice("xy"), f"l{rng.randrange(25)}", rng.randrange(25), rng.choice([0.86, 0.9, 0.95, 1.0])) for _ in range(400)})
    best = {}
    for b, a, c, s in rows:
        best[b, a, c] = max(s, best.get((b, a, c), 0))
    used, want = set(), []
    for (b, a, c), s in sorted(best.items(), key=lambda r: (-r[1], r[0][1], r[0][2])):
        if not {(b, a), (b, c)} & used:
            used |= {(b, a), (b, c)}
            want.append((b, a, c, s))
    frame = spark.createDataFrame([*rows, ("x", None, 1, 1.0), ("x", "l1", None, 1.0), ("x", "l1", 2, None)], "block string, label string, code long, score double")
    assert sorted(tuple(r) for r in resolve.one_to_one(frame).collect()) == sorted(want)
    assert resolve.one_to_one(frame.limit(0)).count() == 0


# statistics


def plain_kendall(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    s = p = q = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            u, v = np.sign(a - c), np.sign(b - d)
            s, p, q = s + u * v, p + abs(u), q + abs(v)
    return s / math.sqrt(p * q)


@pytest.mark.parametrize("size", [7, 64, 1 << 18])
def test_kendall_counts_pairs_without_making_them(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([1.0, 2.0, rng.random() * 9, None]), rng.choice([3.0, rng.random() * 9])) for i in range(260)]
    got = stats.kendall_whole(spark.createDataFrame(rows, "entity long, x double, y double"), "x", "y", size=size).first()
    assert got["n"] == sum(r[1] is not None for r in rows) and got["tau_b"] == pytest.approx(plain_kendall([r[1:] for r in rows]), abs=1e-12)


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 65):
        a = rng.permutation(n)
        assert stats.inversions(a) == sum(int(a[i] > a[j]) for i in range(n) for j in range(i + 1, n))


def test_correlation_pairs_and_adequacy_like_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] -= 0.5 * x[:, 2]
    names = ["a", "b c", "d", "e"]
    rows = [(i, n, float(x[i, j])) for i in range(200) for j, n in enumerate(names)] + [(500, "a", 3.0)]
    found = {(r["a"], r["b"]): (r["r"], r["n"]) for r in stats.pearson_pairs(spark.createDataFrame(rows, "entity long, indicator string, value double")).collect()}
    r = np.corrcoef(x.T)
    assert len(found) == 6 and all(found[names[i], names[j]] == (pytest.approx(r[i, j]), 200) for i in range(4) for j in range(i + 1, 4))
    kmo, chi2, dof = models.adequacy(r, 200)
    inverse = np.linalg.inv(r)
    partial = -inverse / np.sqrt(np.outer(inverse.diagonal(), inverse.diagonal()))
    off = ~np.eye(4, dtype=bool)
    assert kmo == pytest.approx((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))
    assert (chi2, dof) == (pytest.approx(-(199 - 13 / 6) * np.log(np.linalg.det(r))), 6)
    assert models.precision(np.ones((3, 3)))[0].shape == (3, 3)


# texts and digests


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('{"a": {"b": {"c": 1}}}', '{"a": {"b": {"c": 1}}}'), ('{"a": "}"} tail }', '{"a": "}"}'), ('x {"q": "\\\\"} {', '{"q": "\\\\"}'), ('{"q": "\\"}"}', '{"q": "\\"}"}'), ("no object", None), ("", None), (None, None),
        ('{"open": {', None), ('"quoted" before {"k": "é{"} after', '{"k": "é{"}'), ("}} {} {", "{}"), ("\U0001f600{\"k\": \"\U0001f600}\"}!", "{\"k\": \"\U0001f600}\"}"), ("{" * 50 + "}" * 50 + "}", "{" * 50 + "}" * 50),
        ('```json\n{"k": [{}]}\n``` and {"no": 1}', '{"k": [{}]}'), ('```\n{"k": 1}', '{"k": 1}'),
    ],
)
def test_balanced_objects(spark, said, want):
    assert spark.createDataFrame([(said,)], "x string").select(text.answered_object("x").alias("y")).first()["y"] == want


def test_ordered_digest_sees_order_and_nothing_else(spark):
    rows = [(k, i * 37, f"c{i % 7}" if i % 5 else None) for k in (1, 2) for i in range(400)]
    digest = lambda data, parts: {r["key"]: r["digest"] for r in readers.ordered_digest(spark.createDataFrame(data, "key long, at long, c string").repartition(parts), "key", "at", "c", bits=4).collect()}
    base = digest(rows, 1)
    assert base == digest(rows[::-1], 7) and base[1] == base[2]
    swapped = [(k, {37: 74, 74: 37}.get(at, at) if k == 2 else at, c) for k, at, c in rows]
    other = digest(swapped, 3)
    assert other[1] == base[1] and other[2] != base[2]
    assert digest([(k, at, "" if c is None else c) for k, at, c in rows], 2) != base
    assert digest([(9, -5, "x"), (9, 2**40, "y"), (None, 1, "z")], 2).keys() == {9} and digest([(9, -5, "x")], 1) != digest([(9, 5, "x")], 1)
    assert readers.ordered_digest(spark.createDataFrame([], "key long, at long, c string"), "key", "at", "c").count() == 0


# polygons


def plain_place(x, y, polygons, limit):
    def far(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0.0
        return round(math.hypot(x - a[0] - t * dx, y - a[1] - t * dy), 9)

    edges = [(k, a, b) for k, rings in polygons for ring in rings for a, b in zip(ring, ring[1:])]
    inside = [k for k, _ in polygons if sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for i, a, b in edges if i == k) % 2]
    if inside:
        return min(inside), "inside"
    d, k = min((far(a, b), k) for k, a, b in edges)
    if d < limit:
        return k, "edge"
    centre = {k: [sum(p[i] for p in rings[0][:-1]) / (len(rings[0]) - 1) for i in (0, 1)] for k, rings in polygons}
    return min((round(math.hypot(x - c[0], y - c[1]), 9), k) for k, c in centre.items())[1], "centre"


def test_points_find_their_polygons(spark):
    rng = random.Random(4)
    polygons = []
    for k in range(12):
        cx, cy, n = rng.uniform(-5, 9), rng.uniform(-5, 9), rng.randint(3, 9)
        angles = sorted(rng.uniform(0, 6.283) for _ in range(n))
        outer = [[cx + rng.uniform(0.4, 1.8) * math.cos(a), cy + rng.uniform(0.4, 1.8) * math.sin(a)] for a in angles]
        hole = [[cx + 0.15 * math.cos(a), cy + 0.15 * math.sin(a)] for a in angles]
        polygons.append((k, [outer + outer[:1]] + ([hole + hole[:1]] if k % 2 else [])))
    points = [(i, rng.uniform(-8, 12), rng.uniform(-8, 12)) for i in range(400)] + [(900, 300.0, -250.0), (901, None, 1.0)]
    found = shapes.assign_points(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(polygons, "id long, rings array<array<array<double>>>"), 0.15, 0.7)
    assert {r["point"]: (r["id"], r["how"]) for r in found.collect()} == {i: plain_place(x, y, polygons, 0.15) for i, x, y in points if x is not None}


def test_diacritics_of_both_latin_blocks(spark):
    said = [("Ệ ộ Ạ ś Ñ ǘ ẅ é", "E o A s N u w e"), ("Łß ﬁ", "Łß ﬁ"), (None, None), ("", "")]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(said)], "i int, x string")
    assert [r["y"] for r in rows.select("i", text.without_diacritics("x").alias("y")).orderBy("i").collect()] == [y for _, y in said]


# many pages


def grouped_pages(folder, n, limit, group, skip=(), cut=None):
    for g in range(-(-n // (limit * group))):
        lines = []
        for p in range(g * group, (g + 1) * group):
            records = [{"code": f"{i:04d}"} for i in range(p * limit, min(n, (p + 1) * limit))]
            if records and p not in skip:
                said = json.dumps({"page": p, "result": {"total": n, "records": records}}, separators=(",", ":"))
                lines.append(said[:cut[1]] if cut and cut[0] == p else said)
        if lines:
            (folder / f"group={g}").mkdir(parents=True)
            (folder / f"group={g}" / "part.txt").write_text("\n".join(lines[::-1]) + "\n")
    return str(folder)


def test_many_pages_are_few_tasks_and_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "TASKS", 4)
    end = pages(tmp_path / "a", 203, 5)
    reader = paged.PagedReader({"endpoint": end, "limit": "5", "first_page": "3"}, spark.range(0).schema)
    parts = reader.partitions()
    assert len(parts) <= 5 and [p for x in parts for p in range(x.first, x.last + 1)] == list(range(3, 41))
    end = grouped_pages(tmp_path / "b", 203, 5, 8)
    for first in (0, 5, 8, 40, 41):
        parts = paged.PagedReader({"endpoint": end, "limit": "5", "group": "8", "first_page": str(first)}, spark.range(0).schema).partitions()
        assert len(parts) <= 5 and [p for x in parts for p in range(x.first, x.last + 1)] == list(range(first, 41))
    rows = paged.scan(spark, end, ["code", "_page"], 5, 7, group=8).collect()
    assert sorted((r["code"], r["_page"]) for r in rows) == [(f"{i:04d}", str(i // 5)) for i in range(35, 203)]
    with pytest.raises(Exception, match="no page 9"):
        paged.scan(spark, grouped_pages(tmp_path / "c", 203, 5, 8, skip=[9]), ["code"], 5, group=8).count()


@pytest.mark.parametrize(("cut", "first"), [(60, 12), (10, 11), (3, 11)])
def test_grouped_pages_are_resumed(spark, tmp_path, cut, first):
    """Page 12 is torn: behind its number, within it (so that it reads as 1) and before it."""
    end, there = grouped_pages(tmp_path / "a", 103, 5, 4), grouped_pages(tmp_path / "b", 103, 5, 4, skip=range(13, 30), cut=(12, cut))
    rows, at = paged.resumed(spark, end, there, ["code"], 5, group=4)
    assert at == first and sorted(r["code"] for r in rows.collect()) == [f"{i:04d}" for i in range(103)]


def test_no_step_for_each_character_of_an_object(spark):
    """Random texts against a plain scan, long strings and depths beyond the pattern; and a text is never split into characters."""
    rng = random.Random(4)
    said = ["".join(rng.choice('{}"\\ aé\n[') for _ in range(rng.randrange(40))) for _ in range(3000)]
    said += ['{"a": "' + "\\\"}" * 20_000 + '"} }', "{" * 300 + '"}"' + "}" * 301, '{"a": 1, ' * 6 + "{}" + "}" * 5, "{" + '"a": {"b": {}}, ' * 5000 + "}}"]

    def plain(x):
        depth, quoted, escaped, start = 0, False, False, x.find("{")
        for i in range(start, len(x)) if start >= 0 else ():
            c = x[i]
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c in '{}"':
                quoted, depth = c == '"', depth + (c == "{") - (c == "}")
                if not depth:
                    return x[start : i + 1]

    found = spark.createDataFrame(list(enumerate(said)), "k int, x string").repartition(8).withColumn("y", text.first_object("x"))
    assert {r["k"]: r["y"] for r in found.select("k", "y").collect()} == {k: plain(x) for k, x in enumerate(said)}
    assert "split(" not in found._jdf.queryExecution().analyzed().toString()


def test_ranked_ranks_each_column_once(spark, monkeypatch):
    """The best rank and the share of the overall index come from one pass; delta has the other."""
    from corvane.operators import ranks
    from corvane.plans import index

    rows = spark.createDataFrame([(i, 1, 1.0, None if i % 5 == 0 else float(i % 7), float(i % 40), 1.0, float(i % 50)) for i in range(200)], "entity long, grp int, spend double, delta double, size double, quality double, overall double")
    monkeypatch.setattr(index, "scored", lambda *_: rows)
    asked, plain = [], ranks.average_ranks
    monkeypatch.setattr(ranks, "average_ranks", lambda r, by, value="value", *more, **named: asked.append(value) or plain(r, by, value, *more, **named))
    got = {r["entity"]: r for r in index.ranked(spark, "").collect()}
    assert asked == ["overall", "delta"]
    assert all(r["rank_overall"] == 4 * (49 - i % 50) + 2 for i, r in got.items())  # four of each: 1 to 4 give 2.5, cut to 2
    assert {i for i, r in got.items() if r["growth_flag"]} == {i for i in range(200) if i % 5 and i % 7 > np.quantile([j % 7 for j in range(200) if j % 5], 0.75) and 4 * (49 - i % 50) + 2 > 100}
    assert got[0]["growth_gap"] is None and got[49]["tier"] == "A"


def test_pillar_columns_like_pillars_and_blocked(spark):
    from corvane.operators import matrix

    tree = spark.createDataFrame([("a", "p", 1), ("b", "p", -1), ("c", "q", 1)], "indicator string, pillar string, direction int")
    rows = spark.createDataFrame([(i, 0, k, None if (i + j) % 4 == 0 else float((i * 7 + j) % 11)) for i in range(30) for j, k in enumerate("abc")], "entity long, grp int, indicator string, value double")
    full = matrix.impute(rows)
    got = {r["entity"]: r for r in matrix.pillar_columns(matrix.normalised(full, tree).withColumn("missing", ~F.col("provenance").eqNullSafe("observed")), ["p", "q", "r"]).collect()}
    for r in matrix.pillars(full, tree).join(matrix.blocked(rows, tree), ["entity", "pillar"]).collect():
        assert got[r["entity"]][f"{r['pillar']}_p"] == pytest.approx(r["score"]) and got[r["entity"]][f"{r['pillar']}_b"] == r["blocked"]
    assert len(got) == 30 and all(r["r_p"] is None and r["r_b"] is False for r in got.values())


def test_ranks_are_not_joined_back(spark):
    """Hot values, nulls, NaN, null groups and weights as pandas ranks them; rows meet the buckets' totals by broadcast only."""
    from corvane.operators import ranks

    rng = random.Random(9)
    rows = [(i, "ab"[i % 2], None if i % 17 == 0 else 4.0 if i % 3 == 0 else float("nan") if i % 41 == 0 else rng.gauss(0, 9), i) for i in range(2000)]
    rows += [(2000 + i, "one", 1.5, i) for i in range(9)] + [(2010, "none", None, 0), (2011, None, 1.0, 0)]
    frame = spark.createDataFrame(rows, "entity long, g string, value double, more int").repartition(7)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranks.average_ranks(frame, ["g"], buckets=8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["entity"]: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert len(got) == len(rows) and all(got[i]["more"] == m for i, _, _, m in rows)
    for g in ("a", "b", "one", "none"):
        own = [(i, x) for i, h, x, _ in rows if h == g]
        known = [x for _, x in own if x is not None]
        for i, x in own:
            less, ties = sum(y < x if x == x else y == y for y in known) if x is not None else 0, sum(y == x or (y != y and x != x) for y in known) if x is not None else 0
            assert (got[i]["rank"], got[i]["n"]) == ((None, None) if x is None else (less + (ties + 1) / 2, len(known)))
    assert got[2011]["rank"] is None


def test_second_median_only_where_a_cell_is_left(spark, monkeypatch):
    from corvane.operators import matrix

    asked, plain = [], matrix.medians
    monkeypatch.setattr(matrix, "medians", lambda rows, by, *more, **named: asked.append((by, rows.select("indicator").distinct().count())) or plain(rows, by, *more, **named))
    cells = [(i, i % 3, k, None if i % 5 == 0 else float(i + j)) for i in range(30) for j, k in enumerate("pq")]
    frame = lambda c: spark.createDataFrame(c, "entity long, grp int, indicator string, value double")
    full = {(r["entity"], r["indicator"]): (r["value"], r["provenance"]) for r in matrix.impute(frame(cells)).collect()}
    assert asked == [(["grp", "indicator"], 2)] and {p for _, p in full.values()} == {"observed", "group_median"}
    asked.clear()
    less = [(i, g, k, None if g == 2 and k == "q" else x) for i, g, k, x in cells]
    got = {(r["entity"], r["indicator"]): (r["value"], r["provenance"]) for r in matrix.impute(frame(less)).collect()}
    assert asked == [(["grp", "indicator"], 2), (["indicator"], 1)]
    filled = [full[i, "q"][0] for i in range(30) if i % 3 != 2]
    assert got == full | {(i, "q"): (float(np.median(filled)), "overall_median") for i in range(2, 30, 3)}


def test_scored_ranks_all_cells_in_one_call(spark, monkeypatch):
    import os

    from corvane.operators import ranks
    from corvane.plans import index

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no fixture tables")
    asked, plain = [], ranks.average_ranks
    monkeypatch.setattr(ranks, "average_ranks", lambda r, by, *more, **named: asked.append(by) or plain(r, by, *more, **named))
    got = {r["entity"]: r for r in index.scored(spark, sf).collect()}
    assert asked == [["indicator"]]
    both = index.sized(spark, sf).join(index.quality(spark, sf), "entity").collect()
    assert len(got) == len(both)
    for r in both:
        assert got[r["entity"]]["quality"] == pytest.approx(r["quality"], abs=2e-6) and got[r["entity"]]["size"] == (None if r["size"] is None else pytest.approx(r["size"], abs=2e-6))
