"""Ring simplification against the recursive rule, split writes, first events of a stream, and the polling loop."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from corvane import sinks
from corvane.operators import shapes
from corvane.streaming import jobs


def recursive(points, tolerance):
    """Splits at the farthest point of the chord while it is farther than the tolerance."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    length = math.hypot(bx - ax, by - ay)
    far = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length else math.hypot(x - ax, y - ay) for x, y in points[1:-1]]
    i = max(range(len(far)), key=far.__getitem__)
    if far[i] <= tolerance:
        return [points[0], points[-1]]
    return recursive(points[: i + 2], tolerance)[:-1] + recursive(points[i + 1 :], tolerance)


def test_simplify_like_the_recursive_rule(spark):
    rng = random.Random(5)
    rings = [[[round(rng.uniform(0, 9), 3), round(rng.uniform(0, 9), 3)] for _ in range(n)] for n in (3, 4, 10, 60)]
    rows = [(i, [*r, r[0]]) for i, r in enumerate(rings)] + [(90, [[1.0, 1.0]] * 4), (91, []), (92, None)]
    frame = spark.createDataFrame(rows, "id int, ring array<array<double>>").repartition(3)
    for tolerance in (0.0, 1.0, 3.0, 50.0):
        got = {r["id"]: r["simplified"] for r in shapes.simplify(frame, [tolerance], 0).collect()}
        for i, ring in rows[:4]:
            assert got[i] == recursive(ring, tolerance)
        assert got[90] == [[1.0, 1.0]] * 2 and got[91] == [] and got[92] is None
    sizes = {t: sum(len(recursive(r, t)) for _, r in rows[:4]) + 2 for t in (0.5, 1.0, 2.0, 4.0)}
    cap = sizes[2.0]
    told = shapes.simplify(frame, list(sizes), cap).first()["tolerance"]
    assert told == min(t for t, n in sizes.items() if n <= cap)
    assert shapes.simplify(frame.limit(0), [1.0], 5).count() == 0


def test_placeholders_and_closing(spark):
    rows = [(1, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), (2, [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]), (3, [[0.0, 0.0], [1.0, 1.0]]), (4, [])]
    made = spark.createDataFrame(rows, "id int, ring array<array<double>>").withColumn("ring", shapes.closed(F.col("ring")))
    assert [(r["id"], len(r["ring"])) for r in shapes.without_placeholders(made).collect()] == [(1, 4)]


def test_split_files_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], None) for i in range(9)], "id int, state string, x double")
    index = {r["state"]: r["n"] for r in sinks.write_split(rows, "state", str(tmp_path / "out")).collect()}
    assert index == {"a": 6, "b": 3}
    assert {k: spark.read.json(str(tmp_path / f"out/state={k}")).count() for k in index} == index


def _events(spark, folder, rows):
    spark.createDataFrame([(k, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()) for k, h in rows], "key int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_first_seen(spark, tmp_path):
    source = str(tmp_path / "in")
    _events(spark, source, [(1, 0), (2, 1), (1, 2), (3, 3), (2, 3)])
    stream = jobs.event_stream(spark, source, "key int, ts timestamp", "100 hours")
    out = jobs.drain(jobs.first_seen(stream, ["key"]), "first_seen", "append", str(tmp_path / "c"))
    assert sorted(r["key"] for r in out.collect()) == [1, 2, 3]


def test_polling_loop(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark, source, [(1, 0)])
    loop = jobs.poll(spark.readStream.schema("key int, ts timestamp").parquet(source), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c"), "1 second")
    loop.processAllAvailable()
    _events(spark, source, [(2, 1)])
    loop.processAllAvailable()
    loop.stop()
    assert not loop.isActive and sorted(r["key"] for r in spark.read.parquet(out).collect()) == [1, 2]
