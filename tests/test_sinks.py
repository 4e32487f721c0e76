"""Writers and the source registry: what is refused, what is halved, what is whole."""

import pytest
from pyspark.sql import functions as F

from corvane import sinks
from corvane.sources import registry


def test_land_is_whole_and_never_overwrites(spark, tmp_path):
    rows = spark.range(50)
    sinks.land(rows, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 50
    with pytest.raises(FileExistsError):
        sinks.land(rows, str(tmp_path / "a"))
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_publish_needs_budget_and_confirmation(spark, tmp_path):
    rows, path = spark.range(10), str(tmp_path / "p")
    with pytest.raises(ValueError, match="only 5 writes"):
        sinks.publish(rows, path, budget=15, used=10, confirm=True)
    assert sinks.publish(rows, path, budget=15) == 10 and not (tmp_path / "p").exists()
    assert sinks.publish(rows, path, budget=15, confirm=True) == 10 and spark.read.parquet(path).count() == 10


def test_batches_are_halved(spark, tmp_path):
    folder = str(tmp_path)

    def commit(batch):
        import uuid

        if len(batch) > 7:
            raise ValueError("too big")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(str(r["id"]) for r in batch))

    sinks.commit_in_halves(spark.range(0, 100, 1, 3), commit, size=20)
    parts = [p.read_text().split() for p in tmp_path.iterdir()]
    assert max(map(len, parts)) <= 7 and sorted(int(x) for p in parts for x in p) == list(range(100))


def test_csv_and_json_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("7", 'say "hi", you', 1.23456789), ("1234", None, float("nan"))], "code string, note string, x double")
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = {r["code"]: r["note"] for r in registry.READERS["csv"](spark, str(tmp_path / "c")).collect()}
    assert back == {"007": 'say "hi", you', "1234": None}
    sinks.write_json(rows, str(tmp_path / "j"))
    assert {r["code"]: r["x"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"7": 1.234568, "1234": None}


def test_registry_refuses(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit(1)).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="lacks"):
        registry.read(spark, registry.Source("t", required=("b",)), str(tmp_path / "t"))
    rows = registry.read(spark, registry.Source("t", required=("a",)), str(tmp_path / "t"))
    assert registry.verified(rows, registry.Source("t", least=3, most=3)).count() == 3
    with pytest.raises(ValueError, match="has 3 rows"):
        registry.verified(rows, registry.Source("t", least=4))
