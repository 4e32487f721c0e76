"""Writers: artefacts, staged landing, guarded and halved writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import json_number


def write_csv(rows: DataFrame, path: str) -> None:
    """Parts with a header, RFC quoting, empty for null."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)


def write_json(rows: DataFrame, path: str, digits: int = 6) -> None:
    """One object a line; doubles rounded, NaN and infinities as null."""
    clean = [json_number(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in rows.schema]
    rows.select(*clean).write.option("ignoreNullFields", False).json(path)


def write_split(rows: DataFrame, key: str, path: str) -> DataFrame:
    """A folder of JSON lines for each value of `key`, and their index: key, n. A hot key is written by as many tasks as hold its rows."""
    rows.write.partitionBy(key).option("ignoreNullFields", False).json(path)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def land(rows: DataFrame, path: str) -> None:
    """Written beside its place and renamed once it is whole: a reader never sees half of it, and what is there is never overwritten."""
    spark = rows.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(make(path)) or not files.rename(make(staged), make(path)):
        files.delete(make(staged), True)
        raise FileExistsError(path)


def publish(rows: DataFrame, path: str, budget: int, used: int = 0, confirm: bool = False) -> int:
    """How many rows a publish would write. Only with confirm are they written, and all are refused if they pass what the day's budget has left."""
    n = rows.count()
    if n > budget - used:
        raise ValueError(f"{n} rows, but only {budget - used} writes are left today")
    if confirm:
        land(rows, path)
    return n


def commit_in_halves(rows: DataFrame, commit: Callable[[list], None], size: int = 300, too_big: type[Exception] = ValueError) -> None:
    """Each partition's rows go to `commit` in batches of `size`; a batch that it refuses as too big is halved, down to one row."""

    def send(batch: list) -> None:
        try:
            commit(batch)
        except too_big:
            if len(batch) == 1:
                raise
            send(batch[: len(batch) // 2])
            send(batch[len(batch) // 2 :])

    def run(part: Iterator) -> None:
        batch: list = []
        for row in part:
            batch.append(row)
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    rows.foreachPartition(run)


def fitting_batches(batches: DataFrame, day: str, order: str, n: str, budget: int) -> DataFrame:
    """batches with `used` (writes of the day before this batch) and `allowed`: a batch that would pass the day's budget is refused whole.

    A day's batches are few: one for each source and cycle.
    """
    from pyspark.sql import Window

    run = Window.partitionBy(day).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(n).over(run), F.lit(0))
    return batches.withColumn("used", used).withColumn("allowed", F.col("used") + F.col(n) <= budget)


def snapshot_state(spark: SparkSession, rows: DataFrame, folder: str, version: int) -> str:
    """A state table's next version in a folder of its own: readers take the largest number, so a failed write harms nothing."""
    path = f"{folder}/v={version}"
    land(rows, path)
    return path
