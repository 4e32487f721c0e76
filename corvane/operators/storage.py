"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temp folder where executors are threads of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='corvane-')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as Parquet in a shared folder, read again: the plan starts there, and a lost executor costs a re-read."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, order: list[str], rows: int) -> list[str]:
    """df as Parquet files of at most `rows` rows, in order (not sorted where `order` is empty): for tasks that read a whole table from end to end, file by file and column by column, which Spark could only give
    them as a copy a task. The folder has to be one that pyarrow can open."""
    path = shared_folder(df.sparkSession, "blocks")
    (df.orderBy(*order) if order else df).write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles(), key=lambda f: [int(x) for x in re.search(r"part-(\d+)-.*?c(\d+)\.[^/]*$", f).groups()])


def _opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def block(path: str, columns: list[str]) -> list[np.ndarray]:
    """Columns of one of those files; nulls of numbers are NaN."""
    from pyarrow import parquet

    with _opened(path) as file:
        found = parquet.ParquetFile(file).read(columns=columns)
    return [found.column(c).to_numpy() for c in columns]


def lengths(paths: list[str]) -> list[int]:
    """Rows of each of those files, from their footers."""
    from pyarrow import parquet

    out = []
    for path in paths:
        with _opened(path) as file:
            out.append(parquet.ParquetFile(file).metadata.num_rows)
    return out
