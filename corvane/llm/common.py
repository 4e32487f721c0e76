"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of this process (tests) gets one temp folder; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = local_folder()
    return where.rstrip("/")


@lru_cache(maxsize=1)
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="corvane-")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again, so that a lost executor costs a re-read only."""
    path = f"{shared_dir(df.sparkSession)}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for tables that nothing reads any more, and have Spark's cleaner drop finished plans' shuffle files now."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    tables[0].sparkSession._jvm.System.gc()


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text (null: empty). (doc_id, text_key) tells rows apart even where a doc_id repeats with another text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))


def with_new_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct `row`, with the new `text` in place and n_chars following it."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array without nulls as (all bytes, int64 offsets), without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), at


def texts_in_blocks(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a batch's rows of about `limit` bytes at most (one row at least), as (first, last, bytes, offsets)."""
    data, at = byte_column(batch.column("text"))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit)) - 1)
        yield first, last, data, at[first : last + 1]
        first = last


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from Python lists or numpy arrays, in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
