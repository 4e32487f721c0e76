"""The sources that a refresh knows: how each is read, how often, and what a good scan of it looks like."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers


@dataclass(frozen=True)
class Source:
    id: str
    kind: str = "parquet"
    cadence_h: float = 24.0
    least: int = 1
    most: int = 10**12
    required: tuple[str, ...] = field(default=())


SOURCES = [
    Source("region", cadence_h=720, least=5, most=5, required=("r_regionkey", "r_name")), Source("nation", cadence_h=720, least=25, most=25, required=("n_nationkey", "n_regionkey")),
    Source("customer", required=("c_custkey",)), Source("orders", cadence_h=6, least=10**4, required=("o_orderkey", "o_custkey")), Source("lineitem", cadence_h=6, required=("l_orderkey",)),
    Source("part", required=("p_partkey",)), Source("supplier", required=("s_suppkey",)), Source("events", cadence_h=0.5, required=("event_id", "ts")), Source("pages", cadence_h=12, required=("page_id", "html")),
    Source("benchmark", least=100), Source("labels", required=("doc_id",)), Source("conversations", required=("conv_id", "turn")), Source("embeddings", required=("vec_id",)), Source("documents", required=("doc_id", "text")),
]

#: Readers by kind: each takes the session and a path.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.option("multiLine", True).json(path),
    "csv": lambda spark, path: readers.keyed_csv(spark, path),
    "geojson": readers.geo_features,
    "binary": readers.manifest,
}


def read(spark: SparkSession, source: Source, path: str) -> DataFrame:
    """A source's rows by its kind's reader; a missing required field is an error before anything is counted or written."""
    rows = READERS[source.kind](spark, path)
    lacking = [c for c in source.required if c not in rows.columns]
    if lacking:
        raise ValueError(f"{source.id} lacks {lacking}")
    return rows


def verified(rows: DataFrame, source: Source) -> DataFrame:
    """rows, or an error if their number is out of bounds: nothing is done with them before that."""
    n = rows.count()
    if not source.least <= n <= source.most:
        raise ValueError(f"{source.id} has {n} rows, not {source.least} to {source.most}")
    return rows


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """id, kind, n, verified of every source: counts come from the files' own metadata where the format has it."""
    out = None
    for s in SOURCES:
        n = F.count(F.lit(1))
        row = read(spark, s, f"{folder}/{s.id}.parquet").agg(F.lit(s.id).alias("id"), F.lit(s.kind).alias("kind"), n.alias("n"), n.between(s.least, s.most).alias("verified"))
        out = row if out is None else out.unionByName(row)
    return out
