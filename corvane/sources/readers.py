"""Readers and landing: paged JSON, HTML cells, parallel arrays, GeoJSON, manifests, optional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import zero_padded


def paged_records(spark: SparkSession, path: str, schema: T.StructType, one_a_file: bool = True) -> DataFrame:
    """Records of a folder of pages {"result": {"total": n, "records": [...]}}, one page a file or a line; .gz pages are read as they are. Codes stay strings."""
    page = T.StructType([T.StructField("result", T.StructType([T.StructField("total", T.LongType()), T.StructField("records", T.ArrayType(schema))]))])
    return spark.read.schema(page).option("multiLine", one_a_file).json(path).select(F.explode("result.records").alias("r")).select("r.*")


def missing_pages(present: DataFrame, total: int, per_page: int) -> DataFrame:
    """page numbers (from 0) that a scan of `total` rows still lacks; present has `page`. A resumed scan reads these only."""
    pages = present.sparkSession.range(-(-total // per_page)).select(F.col("id").alias("page"))
    return pages.join(present.select("page"), "page", "left_anti")


def aligned(**arrays: Column) -> Column:
    """One array of structs from parallel arrays; arrays of unequal length are an error."""
    first, *rest = arrays.values()
    same = F.lit(True)
    for other in rest:
        same = same & (F.size(first) == F.size(other))
    return F.when(same, F.arrays_zip(*(c.alias(n) for n, c in arrays.items()))).otherwise(F.raise_error(F.lit("parallel arrays differ in length")).cast("void"))


def html_cells(html: Column | str, tag: str = "p") -> Column:
    """The texts of all cells of one kind, tags stripped and blanks collapsed."""
    x = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")))


def geo_features(spark: SparkSession, path: str) -> DataFrame:
    """name, type, coordinates (JSON) of each feature of a GeoJSON file."""
    shape = "features array<struct<properties: struct<shapeName: string>, geometry: struct<type: string, coordinates: string>>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select(
        F.col("f.properties.shapeName").alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")
    )


def keyed_csv(spark: SparkSession, path: str, width: int = 3) -> DataFrame:
    """A CSV file or folder (gzip or not) with all columns as text; the first is the key, a code that is padded again to its width."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn(rows.columns[0], zero_padded(rows.columns[0], width))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def optional_table(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """The table and whether it is there; an empty one of the same schema where it is not. A table without a needed column is an error."""
    from pyspark.errors import AnalysisException

    want = T.StructType.fromDDL(schema)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], want), False
    lacking = [f.name for f in want if f.name not in found.columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    return found.select(*(F.col(f.name).cast(f.dataType) for f in want)), True


def ordered_digest(rows: DataFrame, key: str, order: str, content: str, bits: int = 8, levels: int | None = None) -> DataFrame:
    """<key>, digest: one hash of each key's rows in the order of `order` (whole numbers), as a tree over ranges of it.

    A leaf hashes the rows whose order lies in one range of 2^bits numbers, a node 2^bits ranges, and so on to the root. Ranges are fixed by the numbers, so neither partitioning nor
    the order of arrival changes a digest, and a changed row changes only the nodes above it. Rows of one number are taken in the order of their hashes. No key's rows
    are gathered, only one range's. A null content differs from an empty one; rows without key or order are left out. With `levels` the tree has that many levels whatever the
    numbers: the root then takes all nodes below it, one for each range in which the key has rows.
    """
    own = F.sha2(F.coalesce(F.concat(F.lit("="), F.col(content).cast("string")), F.lit("-")), 256)
    level = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, F.col(order).cast("long").alias("_o"), own.alias("_h"))
    if levels is None:
        most = level.agg(F.max(F.when(F.col("_o") < 0, F.lit(64)).otherwise(F.length(F.bin("_o"))))).first()[0] or 1  # bits of the largest number
        steps = [bits] * max(1, -(-most // bits))
    else:
        steps = [bits] * (levels - 1) + [64]
    for shift in steps:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda r: F.concat(r["_o"].cast("string"), F.lit(":"), r["_h"]))
        level = level.groupBy(key, (F.shiftrightunsigned("_o", shift) if shift < 64 else F.lit(0).cast("long")).alias("_up")).agg(F.sha2(F.array_join(listed, ","), 256).alias("_h")).withColumnRenamed("_up", "_o")
    return level.select(key, F.col("_h").alias("digest"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and a hash that does not depend on the rows' order; each row's hash is summed, so nothing is gathered."""
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_hash"))
