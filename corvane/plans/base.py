"""The query registry, the input tables, and the entity x indicator matrix that index queries start from."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix
from ..operators.ranks import reused

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Tables that the query at work has made so far, by name and input folder.
_MADE: ContextVar[dict | None] = ContextVar("made", default=None)


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL if it has one. Tables marked `once` are made once for the outermost query that asks for them."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if _MADE.get() is not None:
                return f(spark, sf_dir)
            token = _MADE.set({})
            try:
                return f(spark, sf_dir)
            finally:
                _MADE.reset(token)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def once(f):
    """A table that many steps of a query read: made at the first call within the query, shared by the others."""

    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _MADE.get()
        if made is None:
            return f(spark, sf_dir)
        key = (f.__module__, f.__name__, sf_dir)
        if key not in made:
            made[key] = f(spark, sf_dir)
        return made[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INDICATORS = ["discount", "tax", "quantity", "return_share", "return_qty", "urgent_price", "urgent_p", "delta", "n_orders"]
#: indicator, pillar, direction
TREE = [
    ("return_share", "returns", -1), ("return_qty", "returns", -1), ("quantity", "returns", 1), ("discount", "pricing", -1), ("tax", "pricing", 1),
    ("urgent_price", "demand", 1), ("n_orders", "demand", 1), ("urgent_p", "momentum", 1), ("delta", "momentum", 1),
]
PILLARS = ["returns", "pricing", "demand"]
WEIGHTS = {"returns": 0.5, "pricing": 0.3, "demand": 0.2}


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "indicator string, pillar string, direction int")


@once
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer: entity, grp (nation), spend, urgent_share and the indicators; each fact table is read and shuffled once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    price, urgent = F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT"
    in_year = lambda y: F.avg(F.when(F.year("o_orderdate") == y, price))
    by_order = orders.groupBy("entity").agg(
        F.round(F.sum(price), 4).alias("spend"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(100 * F.sum(F.when(urgent, price).otherwise(0.0)) / F.sum(price), 6).alias("urgent_share"),
        F.round(F.avg(F.when(urgent, price)), 8).alias("urgent_price"), F.round(F.avg(F.when(urgent & (F.col("o_orderstatus") == "P"), price)), 8).alias("urgent_p"),
        F.round(in_year(2000) - in_year(1996), 8).alias("delta"),
    )
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("back"))
    qty, back = F.col("l_quantity"), F.col("back")
    by_item = items.join(orders.select("o_orderkey", "entity").hint("shuffle_hash"), "o_orderkey").groupBy("entity").agg(
        F.round(F.avg("l_discount"), 9).alias("discount"), F.round(F.avg("l_tax"), 9).alias("tax"), F.round(F.avg(qty), 9).alias("quantity"),
        F.round(F.sum(F.when(back, qty).otherwise(0.0)) / F.sum(qty), 9).alias("return_share"), F.round(F.avg(F.when(back, qty)), 9).alias("return_qty"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("balance"))
    return reused(customers.join(by_order, "entity", "left").join(by_item, "entity", "left").select("entity", "grp", "balance", "spend", "urgent_share", *INDICATORS))


@once
def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.to_long(features(spark, sf_dir), ["entity", "grp"], INDICATORS)


@once
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of indicators with enough coverage, unpivoted from the columns of those alone."""
    found = {r["indicator"] for r in matrix.coverage(long_features(spark, sf_dir)).where("coverage >= 0.8").collect()}
    names = [i for i in INDICATORS if i in found]
    return matrix.to_long(features(spark, sf_dir), ["entity", "grp"], names) if names else long_features(spark, sf_dir).where(F.lit(False))


@once
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reused(matrix.impute(gated(spark, sf_dir)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


FEAT = """
WITH oa AS (SELECT o_custkey AS entity, round(sum(o_totalprice), 4) AS spend, CAST(count(*) AS DOUBLE) AS n_orders,
  round(100 * sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS urgent_share,
  round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 8) AS urgent_price,
  round(avg(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_totalprice END), 8) AS urgent_p,
  round(avg(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END) - avg(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END), 8) AS delta
  FROM orders GROUP BY 1),
la AS (SELECT o_custkey AS entity, round(avg(l_discount), 9) AS discount, round(avg(l_tax), 9) AS tax, round(avg(l_quantity), 9) AS quantity,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS return_share,
  round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 9) AS return_qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
feat AS (SELECT c_custkey AS entity, c_nationkey AS grp, c_acctbal AS balance, oa.* EXCLUDE (entity), la.* EXCLUDE (entity) FROM customer LEFT JOIN oa ON c_custkey = oa.entity LEFT JOIN la ON c_custkey = la.entity)
"""
LONG = FEAT + ", long AS (" + " UNION ALL ".join(f"SELECT entity, grp, '{i}' AS indicator, {i} AS value FROM feat" for i in INDICATORS) + ")"
TREE_SQL = ", tree AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{p}', {d})" for i, p, d in TREE) + ") t(indicator, pillar, direction))"
KEPT = LONG + TREE_SQL + """,
cov AS (SELECT indicator, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM long GROUP BY 1),
kept AS (SELECT long.* FROM long JOIN cov USING (indicator) WHERE coverage >= 0.8)"""
IMPUTED = KEPT + """,
gm AS (SELECT grp, indicator, median(value) AS g FROM kept GROUP BY ALL),
f1 AS (SELECT kept.*, g, coalesce(value, g) AS f FROM kept JOIN gm USING (grp, indicator)),
nm AS (SELECT indicator, median(f) AS m FROM f1 GROUP BY 1),
imp AS (SELECT entity, grp, indicator, coalesce(f, m) AS value,
  CASE WHEN value IS NOT NULL THEN 'observed' WHEN g IS NOT NULL THEN 'group_median' WHEN m IS NOT NULL THEN 'overall_median' END AS provenance FROM f1 JOIN nm USING (indicator))"""


def pct_rank_sql(x: str, by: str = "") -> str:
    """SQL of the average rank over the count of non-null values."""
    part, more = (f"PARTITION BY {by}", f", {by}") if by else ("", "")
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}{more}) - 1) / 2.0) / count({x}) OVER ({part}) END)"


PILLAR = IMPUTED + f""",
norm AS (SELECT entity, grp, indicator, pillar, 100 * CASE WHEN direction < 0 THEN 1 - r ELSE r END AS score
  FROM (SELECT *, {pct_rank_sql('value', 'indicator')} AS r FROM imp) JOIN tree USING (indicator)),
pil AS (SELECT entity, pillar, avg(score) AS score FROM norm GROUP BY ALL),
blk AS (SELECT entity, pillar, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM kept JOIN tree USING (indicator) GROUP BY ALL)"""
_W = " ".join(f"WHEN '{p}' THEN {w}" for p, w in WEIGHTS.items())
INDEX = PILLAR + f""",
live AS (SELECT pil.entity, pil.pillar, coalesce(score, 0) AS score, CASE WHEN missing_share > 1.0 / 3 THEN 0 ELSE CASE pil.pillar {_W} END END AS w FROM pil JOIN blk USING (entity, pillar)),
qual AS (SELECT entity, CASE WHEN sum(w) > 0 THEN sum(w * score) / sum(w) ELSE sum(score) / {len(PILLARS)} END AS quality FROM live GROUP BY 1),
siz AS (SELECT entity, grp, spend, delta, 75 * {pct_rank_sql('spend')} + 25 * {pct_rank_sql('urgent_share')} AS size FROM feat),
score AS (SELECT entity, grp, spend, delta, round(size, 6) AS size, round(quality, 6) AS quality,
  round(100 * pow(greatest(least(size, 100.0), 1.0) / 100, 0.5) * pow(greatest(least(quality, 100.0), 1.0) / 100, 0.5), 6) AS overall FROM siz JOIN qual USING (entity))"""
