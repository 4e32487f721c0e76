"""Index queries: normalisers, imputation, pillars, size and quality, ranks, tiers and outlook."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matrix, ranks
from ..operators.order_statistics import medians, quantiles
from .base import FEAT, IMPUTED, INDEX, INDICATORS, KEPT, LONG, PILLAR, PILLARS, TREE_SQL, WEIGHTS, features, gated, imputed, once, long_features, pct_rank_sql, query, reused, rounded, table, tree


def _normalised(spark, sf_dir, method: str) -> DataFrame:
    rows = long_features(spark, sf_dir).join(tree(spark), "indicator")
    return rounded(matrix.NORMALISERS[method](rows, F.col("direction")).select("entity", "indicator", "score"), "score")


@query(LONG + TREE_SQL + f" SELECT entity, indicator, round(100 * CASE WHEN direction < 0 THEN 1 - r ELSE r END, 6) AS score FROM (SELECT *, {pct_rank_sql('value', 'indicator')} AS r FROM long) JOIN tree USING (indicator)")
def norm_pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "rank")


@query(LONG + TREE_SQL + """ SELECT entity, indicator, round(CASE WHEN direction < 0 THEN 100 - x ELSE x END, 6) AS score FROM (SELECT l.*, CASE WHEN z > a THEN 100 * (value - a) / (z - a) WHEN value IS NOT NULL THEN 50.0 END AS x
  FROM long l JOIN (SELECT indicator, min(value) AS a, max(value) AS z FROM long GROUP BY 1) USING (indicator)) JOIN tree USING (indicator)""")
def norm_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "minmax")


@query(LONG + TREE_SQL + """ SELECT entity, indicator, round(50 + direction * 10 * (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS score
  FROM long JOIN (SELECT indicator, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1) USING (indicator) JOIN tree USING (indicator)""")
def norm_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "z")


@query(LONG + " SELECT indicator, round(avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8 AS kept FROM long GROUP BY 1")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.coverage(long_features(spark, sf_dir)).select("indicator", F.round("coverage", 6).alias("coverage"), (F.col("coverage") >= 0.8).alias("kept"))


_FLAGS = [("l_discount", 0.0), ("l_tax", 0.0)]


@query("""WITH t AS (SELECT l_returnflag || '|' || l_linestatus || '|discount' AS indicator, CASE WHEN l_discount < 0.095 THEN 0.0 ELSE l_discount END AS value FROM lineitem
  UNION ALL SELECT l_returnflag || '|' || l_linestatus || '|tax', l_tax FROM lineitem)
SELECT indicator, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM t WHERE value IS NOT NULL GROUP BY 1 HAVING avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) >= 0.9""")
def sentinel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = lambda what: F.concat_ws("|", "l_returnflag", "l_linestatus", F.lit(what)).alias("indicator")
    rows = li.select(key("discount"), F.when(F.col("l_discount") < 0.095, 0.0).otherwise(F.col("l_discount")).alias("value")).unionByName(li.select(key("tax"), F.col("l_tax").alias("value")))
    return rounded(matrix.sentinels(rows), "zero_share")


@query(IMPUTED + " SELECT entity, indicator, round(value, 6) AS value, provenance FROM imp")
def impute_state_then_nat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imputed(spark, sf_dir).select("entity", "indicator", "value", "provenance"), "value")


@query(KEPT + " SELECT entity, indicator, round(coalesce(value, m), 6) AS value FROM kept JOIN (SELECT indicator, median(value) AS m FROM kept GROUP BY 1) USING (indicator)")
def impute_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.impute_overall(gated(spark, sf_dir)).select("entity", "indicator", "value"), "value")


@query(KEPT + " SELECT entity, indicator, round(value, 6) AS value FROM kept WHERE entity NOT IN (SELECT entity FROM kept WHERE value IS NULL)")
def impute_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.listwise(gated(spark, sf_dir)).select("entity", "indicator", "value"), "value")


@query(KEPT + """, st AS (SELECT indicator, avg(value) AS m, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS s FROM kept GROUP BY 1),
z AS (SELECT entity, grp, indicator, (value - m) / s AS z FROM kept JOIN st USING (indicator) WHERE value IS NOT NULL),
lack AS (SELECT DISTINCT entity FROM kept WHERE value IS NULL), p AS (SELECT count(DISTINCT indicator) AS p FROM kept),
near AS (SELECT a.entity, b.entity AS donor, sqrt(sum(pow(a.z - b.z, 2)) / count(*) * (SELECT p FROM p)) AS d FROM z a JOIN lack USING (entity) JOIN z b ON a.indicator = b.indicator AND a.entity <> b.entity GROUP BY ALL),
best AS (SELECT g.entity, g.indicator, k.value, row_number() OVER (PARTITION BY g.entity, g.indicator ORDER BY d, donor) AS r FROM kept g JOIN near n USING (entity) JOIN kept k ON k.entity = n.donor AND k.indicator = g.indicator WHERE g.value IS NULL AND k.value IS NOT NULL),
fill AS (SELECT entity, indicator, avg(value) AS k FROM best WHERE r <= 5 GROUP BY ALL), md AS (SELECT indicator, median(value) AS m FROM kept GROUP BY 1)
SELECT entity, indicator, round(coalesce(value, k, m), 6) AS value FROM kept LEFT JOIN fill USING (entity, indicator) JOIN md USING (indicator)""")
def knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.impute_neighbours(gated(spark, sf_dir)).select("entity", "indicator", "value"), "value")


@query(IMPUTED + " SELECT indicator, provenance, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM imp), 6) AS pct FROM imp GROUP BY ALL")
def imputation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imputed(spark, sf_dir)
    return rows.groupBy("indicator", "provenance").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / rows.agg(F.count(F.lit(1))).scalar(), 6))


@query(PILLAR + " SELECT entity, pillar, round(missing_share, 6) AS missing_share, missing_share > 1.0 / 3 AS blocked FROM blk")
def pillar_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.blocked(gated(spark, sf_dir), tree(spark)), "missing_share")


@query(PILLAR + " SELECT entity, pillar, round(score, 6) AS score FROM pil")
def pillar_mean_skipnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.pillars(imputed(spark, sf_dir), tree(spark)).select("entity", "pillar", "score"), "score")


def quality(spark: SparkSession, sf_dir: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """entity, quality, and each pillar's score and blocked flag."""
    cells = matrix.normalised(imputed(spark, sf_dir), tree(spark)).withColumn("missing", ~F.col("provenance").eqNullSafe("observed"))
    return matrix.pillar_columns(cells, PILLARS).withColumn("quality", _weighed(weights))


def _weighed(weights: dict[str, float]) -> Column:
    return C.blocked_mean([(f"{p}_p", f"{p}_b", weights[p]) for p in PILLARS])


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, grp, spend, delta, size: three quarters spend rank, one quarter urgent share rank."""
    rows = features(spark, sf_dir).select("entity", "grp", "spend", "urgent_share", "delta")
    long = matrix.to_long(rows, ["entity"], ["spend", "urgent_share"])
    wide = matrix.to_wide(ranks.percent_ranks(long, ["indicator"]), ["entity"], ["spend", "urgent_share"], "score")
    return rows.drop("urgent_share").join(wide.select("entity", (0.75 * F.col("spend") + 0.25 * F.col("urgent_share")).alias("size")), "entity")


_SIZES = ["spend", "urgent_share"]


@once
def ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, indicator, pillar, direction, value, missing, rank, n and score of the filled cells, and of the two parts of size (each a pillar by its own name, `missing` null): all ranked in one call."""
    shape = tree(spark).unionByName(spark.createDataFrame([(c, c, 1) for c in _SIZES], "indicator string, pillar string, direction int"))
    cells = imputed(spark, sf_dir).select("entity", "indicator", "value", (~F.col("provenance").eqNullSafe("observed")).alias("missing"))
    cells = cells.unionByName(matrix.to_long(features(spark, sf_dir), ["entity"], _SIZES).withColumn("missing", F.lit(None).cast("boolean")))
    found = ranks.average_ranks(cells.join(F.broadcast(shape), "indicator"), ["indicator"])
    r = F.col("rank") / F.col("n")
    return found.withColumn("score", 100 * F.when(F.col("direction") < 0, 1 - r).otherwise(r))


def assembled(spark: SparkSession, sf_dir: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """entity, size, quality, each pillar's score and blocked flag, and `also`, aggregates of an entity's ranked cells: all meet in one shuffle by entity."""
    part = lambda c: F.max(F.when(F.col("pillar") == c, F.col("score")))
    wide = matrix.pillar_columns(ranked_cells(spark, sf_dir), PILLARS, also=(*(part(c).alias(f"{c}_r") for c in _SIZES), F.count("missing").alias("cells"), *also)).where("cells > 0")
    return wide.withColumns({"size": 0.75 * F.col("spend_r") + 0.25 * F.col("urgent_share_r"), "quality": _weighed(WEIGHTS)}).drop("cells", *(f"{c}_r" for c in _SIZES))


@once
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, grp, spend, delta, size, quality, overall."""
    both = features(spark, sf_dir).select("entity", "grp", "spend", "delta").join(assembled(spark, sf_dir).select("entity", "size", "quality"), "entity")
    return reused(rounded(both.withColumn("overall", C.geometric("size", "quality", 0.5)), "size", "quality", "overall"))


@query(INDEX + " SELECT entity, round(quality, 6) AS quality FROM qual")
def quality_blocked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality(spark, sf_dir).select("entity", "quality"), "quality")


@query(INDEX + " SELECT entity, size, quality, overall FROM score")
def index_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("entity", "size", "quality", "overall")


@query(INDEX + " SELECT entity, round(0.5 * size + 0.5 * quality, 7) AS arithmetic FROM score")
def index_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("entity", F.round(0.5 * F.col("size") + 0.5 * F.col("quality"), 7).alias("arithmetic"))


_RANKED = INDEX + f""", rk AS (SELECT *, CAST(floor(rank() OVER (ORDER BY overall DESC) + (count(*) OVER (PARTITION BY overall) - 1) / 2.0) AS BIGINT) AS rank_overall FROM score),
edges AS (SELECT quantile_cont(overall, 0.25) AS q1, quantile_cont(overall, 0.5) AS q2, quantile_cont(overall, 0.75) AS q3 FROM score),
gap AS (SELECT rk.*, CASE WHEN overall <= q1 THEN 'D' WHEN overall <= q2 THEN 'C' WHEN overall <= q3 THEN 'B' ELSE 'A' END AS tier,
  round({pct_rank_sql('delta')} - {pct_rank_sql('overall')}, 6) AS growth_gap, coalesce(delta > (SELECT quantile_cont(delta, 0.75) FROM score) AND rank_overall > 100, false) AS growth_flag FROM rk, edges)"""


@once
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() with rank_overall (1 is best, average ties truncated), tier, growth_gap, growth_flag."""
    rows = scored(spark, sf_dir)
    found = {r["indicator"]: r["quantiles"] for r in quantiles(matrix.to_long(rows, [], ["overall", "delta"]), ["indicator"], "value", [0.25, 0.5, 0.75]).collect()}
    edges, hot = (F.array(*(F.lit(q).cast("double") for q in found.get(c, [None] * 3))) for c in ("overall", "delta"))
    out = ranks.average_ranks(rows.withColumns({"tier": C.tier("overall", edges), "_hot": F.col("delta") > hot[2]}), [], "overall")
    out = reused(out.withColumns({"rank_overall": F.floor(F.col("n") + 1 - F.col("rank")).cast("long"), "_overall": 100 * (F.col("rank") / F.col("n"))}).drop("rank", "n"))
    out = ranks.percent_ranks(out, [], "delta").withColumn("growth_gap", F.round((F.col("score") - F.col("_overall")) / 100, 6))
    return out.withColumn("growth_flag", F.coalesce(F.col("_hot") & (F.col("rank_overall") > 100), F.lit(False))).drop("score", "_overall", "_hot")


@query(_RANKED + " SELECT entity, rank_overall, tier FROM gap")
def rank_and_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("entity", "rank_overall", "tier")


@query(_RANKED + " SELECT entity, growth_gap, growth_flag FROM gap")
def growth_gap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("entity", "growth_gap", "growth_flag")


@query(INDEX + f""", fut AS (SELECT entity, overall, size, quality, size * (0.9 + 0.4 * coalesce({pct_rank_sql('delta')}, 0)) AS grown FROM score)
SELECT entity, overall AS current, round(100 * pow(greatest(least(100 * {pct_rank_sql('grown')}, 100.0), 1.0) / 100, 0.45) * pow(greatest(least(quality, 100.0), 1.0) / 100, 0.55), 5) AS future FROM fut""")
def index_current_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current index, and the outlook: size grown by the rank of momentum and ranked anew, with more weight on quality."""
    rows = ranks.percent_ranks(scored(spark, sf_dir).select("entity", "overall", "size", "quality", "delta"), [], "delta").withColumnRenamed("score", "_m")
    rows = rows.withColumn("grown", F.col("size") * (0.9 + 0.4 * F.coalesce("_m", F.lit(0.0)) / 100))
    rows = ranks.percent_ranks(rows, [], "grown")
    return rows.select("entity", F.col("overall").alias("current"), F.round(C.geometric("score", "quality", 0.45), 5).alias("future"))


@query(FEAT + f""", pool AS (SELECT entity, spend * discount / 100 AS acute, spend * (discount + tax) / 2 / 100 * 0.7 AS chronic, urgent_share FROM feat)
SELECT entity, round(75 * {pct_rank_sql('acute')} + 25 * {pct_rank_sql('urgent_share')}, 6) AS size_acute, round(75 * {pct_rank_sql('chronic')} + 25 * {pct_rank_sql('urgent_share')}, 6) AS size_chronic FROM pool""")
def index_therapy_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size over a narrower pool: spend times a rate, with and without the adult share."""
    rows = features(spark, sf_dir).select("entity", (F.col("spend") * F.col("discount") / 100).alias("acute"), (F.col("spend") * (F.col("discount") + F.col("tax")) / 2 / 100 * 0.7).alias("chronic"), "urgent_share")
    long = ranks.percent_ranks(matrix.to_long(rows, ["entity"], ["acute", "chronic", "urgent_share"]), ["indicator"])
    wide = matrix.to_wide(long, ["entity"], ["acute", "chronic", "urgent_share"], "score")
    size = lambda c: F.round(0.75 * F.col(c) + 0.25 * F.col("urgent_share"), 6).alias(f"size_{c}")
    return wide.select("entity", size("acute"), size("chronic"))


@query(PILLAR + """, w AS (SELECT pillar, CASE pillar WHEN 'returns' THEN 0.5 WHEN 'pricing' THEN 0.3 ELSE 0.2 END AS w FROM (SELECT DISTINCT pillar FROM pil))
SELECT entity, round(sum(w * score) / sum(w), 6) AS arithmetic, round(exp(sum(w * ln(greatest(score, 1.0))) / sum(w)), 6) AS geometric FROM pil JOIN w USING (pillar) GROUP BY 1""")
def v1_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first generation's aggregation: weighted arithmetic and weighted geometric mean of pillars."""
    rows = matrix.pillars(imputed(spark, sf_dir), tree(spark))
    w = reduce(lambda c, p: c.when(F.col("pillar") == p, WEIGHTS[p]), PILLARS, F.when(F.lit(False), 0.0))
    rows = rows.withColumn("w", w)
    return rounded(rows.groupBy("entity").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("arithmetic"), F.exp(F.sum(F.col("w") * F.log(F.greatest("score", F.lit(1.0)))) / F.sum("w")).alias("geometric")), "arithmetic", "geometric")


@query(LONG + """, m AS (SELECT indicator, avg(value) AS mu, count(value) AS n FROM long GROUP BY 1),
k AS (SELECT indicator, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS skew, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 AS kurt, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM long JOIN m USING (indicator) WHERE value IS NOT NULL GROUP BY 1)
SELECT entity, indicator, round(CASE WHEN abs(skew) > 2 AND kurt > 3.5 THEN greatest(least(value, hi), lo) ELSE value END, 6) AS value FROM long JOIN k USING (indicator) WHERE value IS NOT NULL""")
def winsorize_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators with heavy tails are cut back to their 2.5 and 97.5 percentiles."""
    rows = long_features(spark, sf_dir).where("value is not null")
    shape = rows.groupBy("indicator").agg(F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    ends = quantiles(rows, ["indicator"], "value", [0.025, 0.975]).select("indicator", F.col("quantiles").alias("q"))
    out = rows.join(shape, "indicator").join(ends, "indicator")
    heavy = (F.abs("skew") > 2) & (F.col("kurt") > 3.5)
    cut = F.greatest(F.least("value", F.col("q")[1]), F.col("q")[0])
    return rounded(out.select("entity", "indicator", F.when(heavy, cut).otherwise(F.col("value")).alias("value")), "value")


@query(IMPUTED + """, p AS (SELECT indicator, (value - lo + 1e-9) / sum(value - lo + 1e-9) OVER (PARTITION BY indicator) AS p FROM imp JOIN (SELECT indicator, min(value) AS lo FROM imp GROUP BY 1) USING (indicator)),
e AS (SELECT indicator, 1 + sum(p * ln(p)) / ln(count(*)) AS d FROM p GROUP BY 1)
SELECT indicator, round(d / sum(d) OVER (), 6) AS weight FROM e""")
def entropy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imputed(spark, sf_dir).select("indicator", "value")
    lows = rows.groupBy("indicator").agg(F.min("value").alias("lo"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    x = F.col("value") - F.col("lo") + 1e-9
    p = x / (F.col("s") - F.col("n") * (F.col("lo") - 1e-9))
    e = rows.join(lows, "indicator").withColumn("p", p).groupBy("indicator", "n").agg(F.sum(F.col("p") * F.log("p")).alias("h")).select("indicator", (1 + F.col("h") / F.log("n")).alias("d"))
    return e.withColumn("weight", F.round(F.col("d") / e.agg(F.sum("d")).scalar(), 6)).drop("d")


@query(PILLAR + """, w AS (SELECT entity, max(CASE WHEN pillar = 'returns' THEN score END) AS returns, max(CASE WHEN pillar = 'pricing' THEN score END) AS pricing, max(CASE WHEN pillar = 'demand' THEN score END) AS demand FROM pil GROUP BY 1)
SELECT entity, o[1].p AS best, o[2].p AS second, o[3].p AS worst FROM (SELECT entity, list_sort([{'v': -round(returns, 9), 'i': 0, 'p': 'returns'}, {'v': -round(pricing, 9), 'i': 1, 'p': 'pricing'}, {'v': -round(demand, 9), 'i': 2, 'p': 'demand'}]) AS o FROM w)""")
def within_row_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best pillars and the worst one of each entity; ties in pillar order."""
    wide = matrix.pillars(imputed(spark, sf_dir), tree(spark)).groupBy("entity").pivot("pillar", PILLARS).agg(F.first("score"))
    ordered = F.array_sort(F.array(*(F.struct((-F.round(p, 9)).alias("v"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PILLARS))))
    return wide.withColumn("o", ordered).select("entity", F.col("o")[0]["p"].alias("best"), F.col("o")[1]["p"].alias("second"), F.element_at("o", -1)["p"].alias("worst"))


@query(LONG + """ SELECT indicator, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, round(min(value), 6) AS lo, round(median(value), 5) AS med, round(max(value), 6) AS hi FROM long GROUP BY 1""")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, rows = F.col("value"), long_features(spark, sf_dir)
    own = rows.groupBy("indicator").agg(F.count(v).alias("n"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_samp(v), 5).alias("sd"), F.round(F.min(v), 6).alias("lo"), F.round(F.max(v), 6).alias("hi"))
    return own.join(medians(rows, ["indicator"], "value", "med"), "indicator", "left").withColumn("med", F.round("med", 5))


@query(LONG + " SELECT indicator, round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share, min(value) AS lo, max(value) AS hi FROM long WHERE value IS NOT NULL GROUP BY 1")
def negative_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_features(spark, sf_dir).where("value is not null")
    return rows.groupBy("indicator").agg(F.round(F.avg((F.col("value") < 0).cast("double")), 6).alias("negative_share"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(FEAT + " SELECT entity, grp, " + ", ".join(INDICATORS) + " FROM feat")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("entity", "grp", *INDICATORS)
