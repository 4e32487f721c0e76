"""Validation queries: correlations, reliability, gains curves, tests, resampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matrix, ranks, stats
from ..operators.draws import middle_shift, rank_quantiles_in_draws, shares_in_draw, top_in_draws
from ..operators.order_statistics import medians
from ..operators.storage import block, in_blocks
from .base import FEAT, IMPUTED, INDEX, KEPT, PILLAR, PILLARS, TREE, WEIGHTS, features, gated, imputed, pct_rank_sql, query, reused, rounded, table, tree
from .index import assembled, scored


@query(FEAT + f"""SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT {pct_rank_sql('spend')} AS a, {pct_rank_sql('urgent_price')} AS b FROM feat WHERE spend IS NOT NULL AND urgent_price IS NOT NULL)""")
def spearman_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(features(spark, sf_dir), "spend", "urgent_price"), "rho")


@query(IMPUTED + f""", r AS (SELECT entity, indicator, {pct_rank_sql('value', 'indicator')} AS r FROM imp)
SELECT x.indicator AS a, y.indicator AS b, round(corr(x.r, y.r), 6) AS r, count(*) AS n FROM r x JOIN r y ON x.entity = y.entity AND x.indicator < y.indicator GROUP BY ALL""")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman_pairs(imputed(spark, sf_dir)), "r")


@query(IMPUTED + """SELECT x.indicator AS a, y.indicator AS b, round(corr(x.value, y.value), 6) AS r, count(*) AS n FROM imp x JOIN imp y ON x.entity = y.entity AND x.indicator < y.indicator GROUP BY ALL""")
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pearson_pairs(imputed(spark, sf_dir)), "r")


@query(FEAT + """SELECT a.grp, round(sum(sign(a.quantity - b.quantity) * sign(a.tax - b.tax)) / sqrt(sum(abs(sign(a.quantity - b.quantity))) * sum(abs(sign(a.tax - b.tax)))), 6) AS tau_b FROM feat a JOIN feat b ON a.grp = b.grp AND a.entity < b.entity GROUP BY 1""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kendall(features(spark, sf_dir), "quantity", "tax", "grp"), "tau_b")


_SIMPSON = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
_GRID = "grid AS (SELECT unnest(range(20001)) AS i)"
_NORMAL = f"(SELECT 1 - sqrt(2 / pi()) * abs(z) / 60000 * sum({_SIMPSON} * exp(-pow(abs(z) * i / 20000, 2) / 2)) FROM grid)"
_T = f"(SELECT 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * (pi() / 2 - atan(abs(t) / sqrt(v))) / 60000 * sum({_SIMPSON} * pow(abs(cos(atan(abs(t) / sqrt(v)) + (pi() / 2 - atan(abs(t) / sqrt(v))) * i / 20000)), v - 1)) FROM grid)"
_F = f"(SELECT 2 * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)) * top / 60000 * sum({_SIMPSON} * pow(sin(top * i / 20000), d2 - 1) * pow(cos(top * i / 20000), d1 - 1)) FROM grid)"


@query(FEAT + f""", {_GRID}, k AS (SELECT quantity AS x, tax AS y FROM feat WHERE quantity IS NOT NULL AND tax IS NOT NULL),
pr AS (SELECT sum(sign(a.quantity - b.quantity) * sign(a.tax - b.tax)) AS s FROM feat a JOIN feat b ON a.entity < b.entity),
n AS (SELECT count(*) AS n, count(*) * 1.0 * (count(*) - 1) / 2 AS pairs FROM k), tx AS (SELECT sum(t * (t - 1.0) / 2) AS p, sum(t * (t - 1.0) * (t - 2)) AS c, sum(t * (t - 1.0) * (2 * t + 5)) AS q FROM (SELECT count(*) AS t FROM k GROUP BY x)),
ty AS (SELECT sum(t * (t - 1.0) / 2) AS p, sum(t * (t - 1.0) * (t - 2)) AS c, sum(t * (t - 1.0) * (2 * t + 5)) AS q FROM (SELECT count(*) AS t FROM k GROUP BY y)),
z AS (SELECT n, s / sqrt((pairs - tx.p) * (pairs - ty.p)) AS tau_b, s / sqrt((2 * pairs * (2 * n + 5) - tx.q - ty.q) / 18 + tx.p * ty.p / pairs + tx.c * ty.c / (18 * pairs * (n - 2))) AS z FROM pr, n, tx, ty)
SELECT round(tau_b, 8) AS tau_b, n, round({_NORMAL}, 8) AS p FROM z""")
def kendall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of all customers at once, and its p."""
    return stats.kendall_whole(features(spark, sf_dir), "quantity", "tax").select(F.round("tau_b", 8).alias("tau_b"), "n", F.round("p", 8).alias("p"))


@query(FEAT + f""", {_GRID}, g AS (SELECT grp, count(quantity) AS n, avg(quantity) AS m, var_samp(quantity) AS v FROM feat GROUP BY 1),
fa AS (SELECT (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, count(*) - 1.0 AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM g),
fb AS (SELECT f, d1, d2, asin(sqrt(d2 / (d2 + d1 * f))) AS top FROM fa), d AS (SELECT delta AS d FROM feat WHERE delta IS NOT NULL),
tt AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(d) - 1.0 AS v FROM d),
wr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
wz AS (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) * 1.0 AS n, (SELECT sum(t * t * t - t) FROM (SELECT count(*) * 1.0 AS t FROM wr GROUP BY abs(d))) AS lost FROM wr),
wy AS (SELECT w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - lost / 48) AS z FROM wz)
SELECT 'anova' AS test, round(f, 6) AS statistic, round({_F}, 8) AS p FROM fb UNION ALL SELECT 'paired_t', round(t, 6), round({_T}, 8) FROM tt UNION ALL SELECT 'wilcoxon', round(w, 6), round({_NORMAL}, 8) FROM wy""")
def tail_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tests of the validation chapter with their p: regions differ, rounds differ by mean, rounds differ by signed ranks."""
    rows = features(spark, sf_dir)
    changes = rows.where("delta is not null").select("delta", F.lit(0.0).alias("zero"))
    row = lambda name, found, statistic: found.select(F.lit(name).alias("test"), F.round(statistic, 6).alias("statistic"), F.round("p", 8).alias("p"))
    out = row("anova", stats.anova_p(rows, "grp", "quantity"), "f").unionByName(row("paired_t", stats.paired_t_p(changes, "delta", "zero"), "t"))
    return out.unionByName(row("wilcoxon", stats.wilcoxon_p(changes, "delta", "zero"), "w"))


@query(FEAT + "SELECT round(regr_slope(urgent_price, spend), 8) AS slope, round(regr_intercept(urgent_price, spend), 4) AS intercept, round(regr_r2(urgent_price, spend), 6) AS r2 FROM feat")
def ols_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ols(features(spark, sf_dir), "urgent_price", "spend").select(F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(KEPT + """, z AS (SELECT entity, pillar, indicator, direction * (value - avg(value) OVER (PARTITION BY indicator)) / stddev_samp(value) OVER (PARTITION BY indicator) AS z FROM kept JOIN tree USING (indicator)),
sz AS (SELECT pillar, count(*) AS k FROM tree GROUP BY 1), w AS (SELECT entity, pillar, sum(z) AS t, count(z) AS n FROM z GROUP BY ALL), ok AS (SELECT w.*, k FROM w JOIN sz USING (pillar) WHERE n = k),
v AS (SELECT pillar, sum(v) AS v FROM (SELECT z.pillar, indicator, var_samp(z) AS v FROM z JOIN ok USING (entity, pillar) GROUP BY ALL) GROUP BY 1)
SELECT ok.pillar, round(any_value(k) / (any_value(k) - 1.0) * (1 - any_value(v) / var_samp(t)), 6) AS alpha, any_value(k) AS k FROM ok JOIN v USING (pillar) GROUP BY 1""")
def cronbach_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cronbach(gated(spark, sf_dir), tree(spark)), "alpha")


@query(FEAT + """, g AS (SELECT grp, count(quantity) AS n, avg(quantity) AS m, var_samp(quantity) AS v FROM feat GROUP BY 1)
SELECT round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))), 5) AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.anova(features(spark, sf_dir), "grp", "quantity").withColumn("f", F.round("f", 5))


@query("SELECT round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(b - a))), 6) AS t, count(b - a) AS n FROM (SELECT o_custkey, avg(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END) AS a, avg(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END) AS b FROM orders GROUP BY 1)")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_t(_rounds(spark, sf_dir), "b", "a"), "t")


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda y: F.avg(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(mean(1996).alias("a"), mean(2000).alias("b"))


@query(FEAT + f"""SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) AS n FROM (SELECT delta AS d, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS r FROM feat WHERE delta <> 0)""")
def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.wilcoxon(features(spark, sf_dir).select("delta", F.lit(0.0).alias("zero")), "delta", "zero")


@query()
def normality_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normality(features(spark, sf_dir), "quantity")


@query(FEAT + """SELECT round(1 - var_samp(d) / var_samp(quantity), 6) AS between_share FROM (SELECT quantity, quantity - avg(quantity) OVER (PARTITION BY grp) AS d FROM feat)""")
def between_group_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    own = rows.join(rows.groupBy("grp").agg(F.avg("quantity").alias("m")), "grp")
    return own.agg(F.round(1 - F.var_samp(F.col("quantity") - F.col("m")) / F.var_samp("quantity"), 6).alias("between_share"))


@query(IMPUTED + """, c AS (SELECT t.pillar, x.indicator, corr(x.value, y.value) AS r FROM imp x JOIN tree t USING (indicator) JOIN tree u ON u.pillar = t.pillar AND u.indicator > t.indicator JOIN imp y ON y.entity = x.entity AND y.indicator = u.indicator GROUP BY t.pillar, x.indicator, y.indicator)
SELECT pillar, round(avg(abs(r)), 6) AS mean_abs_r, count(*) AS pairs FROM c GROUP BY 1""")
def pillar_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.pearson_pairs(imputed(spark, sf_dir))
    own = tree(spark).select("indicator", "pillar")
    same = pairs.join(own.withColumnsRenamed({"indicator": "a"}), "a").join(own.withColumnsRenamed({"indicator": "b", "pillar": "pillar_b"}), "b").where("pillar = pillar_b")
    return same.groupBy("pillar").agg(F.round(F.avg(F.abs("r")), 6).alias("mean_abs_r"), F.count(F.lit(1)).alias("pairs"))


_GAIN = FEAT + """, g AS (SELECT entity, grp, balance, spend, row_number() OVER (ORDER BY balance DESC NULLS LAST, entity) AS position, sum(spend) OVER (ORDER BY balance DESC NULLS LAST, entity ROWS UNBOUNDED PRECEDING) AS run, sum(spend) OVER () AS total FROM feat)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.gains(features(spark, sf_dir).select("entity", "grp", "balance", "spend"), "balance", "spend")


@query(_GAIN + " SELECT entity, position, round(run / total, 6) AS gain FROM g")
def gains_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_gains(spark, sf_dir).select("entity", "position", "gain"), "gain")


@query(_GAIN + " SELECT position AS top_n, round(run / total, 6) AS gain, round(run / total / (position / (SELECT count(*) FROM feat)), 5) AS lift FROM g WHERE position IN (50, 100, 200, 300)")
def gains_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains and lift over a random order at four sizes."""
    rows = _gains(spark, sf_dir)
    n = features(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return rows.where(F.col("position").isin(50, 100, 200, 300)).select(F.col("position").alias("top_n"), F.round("gain", 6).alias("gain"), F.round(F.col("gain") / (F.col("position") / n), 5).alias("lift"))


@query(_GAIN + " SELECT count(*) FILTER (WHERE run / total < 0.5) + 1 AS n FROM g")
def districts_to_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gains(spark, sf_dir).agg((F.count_if(F.col("gain") < 0.5) + 1).alias("n"))


@query(FEAT + """, g AS (SELECT *, sum(n_orders) OVER (ORDER BY balance DESC NULLS LAST, entity ROWS UNBOUNDED PRECEDING) AS run, sum(n_orders) OVER () AS total FROM feat)
SELECT count(*) AS n, round(sum(spend) / (SELECT sum(spend) FROM feat), 6) AS capture FROM g WHERE (run - n_orders) / total < 0.2""")
def capture_equal_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("entity", "balance", "spend", "n_orders")
    return rounded(stats.captured(rows, "balance", "spend", "n_orders", 0.2), "capture")


_TWO = FEAT + """, a AS (SELECT entity, row_number() OVER (ORDER BY spend DESC NULLS LAST, entity) AS ra, row_number() OVER (ORDER BY n_orders DESC NULLS LAST, entity) AS rb, spend FROM feat)"""


def _two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("entity", "spend", "n_orders")
    one = ranks.in_order(rows, "spend", "entity").withColumnRenamed("position", "ra")
    return ranks.in_order(one, "n_orders", "entity").withColumnRenamed("position", "rb")


@query(_TWO + " SELECT count(*) FILTER (WHERE ra <= 50 AND rb <= 50) AS overlap50, round(avg(abs(ra - rb)), 6) AS mean_shift, max(abs(ra - rb)) AS max_shift FROM a")
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of the same entities: overlap of their heads and how far ranks move."""
    d = F.abs(F.col("ra") - F.col("rb"))
    return _two_orders(spark, sf_dir).agg(F.count_if((F.col("ra") <= 50) & (F.col("rb") <= 50)).alias("overlap50"), F.round(F.avg(d), 6).alias("mean_shift"), F.max(d).alias("max_shift"))


@query(_TWO + " SELECT round(median(gap), 6) AS median_gap, round(max(CASE WHEN ra = 1 THEN spend END) - max(CASE WHEN ra = 100 THEN spend END), 4) AS top_gap FROM (SELECT ra, spend, spend - lead(spend) OVER (ORDER BY ra) AS gap FROM a)")
def adjacent_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbours in order: each row meets the next position by a join, so no window holds all rows."""
    rows = ranks.in_order(features(spark, sf_dir).select("entity", "spend"), "spend", "entity")
    after = rows.select((F.col("position") - 1).alias("position"), F.col("spend").alias("next"))
    both = rows.join(after, "position", "left")
    top = lambda k: F.max(F.when(F.col("position") == k, F.col("spend")))
    middle = medians(both.withColumn("gap", F.col("spend") - F.col("next")), [], "gap", "m").select(F.round("m", 6)).scalar()
    return both.agg(F.round(top(1) - top(100), 4).alias("top_gap")).select(middle.alias("median_gap"), "top_gap")


@query("""SELECT metric, value, lo, hi, CASE WHEN value IS NULL THEN 'N/A' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN value >= lo AND value <= hi THEN 'PASS' ELSE 'FAIL' END
  WHEN lo IS NOT NULL THEN CASE WHEN value >= lo THEN 'PASS' ELSE 'FAIL' END WHEN hi IS NOT NULL THEN CASE WHEN value <= hi THEN 'PASS' ELSE 'FAIL' END ELSE '-' END AS verdict
FROM (SELECT 'm' || c_nationkey AS metric, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS value, CASE WHEN c_nationkey % 3 > 0 THEN 5000.0 END AS lo, CASE WHEN c_nationkey % 2 = 0 THEN 5200.0 END AS hi FROM customer GROUP BY c_nationkey)""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 6).alias("value"))
    rows = rows.select(F.concat(F.lit("m"), k.cast("string")).alias("metric"), "value", F.when(k % 3 > 0, 5000.0).alias("lo"), F.when(k % 2 == 0, 5200.0).alias("hi"))
    return rows.withColumn("verdict", C.verdict("value", "lo", "hi"))


# resampling: draws are rows, never a driver loop
DRAWS = 300


SEED = 42


def uniform(draw: int, what: str) -> float:
    """A number in [0, 1) for a draw and an axis, by a hash of both and the seed: any draw can be had without those before it."""
    return int(hashlib.sha256(f"{SEED}:{draw}:{what}".encode()).hexdigest()[:12], 16) / 16**12


def draw_weight(draw: int, pillar: str) -> float:
    """A weight factor in [0.75, 1.25), each pillar's by itself."""
    return 0.75 + uniform(draw, pillar) / 2


def factors_sql(n: int) -> str:
    return "(VALUES " + ", ".join(f"({d}, '{p}', {draw_weight(d, p)!r}::DOUBLE)" for d in range(n) for p in PILLARS) + ") f(draw, pillar, f)"


def mc_sql(n: int) -> str:
    """mr: draw, entity and rank by the whole index, weights drawn anew."""
    clip = lambda x: f"greatest(least({x}, 100.0), 1.0) / 100"
    return INDEX + f""", mq AS (SELECT draw, entity, CASE WHEN sum(w * f) > 0 THEN sum(w * f * score) / sum(w * f) ELSE sum(score) / {len(PILLARS)} END AS q FROM live JOIN {factors_sql(n)} USING (pillar) GROUP BY ALL),
mc AS (SELECT draw, entity, round(100 * pow({clip('size')}, 0.5) * pow({clip('q')}, 0.5), 9) AS s FROM mq JOIN siz USING (entity)),
mr AS (SELECT draw, entity, CAST(row_number() OVER (PARTITION BY draw ORDER BY s DESC, entity) AS BIGINT) AS r FROM mc)"""


_MC = mc_sql(DRAWS)


def alike(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities that agree in all keys (none of them null) as one class, named by its smallest entity: cls, n and the keys; and entity, cls."""
    rows = reused(rows)
    found = reused(rows.groupBy(*keys).agg(F.min("entity").alias("cls"), F.count(F.lit(1)).alias("n")))
    return found, reused(rows.join(found, keys).select("entity", "cls"))


_PARTS = ["size", *(f"{p}_{x}" for p in PILLARS for x in "pb")]


def mc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, size as the geometric mean takes it, and each pillar's score and blocked flag: made once, a draw only weighs the pillars anew; blocked pillars stay blocked."""
    size = F.greatest(F.least("size", F.lit(100.0)), F.lit(1.0)).alias("size")
    return assembled(spark, sf_dir).select("entity", size, *(f"{p}_b" for p in PILLARS), *(F.coalesce(f"{p}_p", F.lit(0.0)).alias(f"{p}_p") for p in PILLARS))


def rounded_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as in the SQL, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def weighed(pillars: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Draws by rows: the weighted mean of (score, blocked flag, weight by draw) as in C.blocked_mean."""
    live = [np.where(b, 0.0, w[:, None]) for _, b, w in pillars]
    total = sum(live)
    equal = sum(p for p, _, _ in pillars) / len(PILLARS)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, sum(w * p for w, (p, _, _) in zip(live, pillars)) / total, equal)


def mc_score(n: int):
    """The index in draws: rows of _PARTS."""
    weights = {p: np.array([WEIGHTS[p] * draw_weight(d, p) for d in range(n)]) for p in PILLARS}

    def score(columns: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        own = dict(zip(_PARTS, columns))
        q = weighed([(own[f"{p}_p"], own[f"{p}_b"].astype(bool), weights[p][at]) for p in PILLARS])
        return rounded_up(100 * np.sqrt(own["size"] / 100) * np.sqrt(np.clip(q, 1.0, 100.0) / 100), 9)

    return score


def rank_quantiles(scores: DataFrame, members: DataFrame, probs: list[float]) -> DataFrame:
    """entity, q: quantiles over the draws of an entity's rank (by score, highest first, then entity), from its class's scores (draw, cls, n, s) and entity, cls.

    The rank is the number of entities with a higher score, plus the entity's place in its class. Only where several classes share a score are their entities ranked
    one by one in every draw.
    """
    of = F.percentile("r", F.array(*(F.lit(p) for p in probs)))
    placed = ranks.in_order(scores, "s", "cls", ("n",), by=("draw",)).select("draw", "cls", "s", (F.col("run_n") - F.col("n")).cast("long").alias("before"))
    placed = reused(placed)
    tied = reused(placed.groupBy("draw", "s").agg(F.min("before").alias("above"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    at = reused(ranks.in_order(members, "cls", "entity", descending=False).select("entity", "cls", "position"))
    at = at.join(at.groupBy("cls").agg(F.min("position").alias("first")), "cls").select("entity", "cls", (F.col("position") - F.col("first") + 1).alias("i"))
    same = (F.col("s").eqNullSafe(F.col("ts"))) & (F.col("draw") == F.col("td"))
    mixed = reused(placed.join(tied.select(F.col("draw").alias("td"), F.col("s").alias("ts"), "above"), same, "inner").select("draw", "cls", "s", "above"))
    unsure = reused(mixed.select("cls").distinct())
    sure = placed.withColumnRenamed("before", "r").join(unsure, "cls", "left_anti").groupBy("cls").agg(of.alias("q"))
    out = at.join(sure, "cls").select("entity", F.transform("q", lambda x: x + F.col("i")).alias("q"))
    if unsure.isEmpty():
        return out
    rows = ranks.in_order(reused(mixed.join(members, "cls")), "s", "entity", by=("draw",)).select("draw", "entity", "s", "above", "position")
    rows = reused(rows)
    first = rows.groupBy("draw", "s").agg(F.min("position").alias("first")).select(F.col("draw").alias("td"), F.col("s").alias("ts"), "first")
    own = rows.join(first, same).select("entity", (F.col("above") + F.col("position") - F.col("first") + 1).alias("r"))
    alone = placed.join(unsure, "cls", "left_semi").join(mixed.select("draw", "cls"), ["draw", "cls"], "left_anti").join(at, "cls").select("entity", (F.col("before") + F.col("i")).alias("r"))
    return out.unionByName(own.unionByName(alone).groupBy("entity").agg(of.alias("q")))


def firsts(scores: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """draw, entity: the k entities of each draw with the highest scores, ties to the smaller entity. They are in the first k classes, and in these among the first k entities."""
    top = ranks.in_order(scores.select("draw", "cls", "s"), "s", "cls", by=("draw",)).where(F.col("position") <= k).drop("position")
    few = members.withColumn("_r", F.row_number().over(Window.partitionBy("cls").orderBy("entity"))).where(F.col("_r") <= k).drop("_r")
    return ranks.in_order(reused(reused(top).join(few, "cls")), "s", "entity", by=("draw",)).where(F.col("position") <= k).select("draw", "entity")


@query(_MC + " SELECT entity, round(quantile_cont(r, 0.05), 4) AS lo, round(quantile_cont(r, 0.95), 4) AS hi FROM mr GROUP BY 1")
def rank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quantiles_in_draws(mc_parts(spark, sf_dir), _PARTS, DRAWS, mc_score(DRAWS), [0.05, 0.95]).select("entity", F.round(F.col("q")[0], 4).alias("lo"), F.round(F.col("q")[1], 4).alias("hi"))


V1_DRAWS = 500


@query(mc_sql(V1_DRAWS) + " SELECT entity, CAST(floor(round(quantile_cont(r, 0.05), 4)) AS BIGINT) AS lo, CAST(floor(round(quantile_cont(r, 0.95), 4)) AS BIGINT) AS hi FROM mr GROUP BY 1")
def v1_rank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first generation's intervals: 500 draws of weights only, both ends cut to whole ranks."""
    end = lambda i: F.floor(F.round(F.col("q")[i], 4)).cast("long")
    return rank_quantiles_in_draws(mc_parts(spark, sf_dir), _PARTS, V1_DRAWS, mc_score(V1_DRAWS), [0.05, 0.95]).select("entity", end(0).alias("lo"), end(1).alias("hi"))


@query(_MC + """, base AS (SELECT entity, row_number() OVER (ORDER BY overall DESC, entity) AS r FROM score)
SELECT CAST(mr.draw AS BIGINT) AS draw, count(*) AS overlap, round(count(*) / 50.0, 6) AS stability FROM mr JOIN base USING (entity) WHERE mr.r <= 50 AND base.r <= 50 GROUP BY 1""")
def mc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights within a quarter of their size: how much of the index's top 50 stays."""
    top = scored(spark, sf_dir).orderBy(F.col("overall").desc(), "entity").limit(50).select("entity")
    both = top_in_draws(reused(mc_parts(spark, sf_dir)), _PARTS, DRAWS, mc_score(DRAWS), 50).join(top, "entity").groupBy("draw").agg(F.count(F.lit(1)).alias("overlap"))
    return both.select(F.col("draw").cast("long").alias("draw"), "overlap", F.round(F.col("overlap") / 50.0, 6).alias("stability"))


BOOTSTRAPS = 150


def _taken(draws: int, n: int) -> list:
    """For each draw whether it takes an entity, by a hash of both, with the chance that n draws with replacement take it."""
    most = 1 - (1 - 1 / max(n, 1)) ** n
    return [(F.pmod(F.xxhash64("entity", F.lit(d).cast("long"), F.lit(42)), F.lit(1_000_000)) / 1e6 < most).alias(f"d{d}") for d in range(draws)]


_BOOT = [(i, p, d) for i, p, d in TREE if p in PILLARS] + [(c, "", 1) for c in ("spend", "urgent_share")]


def _resampling(spark: SparkSession, sf_dir: str, draws: int) -> tuple[DataFrame, int]:
    """One row an entity: the whole part of its rank in each indicator and part of size (0 without a value; equal for equal values alone), its blocked pillars, its place in the index of all (`position`),
    and for each draw whether it is taken; and the number of entities in that index. Values stay imputed, and pillars blocked, as for all entities."""
    key = lambda c: F.coalesce(F.max(F.when(F.col("indicator") == c, F.floor("rank"))), F.lit(0)).cast("long").alias(f"k_{c}")
    wide = assembled(spark, sf_dir, tuple(key(c) for c, _, _ in _BOOT))
    wide = wide.select("entity", F.round(C.geometric("size", "quality", 0.5), 6).alias("overall"), *(f"{p}_b" for p in PILLARS), *(f"k_{c}" for c, _, _ in _BOOT))
    placed = reused(ranks.average_ranks(wide, [], "overall").withColumn("position", F.col("n") + 1 - F.col("rank")))
    most = placed.agg(F.max("n")).first()[0] or 0
    return placed.drop("overall", "rank", "n"), most


def _drawn_index(files: list[str], draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entities a draw takes, and the index built anew on these, from percentile ranks on."""
    taken = np.concatenate([block(f, [f"d{draw}"])[0] for f in files])
    share = lambda c, d: 1 - shares_in_draw(files, f"k_{c}", taken) if d < 0 else shares_in_draw(files, f"k_{c}", taken)
    total, weight, plain = (np.zeros(int(taken.sum())) for _ in range(3))
    for p in PILLARS:
        mine, known = np.zeros(len(total)), np.zeros(len(total), dtype=np.int16)
        for c, q, d in _BOOT:
            if q == p:
                x = 100 * share(c, d)
                known += ~np.isnan(x)
                mine += np.nan_to_num(x, copy=False)
        mine /= np.maximum(known, 1)  # a missing pillar counts as 0
        w = np.where(np.concatenate([block(f, [f"{p}_b"])[0] for f in files])[taken], 0.0, WEIGHTS[p])
        total += w * mine
        weight += w
        plain += mine
    quality = np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), plain / len(PILLARS))
    del total, weight, plain
    size = 75 * share("spend", 1) + 25 * share("urgent_share", 1)
    clip = lambda x: np.fmax(np.fmin(x, 100.0), 1.0) / 100  # noqa: E731  what is missing counts as the cap, as in C.geometric
    return taken, np.floor(100 * np.sqrt(clip(size)) * np.sqrt(clip(quality)) * 1e6 + 0.5) / 1e6


def _draw_files(spark: SparkSession, sf_dir: str, draws: int) -> tuple[list[str], int]:
    rows, n = _resampling(spark, sf_dir, draws)
    return in_blocks(rows.select("*", *_taken(draws, features(spark, sf_dir).count())), [], 1 << 18), n


def _resampled(spark: SparkSession, sf_dir: str, draws: int) -> DataFrame:
    """draw, entity, overall of the entities that each draw takes."""
    files, _ = _draw_files(spark, sf_dir, draws)

    def rows(batches):
        for part in batches:
            for d in part.id:
                taken, overall = _drawn_index(files, int(d))
                yield pd.DataFrame({"draw": int(d), "entity": np.concatenate([block(f, ["entity"])[0] for f in files])[taken], "overall": overall})

    return reused(spark.range(0, draws, numPartitions=draws).mapInPandas(rows, "draw long, entity long, overall double"))


def _resampled_classes(spark: SparkSession, sf_dir: str, draws: int) -> tuple[DataFrame, DataFrame]:
    """draw, cls, c, overall: entities alike in ranks and flags as one class, and c, how many of it are drawn; and entity, cls. They have one score in every draw."""
    rows, _ = _resampling(spark, sf_dir, draws)
    _, members = alike(rows, [*(f"k_{c}" for c, _, _ in _BOOT), *(f"{p}_b" for p in PILLARS)])
    each = _resampled(spark, sf_dir, draws).join(members, "entity").groupBy("draw", "cls").agg(F.count(F.lit(1)).alias("c"), F.max("overall").alias("overall"))
    return each, members


@query()
def bootstrap_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw, churn, median_churn: entities drawn by hash with the chance that a draw with replacement takes them; the median shift of ranks, scaled to all, against the index of all; and the median over the draws.

    A draw is a task: it reads the columns of all entities one after the other, and no row is made for an entity and a draw."""
    files, n = _draw_files(spark, sf_dir, BOOTSTRAPS)

    def moved(batches):
        for part in batches:
            for d in part.id:
                taken, overall = _drawn_index(files, int(d))
                if len(overall):
                    yield pd.DataFrame({"draw": [int(d)], "churn": [middle_shift(overall, np.concatenate([block(f, ["position"])[0] for f in files])[taken], n)]})

    churn = reused(spark.range(0, BOOTSTRAPS, numPartitions=BOOTSTRAPS).mapInPandas(moved, "draw long, churn double"))
    return ranks.with_scalar(churn, churn.agg(F.median("churn").alias("median_churn")))


@query(INDEX + " SELECT grp, count(*) AS n, round(avg(overall), 5) AS mean, arg_max(entity, (overall, -entity)) AS best, round(max(overall) - min(overall), 5) AS spread FROM score GROUP BY 1")
def group_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("overall")
    return scored(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 5).alias("mean"), F.max_by("entity", F.struct(x, -F.col("entity"))).alias("best"), F.round(F.max(x) - F.min(x), 5).alias("spread"))

