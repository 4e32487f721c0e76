"""How far the whole index leans on one choice: the fill rule, one indicator, momentum; and whether its pillars point the way that outside measures do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matrix, ranks, stats
from ..operators.order_statistics import quantiles
from .base import INDEX, PILLARS, TREE, WEIGHTS, features, gated, imputed, once, pct_rank_sql, query, reused, tree
from .index import quality, sized

PRODUCTION = "group_median"
STRATEGIES = {"overall_median": matrix.impute_overall, "neighbours": matrix.impute_neighbours, "listwise": matrix.listwise}
_OWN = ", ".join(f"'{p}'" for p in PILLARS)


def _geo(size: str, q: str, alpha: float = 0.5) -> str:
    clip = lambda x: f"greatest(least({x}, 100.0), 1.0) / 100"
    return f"100 * pow({clip(size)}, {alpha}) * pow({clip(q)}, {1 - alpha})"


@once
def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, entity, s: the index built anew on each strategy's fill, all strategies in one long frame.

    Indicators and size are ranked among a strategy's own entities (listwise has fewer). Blocked pillars are those of the matrix before it is filled.
    The cells of size and of the pillars are ranked in one call and meet in one shuffle.
    """
    cells, sizes = gated(spark, sf_dir).withColumn("missing", F.col("value").isNull()), ["spend", "urgent_share"]
    known = F.col("provenance").eqNullSafe("observed")
    fills = imputed(spark, sf_dir).select(F.lit(PRODUCTION).alias("strategy"), "entity", "indicator", "value", (~known).alias("missing"))
    for name, fill in STRATEGIES.items():
        fills = fills.unionByName(fill(cells).select(F.lit(name).alias("strategy"), "entity", "indicator", "value", "missing"))
    own = matrix.to_long(features(spark, sf_dir), ["entity"], sizes).withColumn("missing", F.lit(None).cast("boolean"))
    lacking = cells.where("missing").select("entity").distinct()
    for name in (PRODUCTION, *STRATEGIES):
        kept = own.join(lacking, "entity", "left_anti") if name == "listwise" else own  # the others keep all entities
        fills = fills.unionByName(kept.withColumn("strategy", F.lit(name)))
    shape = tree(spark).where(F.col("pillar").isin(PILLARS)).unionByName(spark.createDataFrame([(c, c, 1) for c in sizes], "indicator string, pillar string, direction int"))
    scores = ranks.percent_ranks(reused(fills).join(F.broadcast(shape), "indicator"), ["strategy", "indicator"], "value", F.col("direction"))
    part = lambda c: F.max(F.when(F.col("pillar") == c, F.col("score")))
    also = (*(part(c).alias(c) for c in sizes), F.count("missing").alias("cells"))
    rows = matrix.pillar_columns(scores, PILLARS, also=also, keys=("strategy", "entity")).where("cells > 0")
    rows = rows.withColumn("size", 0.75 * F.col("spend") + 0.25 * F.col("urgent_share")).withColumn("quality", C.blocked_mean([(f"{p}_p", f"{p}_b", WEIGHTS[p]) for p in PILLARS]))
    return reused(rows.select("strategy", "entity", F.round(C.geometric("size", "quality", 0.5), 6).alias("s")))


_ARMS = INDEX + f""", kst AS (SELECT indicator, avg(value) AS m, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS s FROM kept GROUP BY 1),
kz AS (SELECT entity, indicator, (value - m) / s AS z FROM kept JOIN kst USING (indicator) WHERE value IS NOT NULL),
lack AS (SELECT DISTINCT entity FROM kept WHERE value IS NULL), wd AS (SELECT count(DISTINCT indicator) AS p FROM kept),
near AS (SELECT a.entity, b.entity AS donor, sqrt(sum(pow(a.z - b.z, 2)) / count(*) * (SELECT p FROM wd)) AS d FROM kz a JOIN lack USING (entity) JOIN kz b ON a.indicator = b.indicator AND a.entity <> b.entity GROUP BY ALL),
best AS (SELECT g.entity, g.indicator, k.value, row_number() OVER (PARTITION BY g.entity, g.indicator ORDER BY d, donor) AS r FROM kept g JOIN near n USING (entity) JOIN kept k ON k.entity = n.donor AND k.indicator = g.indicator WHERE g.value IS NULL AND k.value IS NOT NULL),
fill AS (SELECT entity, indicator, avg(value) AS k FROM best WHERE r <= 5 GROUP BY ALL), md AS (SELECT indicator, median(value) AS m FROM kept GROUP BY 1),
fills AS (SELECT '{PRODUCTION}' AS strategy, entity, indicator, value FROM imp
 UNION ALL SELECT 'overall_median', entity, indicator, coalesce(value, m) FROM kept JOIN md USING (indicator)
 UNION ALL SELECT 'neighbours', entity, indicator, coalesce(value, k, m) FROM kept LEFT JOIN fill USING (entity, indicator) JOIN md USING (indicator)
 UNION ALL SELECT 'listwise', entity, indicator, value FROM kept WHERE entity NOT IN (SELECT entity FROM lack)),
sn AS (SELECT strategy, entity, pillar, avg(100 * CASE WHEN direction < 0 THEN 1 - r ELSE r END) AS p FROM (SELECT *, {pct_rank_sql('value', 'strategy, indicator')} AS r FROM fills) JOIN tree USING (indicator) WHERE pillar IN ({_OWN}) GROUP BY ALL),
sq AS (SELECT strategy, entity, CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE sum(p) / {len(PILLARS)} END AS q FROM sn JOIN (SELECT entity, pillar, w FROM live) USING (entity, pillar) GROUP BY ALL),
sz AS (SELECT strategy, entity, 75 * {pct_rank_sql('spend', 'strategy')} + 25 * {pct_rank_sql('urgent_share', 'strategy')} AS z FROM feat JOIN (SELECT DISTINCT strategy, entity FROM fills) USING (entity)),
arm AS (SELECT strategy, entity, round({_geo('z', 'q')}, 6) AS s FROM sq JOIN sz USING (strategy, entity))"""


@query(_ARMS + f""", two AS (SELECT a.strategy AS a, b.strategy AS b, a.s AS x, b.s AS y FROM arm a JOIN arm b ON a.entity = b.entity AND a.strategy < b.strategy WHERE a.s IS NOT NULL AND b.s IS NOT NULL)
SELECT a, b, count(*) AS n, round(corr(rx, ry), 5) AS rho FROM (SELECT a, b, {pct_rank_sql('x', 'a, b')} AS rx, {pct_rank_sql('y', 'a, b')} AS ry FROM two) GROUP BY ALL""")
def imputation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, n, rho: rank correlation of the index under each pair of fill rules, over the entities that both keep."""
    rows = arms(spark, sf_dir).where("s is not null")
    a, b = (rows.select("entity", F.col("strategy").alias(k), F.col("s").alias(f"s_{k}")) for k in "ab")
    pairs = reused(a.join(b, "entity").where("a < b"))
    placed = ranks.average_ranks(pairs, ["a", "b"], "s_a").withColumnRenamed("rank", "ra").drop("n")
    placed = ranks.average_ranks(placed, ["a", "b"], "s_b").withColumnRenamed("rank", "rb")
    return placed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 5).alias("rho"))


_TIER = "CASE WHEN s <= {0}1 THEN 'D' WHEN s <= {0}2 THEN 'C' WHEN s <= {0}3 THEN 'B' ELSE 'A' END"


@query(_ARMS + f""", e AS (SELECT strategy, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.75) AS q3 FROM arm GROUP BY 1),
f AS (SELECT q1 AS p1, q2 AS p2, q3 AS p3 FROM e WHERE strategy = '{PRODUCTION}'),
t AS (SELECT strategy, entity, {_TIER.format('q')} AS own, {_TIER.format('p')} AS fixed FROM arm JOIN e USING (strategy), f WHERE s IS NOT NULL),
m AS (SELECT t.strategy, t.entity, t.own <> b.own AS o, t.fixed <> b.own AS x FROM t JOIN t b ON t.entity = b.entity AND b.strategy = '{PRODUCTION}' WHERE t.strategy <> '{PRODUCTION}'),
any_arm AS (SELECT entity, bool_or(o) AS o, bool_or(x) AS x FROM m GROUP BY 1)
SELECT strategy, count(*) AS n, round(100 * avg(o::INT), 4) AS own_pct, round(100 * avg(x::INT), 4) AS fixed_pct FROM m GROUP BY 1 UNION ALL SELECT 'any', count(*), round(100 * avg(o::INT), 4), round(100 * avg(x::INT), 4) FROM any_arm""")
def imputation_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, n, own_pct, fixed_pct: the share of entities that leave their production tier under a fill rule, by the rule's own quartile edges and by production's; `any` is over all rules.

    What own edges move and fixed edges do not is the cut points' doing, not the fill's.
    """
    rows = arms(spark, sf_dir).where("s is not null")
    edges = quantiles(rows, ["strategy"], "s", [0.25, 0.5, 0.75]).select("strategy", F.col("quantiles").alias("own"))
    fixed = edges.where(F.col("strategy") == PRODUCTION).select("own").scalar()
    told = rows.join(edges, "strategy").withColumn("fixed", fixed).select("strategy", "entity", C.tier("s", "own").alias("own"), C.tier("s", "fixed").alias("fixed"))
    told = reused(told)
    base = told.where(F.col("strategy") == PRODUCTION).select("entity", F.col("own").alias("base"))
    moved = told.where(F.col("strategy") != PRODUCTION).join(base, "entity").select("strategy", "entity", (F.col("own") != F.col("base")).alias("o"), (F.col("fixed") != F.col("base")).alias("x"))
    whole = moved.groupBy("entity").agg(F.bool_or("o").alias("o"), F.bool_or("x").alias("x")).select(F.lit("any").alias("strategy"), "entity", "o", "x")
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 4)
    return moved.unionByName(whole).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), pct("o").alias("own_pct"), pct("x").alias("fixed_pct"))


@query(INDEX + f""", loo AS (SELECT d.indicator AS left_out, entity, pillar, avg(score) AS p FROM norm n, (SELECT DISTINCT indicator FROM norm) d WHERE n.indicator <> d.indicator GROUP BY ALL UNION ALL SELECT '', entity, pillar, score FROM pil),
lq AS (SELECT left_out, entity, CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE sum(p) / {len(PILLARS)} END AS q FROM loo JOIN (SELECT entity, pillar, w FROM live) USING (entity, pillar) GROUP BY ALL),
s AS (SELECT left_out, entity, round({_geo('size', 'q')}, 7) AS s FROM lq JOIN siz USING (entity)),
r AS (SELECT left_out, entity, row_number() OVER (PARTITION BY left_out ORDER BY s DESC, entity) AS r FROM s)
SELECT a.left_out, CAST(max(abs(a.r - b.r)) AS BIGINT) AS max_shift, round(avg(abs(a.r - b.r)), 6) AS mean_shift FROM r a JOIN r b ON a.entity = b.entity AND b.left_out = '' WHERE a.left_out <> '' GROUP BY 1""")
def loo_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the whole index's ranks move with each indicator left out in turn: from each pillar's sum and count, without normalising again."""
    own = tree(spark).where(F.col("pillar").isin(PILLARS))
    cells = ranks.percent_ranks(imputed(spark, sf_dir).join(own, "indicator"), ["indicator"], "value", F.col("direction"))
    part = lambda p: F.when(F.col("pillar") == p, F.col("score"))
    wide = cells.groupBy("entity").agg(*(f(part(p)).alias(f"{n}_{p}") for p in PILLARS for n, f in (("s", F.sum), ("n", F.count))), F.collect_list(F.struct("indicator", "pillar", "score")).alias("cells"))  # as many as indicators
    wide = wide.join(quality(spark, sf_dir).select("entity", *(f"{p}_b" for p in PILLARS)), "entity").join(sized(spark, sf_dir).select("entity", "size"), "entity")
    whole = F.array(F.struct(F.lit("").alias("indicator"), F.lit("").alias("pillar"), F.lit(0.0).alias("score")))
    gone = wide.withColumn("g", F.explode(F.concat("cells", whole)))
    hit = lambda p: F.col("g.pillar") == p
    mean = lambda p: (F.col(f"s_{p}") - F.when(hit(p), F.col("g.score")).otherwise(0.0)) / F.nullif(F.col(f"n_{p}") - hit(p).cast("int"), F.lit(0))
    gone = gone.withColumns({f"{p}_p": mean(p) for p in PILLARS}).withColumn("q", C.blocked_mean([(f"{p}_p", f"{p}_b", WEIGHTS[p]) for p in PILLARS]))
    scores = reused(gone.select(F.col("g.indicator").alias("left_out"), "entity", F.round(C.geometric("size", "q", 0.5), 7).alias("v")))
    r = reused(ranks.in_order(scores, "v", "entity", by=("left_out",)).select("left_out", "entity", F.col("position").alias("r")))
    both = r.where("left_out <> ''").join(r.where("left_out = ''").select("entity", F.col("r").alias("b")), "entity")
    d = F.abs(F.col("r") - F.col("b"))
    return both.groupBy("left_out").agg(F.max(d).cast("long").alias("max_shift"), F.round(F.avg(d), 6).alias("mean_shift"))


#: The outlook's own tree: the number of orders counts as momentum, so that this pillar passes the coverage gate.
OUTLOOK_TREE = [(i, "momentum" if i == "n_orders" else p, d) for i, p, d in TREE]
OUTLOOK = {"returns": 0.4, "pricing": 0.3, "demand": 0.1, "momentum": 0.2}
_VIEWS = {"current": OUTLOOK | {"momentum": 0.0}, "future": OUTLOOK | {"momentum": 3 * OUTLOOK["momentum"]}}


def _view_sql(view: str) -> str:
    w = f"CASE WHEN missing_share > 1.0 / 3 THEN 0 ELSE CASE pillar {' '.join(f'WHEN {p!r} THEN {v}' for p, v in _VIEWS[view].items())} END END"
    return f"CASE WHEN sum({w}) > 0 THEN sum({w} * p) / sum({w}) ELSE sum(p) / {len(OUTLOOK)} END AS q_{view}"


@query(INDEX + ", ot AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{p}', {d})" for i, p, d in OUTLOOK_TREE) + f""") t(indicator, pillar, direction)),
op AS (SELECT entity, pillar, avg(100 * CASE WHEN direction < 0 THEN 1 - r ELSE r END) AS p FROM (SELECT *, {pct_rank_sql('value', 'indicator')} AS r FROM imp) JOIN ot USING (indicator) GROUP BY ALL),
ob AS (SELECT entity, pillar, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM kept JOIN ot USING (indicator) GROUP BY ALL),
oq AS (SELECT entity, {_view_sql('current')}, {_view_sql('future')}, round(max(CASE WHEN pillar = 'momentum' THEN p END), 7) AS momentum FROM op JOIN ob USING (entity, pillar) GROUP BY 1),
og AS (SELECT entity, momentum, q_future, round({_geo('size', 'q_current')}, 6) AS current, round(size * (0.9 + 0.4 * {pct_rank_sql('momentum')}), 7) AS grown FROM oq JOIN siz USING (entity)),
ov AS (SELECT entity, momentum, current, round({_geo('g', 'q_future', 0.45)}, 6) AS future FROM (SELECT *, 100 * {pct_rank_sql('grown')} AS g FROM og)),
place AS (SELECT *, {pct_rank_sql('momentum')} AS pm, {pct_rank_sql('current')} AS pc, CAST(floor(rank() OVER (ORDER BY current DESC) + (count(*) OVER (PARTITION BY current) - 1) / 2.0) AS BIGINT) AS rank_current,
  CAST(floor(rank() OVER (ORDER BY future DESC) + (count(*) OVER (PARTITION BY future) - 1) / 2.0) AS BIGINT) AS rank_future FROM ov)
SELECT entity, current, future, momentum, rank_current, rank_future, round(100 * (pm - pc), 5) AS growth_gap, momentum > (SELECT quantile_cont(momentum, 0.75) FROM place) AND rank_current > 100 AS growth_flag FROM place""")
def outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as it is and as it may become, with ranks, the gap between momentum and standing, and the flag of those to invest in ahead.

    Now: momentum weighs nothing. Outlook: momentum weighs three times its weight; size grows by 0.9 to 1.3 with the rank of the momentum pillar and is ranked anew. The flag: momentum
    above its upper quartile and a present rank beyond 100.
    """
    own = spark.createDataFrame([r for r in OUTLOOK_TREE if r[1] in OUTLOOK], "indicator string, pillar string, direction int")
    names = list(OUTLOOK)
    scores = matrix.pillars(imputed(spark, sf_dir), own).groupBy("entity").pivot("pillar", names).agg(F.first("score")).withColumnsRenamed({p: f"{p}_p" for p in names})
    flags = matrix.blocked(gated(spark, sf_dir), own).groupBy("entity").pivot("pillar", names).agg(F.first("blocked"))
    flags = flags.select("entity", *(F.coalesce(p, F.lit(False)).alias(f"{p}_b") for p in names))
    rows = scores.join(flags, "entity").join(sized(spark, sf_dir).select("entity", "size"), "entity")
    rows = rows.withColumns({f"q_{v}": C.blocked_mean([(f"{p}_p", f"{p}_b", w[p]) for p in names]) for v, w in _VIEWS.items()})
    rows = reused(rows.select("entity", F.round("momentum_p", 7).alias("momentum"), "size", "q_future", F.round(C.geometric("size", "q_current", 0.5), 6).alias("current")))
    rows = ranks.percent_ranks(rows, [], "momentum").withColumnRenamed("score", "pm")
    rows = reused(rows.withColumn("grown", F.round(F.col("size") * (0.9 + 0.4 * F.col("pm") / 100), 7)))
    rows = reused(ranks.percent_ranks(rows, [], "grown").withColumn("future", F.round(C.geometric("score", "q_future", 0.45), 6)))
    for view in _VIEWS:
        rows = ranks.average_ranks(rows.withColumn("_v", -F.col(view)), [], "_v").withColumn(f"rank_{view}", F.floor("rank").cast("long")).drop("rank", "n", "_v")
    rows = reused(ranks.percent_ranks(rows.drop("score"), [], "current").withColumnRenamed("score", "pc"))
    high = quantiles(rows, [], "momentum", [0.75]).select(F.col("quantiles")[0]).scalar()
    return rows.select("entity", "current", "future", "momentum", "rank_current", "rank_future", F.round(F.col("pm") - F.col("pc"), 5).alias("growth_gap"), ((F.col("momentum") > high) & (F.col("rank_current") > 100)).alias("growth_flag"))


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _moments(columns: list[str]) -> str:
    return ", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for a in columns for b in columns + ["y"])


_GRAM = [[f"c_{a}_{b}" for b in PILLARS] for a in PILLARS]
_COEF = {p: _det([[f"c_{a}_y" if j == k else x for j, x in enumerate(row)] for a, row in zip(PILLARS, _GRAM)]) + " / " + _det(_GRAM) for k, p in enumerate(PILLARS)}


@query(INDEX + f""", bo AS (SELECT entity, spend, balance, urgent_share FROM feat WHERE balance IS NOT NULL AND urgent_share IS NOT NULL AND spend IS NOT NULL),
yy AS (SELECT entity, spend, round(((balance - avg(balance) OVER ()) / stddev_samp(balance) OVER () + (urgent_share - avg(urgent_share) OVER ()) / stddev_samp(urgent_share) OVER ()) / 2, 9) AS y FROM bo),
xs AS (SELECT entity, """ + ", ".join(f"max(CASE WHEN pillar = '{p}' THEN score END) AS {p}" for p in PILLARS) + f""" FROM pil GROUP BY 1),
d AS (SELECT yy.*, xs.* EXCLUDE (entity), round(quality, 7) AS quality FROM yy JOIN xs USING (entity) JOIN qual USING (entity)),
m AS (SELECT {_moments(PILLARS)} FROM d),
co AS (""" + " UNION ALL ".join(f"SELECT '{p}' AS name, {x} AS b FROM m" for p, x in _COEF.items()) + f"""),
ba AS (SELECT 'size' AS name, corr(a, b) AS r FROM (SELECT {pct_rank_sql('spend')} AS a, {pct_rank_sql('y')} AS b FROM d) UNION ALL SELECT 'quality', corr(a, b) FROM (SELECT {pct_rank_sql('quality')} AS a, {pct_rank_sql('y')} AS b FROM d))
SELECT 'coefficient' AS kind, name, round(b, 7) AS value, b < 0 AS wrong_sign FROM co UNION ALL SELECT 'baseline', name, round(r, 6), NULL FROM ba
UNION ALL SELECT 'verdict', CASE WHEN count(*) FILTER (WHERE b < 0) = 0 THEN 'supports' ELSE 'partly disconfirms: ' || string_agg(name, ', ' ORDER BY name) FILTER (WHERE b < 0) END, NULL, count(*) FILTER (WHERE b < 0) > 0 FROM co""")
def sign_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, value, wrong_sign: least-squares coefficients of the pillars for a target outside them (the mean z of two measures), the rank correlations that any model has to beat
    (size alone, quality alone), and a verdict: a pillar with a negative coefficient speaks against its direction."""
    fields = ["balance", "urgent_share"]
    rows = features(spark, sf_dir).select("entity", "spend", *fields).dropna()
    rows = ranks.with_scalar(rows, rows.agg(*(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("m", F.avg), ("s", F.stddev_samp)))))
    z = sum((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in fields) / 2
    told = quality(spark, sf_dir).select("entity", *(F.col(f"{p}_p").alias(p) for p in PILLARS), F.round("quality", 7).alias("quality"))
    rows = reused(rows.select("entity", "spend", F.round(z, 9).alias("y")).join(told, "entity"))
    pairs = [(a, b) for a in PILLARS for b in [*PILLARS, "y"]]
    sums = rows.agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()  # as many numbers as pillars squared
    value = lambda a, b: sums[f"{a}|{b}"] or 0.0
    found = np.linalg.lstsq(np.array([[value(a, b) for b in PILLARS] for a in PILLARS]), np.array([value(a, "y") for a in PILLARS]), rcond=None)[0]
    against = sorted(p for p, b in zip(PILLARS, found) if b < 0)
    out = [("coefficient", p, round(float(b), 7), bool(b < 0)) for p, b in zip(PILLARS, found)]
    out.append(("verdict", "partly disconfirms: " + ", ".join(against) if against else "supports", None, bool(against)))
    own = spark.createDataFrame(out, "kind string, name string, value double, wrong_sign boolean")
    for name, column in (("size", "spend"), ("quality", "quality")):
        rho = stats.spearman(rows, column, "y").select(F.lit("baseline").alias("kind"), F.lit(name).alias("name"), F.round("rho", 6).alias("value"), F.lit(None).cast("boolean").alias("wrong_sign"))
        own = own.unionByName(rho)
    return own
