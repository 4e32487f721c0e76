"""Model queries: sampling adequacy, collinearity, principal components, cross-validated regressions, clusters, sensitivity."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.special import chi2_tail
from ..operators import matrix, ranks, stats
from ..operators.draws import Scorer, top_in_draws
from ..operators.storage import shared_folder
from .base import FEAT, INDEX, PILLAR, PILLARS, TREE, WEIGHTS, features, gated, imputed, pct_rank_sql, query, reused, table, tree
from .index import assembled, scored
from .validation import draw_weight, factors_sql, rounded_up, uniform, weighed


def correlation_matrix(rows: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Indicators, their Pearson matrix (as many numbers as indicators squared) and the entities behind it."""
    pairs = stats.pearson_pairs(rows).collect()
    names = sorted({r[k] for r in pairs for k in ("a", "b")})
    out = np.eye(len(names))
    for r in pairs:
        i, j = names.index(r["a"]), names.index(r["b"])
        out[i, j] = out[j, i] = r["r"]
    return names, out, max((r["n"] for r in pairs), default=0)


def precision(r: np.ndarray) -> tuple[np.ndarray, float]:
    """The inverse of a correlation matrix and the logarithm of its determinant, by its Cholesky factor; a factor that fails gets a little weight on its diagonal."""
    for weight in (0.0, 1e-12, 1e-9, 1e-6):
        try:
            factor = np.linalg.cholesky(r + weight * np.eye(len(r)))
        except np.linalg.LinAlgError:
            continue
        half = np.linalg.solve(factor, np.eye(len(r)))
        return half.T @ half, 2 * float(np.log(np.diag(factor)).sum())
    raise ValueError("the correlation matrix has negative directions")


def adequacy(r: np.ndarray, n: int) -> tuple[float, float, int]:
    """Kaiser-Meyer-Olkin measure (squared correlations against squared partial ones), Bartlett's chi-square that all correlations are zero, its degrees of freedom."""
    inverse, log_det = precision(r)
    pairs = np.triu_indices(len(r), 1)
    shared = sum(float(v) ** 2 for v in r[pairs])
    own = inverse.diagonal()
    left = sum(float(inverse[i, j]) ** 2 / (own[i] * own[j]) for i, j in zip(*pairs))
    return shared / (shared + left), -log_det * (n - 1 - (2 * len(r) + 5) / 6), len(pairs[0])


@query()
def kmo_bartlett(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmo, chi2, dof, p of the complete matrix."""
    _, r, n = correlation_matrix(imputed(spark, sf_dir))
    kmo, chi2, dof = adequacy(r, n)
    return spark.createDataFrame([(float(kmo), float(chi2), dof)], "kmo double, chi2 double, dof int").withColumn("p", chi2_tail("chi2", "dof"))


@query()
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    names, r, _ = correlation_matrix(imputed(spark, sf_dir))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, precision(r)[0].diagonal())], "indicator string, vif double")


@query()
def pca_pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first and the first two components of a pillar's standardised indicators explain."""
    names, r, _ = correlation_matrix(imputed(spark, sf_dir))
    out = []
    for pillar in sorted({p for _, p, _ in TREE}):
        own = [names.index(i) for i, p, _ in TREE if p == pillar and i in names]
        if own:
            values = np.sort(np.linalg.eigvalsh(r[np.ix_(own, own)]))[::-1]
            out.append((pillar, float(values[0] / values.sum()), float(values[:2].sum() / values.sum())))
    return spark.createDataFrame(out, "pillar string, first double, first_two double")


@query()
def pca_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute loadings of the first component, scaled to sum to one."""
    names, r, _ = correlation_matrix(imputed(spark, sf_dir))
    load = np.abs(np.linalg.eigh(r)[1][:, -1])
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, load / load.sum())], "indicator string, weight double")


def balanced_folds(sizes: dict, k: int = 5) -> dict:
    """Groups to folds, the largest first, each to the fold with the fewest rows."""
    load, out = [0] * k, {}
    for group, n in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        fold = load.index(min(load))
        out[group], load[fold] = fold, load[fold] + n
    return out


#: Regressors by name. Ridge and lasso penalties are those of least squares with unscaled labels (ridge: alpha * sd(y) / n).
MODELS = {
    "linear": lambda n, sd: LinearRegression(solver="normal"),
    "ridge": lambda n, sd: LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=1.0 * sd / n),
    "lasso": lambda n, sd: LinearRegression(standardization=False, elasticNetParam=1.0, regParam=0.01, tol=1e-9, maxIter=200),
    "forest": lambda n, sd: RandomForestRegressor(numTrees=400, minInstancesPerNode=3, seed=42),
    "boosting": lambda n, sd: GBTRegressor(maxIter=300, maxDepth=3, stepSize=0.05, seed=42),
}


def out_of_fold(rows: DataFrame, inputs: list[str], models: tuple[str, ...], k: int) -> DataFrame:
    """rows (entity, fold, y, inputs) predicted by models that were fitted on the other folds: one long frame of model, entity, fold, y, predicted."""
    data = reused(VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("entity", "fold", "y", "features"))
    out = None
    for f in range(k):
        train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
        for name in models:
            model = MODELS[name](n, sd or 1.0).setLabelCol("y").setPredictionCol("predicted").fit(train)
            part = model.transform(test).select(F.lit(name).alias("model"), "entity", "fold", "y", "predicted")
            out = part if out is None else out.unionByName(part)
    return out


def group_cv(rows: DataFrame, inputs: list[str], models: tuple[str, ...], k: int = 5) -> DataFrame:
    """out_of_fold() of rows (entity, grp, y, inputs). Folds are whole groups."""
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}  # one row a group
    fold = F.element_at(F.from_json(F.lit(json.dumps({str(g): f for g, f in balanced_folds(sizes, k).items()})), "map<string,int>"), F.col("grp").cast("string"))
    return out_of_fold(rows.withColumn("fold", fold), inputs, models, min(k, len(sizes)))


def random_folds(rows: DataFrame, k: int) -> DataFrame:
    """rows with `fold` from a hash of the entity, which SQL can repeat."""
    return rows.withColumn("fold", (F.pmod(F.col("entity") * 2654435761, F.lit(1000003)) % k).cast("int"))


def errors(told: DataFrame, by: list[str]) -> DataFrame:
    """by, n, r2, rmse, mae of predictions, as one aggregate."""
    miss = F.col("y") - F.col("predicted")
    r2 = 1 - F.sum(miss * miss) / F.nullif(F.var_pop("y") * F.count(F.lit(1)), F.lit(0.0))
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r2.alias("r2"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"))


def permuted(rows: DataFrame, inputs: list[str], model, draws: int = 30) -> DataFrame:
    """input, drop, sd: how much a fitted model's R2 falls on average, over `draws` shuffles of one input's column, and the deviation over shuffles.

    A shuffle gives each row the value of the row at its place in an order by a hash of (entity, draw). All draws and inputs are one long frame that is scored once.
    """
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    rows = rows.select("entity", "y", *inputs)
    whole = errors(model.transform(assembler.transform(rows)), []).select("r2").scalar()
    at = ranks.in_order(rows, "entity", "entity", descending=False).withColumnRenamed("position", "at")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("h", F.pmod(F.xxhash64("entity", "draw"), F.lit(1 << 40)))
    given = ranks.in_order(drawn, "h", "entity", by=("draw",)).select("draw", F.col("position").alias("at"), *(F.col(c).alias(f"_{c}") for c in inputs))
    mixed = at.join(given, "at").withColumn("input", F.explode(F.array(*(F.lit(c) for c in inputs))))
    mixed = mixed.select("draw", "input", "y", *(F.when(F.col("input") == c, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in inputs))
    fell = errors(model.transform(assembler.transform(mixed)), ["input", "draw"]).withColumn("drop", whole - F.col("r2"))
    return fell.groupBy("input").agg(F.avg("drop").alias("drop"), F.stddev_samp("drop").alias("sd"))


_PAIRS_XY = FEAT + ", xy AS (SELECT entity, spend AS x, urgent_price AS y, (entity * 2654435761) % 1000003 % 5 AS fold FROM feat WHERE spend IS NOT NULL AND urgent_price IS NOT NULL)"


def _one_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("spend is not null and urgent_price is not null").select("entity", F.col("spend").alias("x"), F.col("urgent_price").alias("y"))


@query(_PAIRS_XY + """, f AS (SELECT unnest(range(5)) AS fold), m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN xy ON xy.fold <> f.fold GROUP BY 1),
p AS (SELECT y, y - a - b * x AS miss FROM xy JOIN m USING (fold)) SELECT 'linear' AS model, count(*) AS n, round(1 - sum(miss * miss) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(miss * miss)), 3) AS rmse, round(avg(abs(miss)), 3) AS mae FROM p""")
def kfold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold errors of a line, five random folds."""
    told = out_of_fold(random_folds(_one_input(spark, sf_dir), 5), ["x"], ("linear",), 5)
    return errors(told, ["model"]).select("model", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query(_PAIRS_XY + ", m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM xy) SELECT entity, round(a + b * x, 3) AS predicted FROM xy, m")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline written, read again and asked: what was read predicts what the line gives."""
    rows, folder = _one_input(spark, sf_dir), shared_folder(spark, "model")
    Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", predictionCol="predicted", solver="normal")]).fit(rows).write().overwrite().save(folder)
    return PipelineModel.load(folder).transform(rows).select("entity", F.round("predicted", 3).alias("predicted"))


@query()
def holdout_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, n, r2, rmse, mae on the one fold in five that was held out."""
    rows, inputs = _target(spark, sf_dir)
    return errors(out_of_fold(random_folds(rows, 5), inputs, ("linear", "ridge", "lasso", "forest"), 1), ["model"])


def surrogate(rows: DataFrame, depth: int = 4) -> DataFrame:
    """One row: depth, nodes, fidelity, share: how well a tree of at most `depth` levels tells the labels of rows (label, features), and the largest label's own share."""
    model = DecisionTreeClassifier(maxDepth=depth, labelCol="label", predictionCol="told", seed=1).fit(rows)
    told = model.transform(rows)
    share = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    return told.agg(F.avg((F.col("told") == F.col("label")).cast("double")).alias("fidelity")).select(F.lit(model.depth).alias("depth"), F.lit(model.numNodes).alias("nodes"), "fidelity", share.alias("share"))


@query()
def surrogate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a small tree explains the clusters of the embeddings."""
    rows = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    told = KMeans(k=4, seed=7, maxIter=10).fit(rows).transform(rows)
    return surrogate(reused(told.select(F.col("prediction").cast("double").alias("label"), "features")))


def _target(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    inputs = ["discount", "tax", "quantity", "return_share"]
    rows = features(spark, sf_dir).dropna(subset=[*inputs, "spend"]).select("entity", "grp", *inputs, "spend")
    by = ranks.with_scalar(rows, rows.agg(*(f(c).alias(f"{n}_{c}") for c in ["spend", *inputs] for n, f in (("m", F.avg), ("s", F.stddev_samp)))))
    return by.select("entity", "grp", *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("y" if c == "spend" else c) for c in ["spend", *inputs])), inputs


@query()
def group_cv_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, r2, rho, n of out-of-fold predictions: five balanced folds of whole nations."""
    rows, inputs = _target(spark, sf_dir)
    told = reused(group_cv(rows, inputs, ("linear", "ridge", "lasso")))
    fit = errors(told, ["model"]).select("model", "r2", "n")
    placed = ranks.average_ranks(told, ["model"], "y").withColumnRenamed("rank", "ry").drop("n")
    placed = ranks.average_ranks(placed, ["model"], "predicted")
    return fit.join(placed.groupBy("model").agg(F.corr("ry", "rank").alias("rho")), "model", "left")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input, drop, sd of the linear model over 30 shuffles."""
    rows, inputs = _target(spark, sf_dir)
    rows = reused(rows)
    model = LinearRegression(labelCol="y", predictionCol="predicted", solver="normal").fit(VectorAssembler(inputCols=inputs, outputCol="features").transform(rows))
    return permuted(rows, inputs, model)


@query()
def kmeans_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k from 3 to 8 by silhouette, and each cluster of the best: its size, share, and the mean of its members' first coordinates."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"), F.col("embedding")[0].cast("double").alias("first"))
    scaled = reused(StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows))
    judge, best = ClusteringEvaluator(), None
    for k in range(3, 9):
        told = KMeans(k=k, seed=7, maxIter=10).fit(scaled).transform(scaled)
        score = judge.evaluate(told)
        if best is None or score > best[0]:
            best = score, k, told
    score, k, told = best
    n = told.agg(F.count(F.lit(1))).scalar()
    return told.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg("first").alias("first")).select("cluster", "n", (F.col("n") / n).alias("share"), "first", F.lit(k).alias("k"), F.lit(float(score)).alias("silhouette"))


#: What each leg weighs its pillars by, and the fields that reveal what it should follow.
LEGS = {"returns": {"returns": 0.6, "pricing": 0.3, "demand": 0.1}, "demand": {"returns": 0.1, "pricing": 0.3, "demand": 0.6}}
PROXIES = {"returns": ["return_qty"], "demand": ["n_orders", "urgent_p"]}
CONTAMINANTS = sorted({f for fields in PROXIES.values() for f in fields})
_PAIR = "leg, proxy"


@query(PILLAR + ", clean AS (SELECT entity, pillar, avg(score) AS score FROM norm WHERE indicator NOT IN (" + ", ".join(f"'{c}'" for c in CONTAMINANTS) + ") AND pillar IN (" + ", ".join(f"'{p}'" for p in PILLARS) + ") GROUP BY ALL), "
    + "lw AS (SELECT * FROM (VALUES " + ", ".join(f"('{leg}', '{p}', {w})" for leg, own in LEGS.items() for p, w in own.items()) + ") v(leg, pillar, b)), "
    + "live AS (SELECT leg, entity, score, CASE WHEN missing_share > 1.0 / 3 THEN 0 ELSE b END AS w FROM clean JOIN blk USING (entity, pillar) JOIN lw USING (pillar)), "
    + f"legs AS (SELECT leg, entity, round(CASE WHEN sum(w) > 0 THEN sum(w * score) / sum(w) ELSE sum(score) / {len(PILLARS)} END, 7) AS x FROM live GROUP BY ALL), pr AS ("
    + " UNION ALL ".join(f"SELECT entity, '{k}' AS proxy, round(list_avg([{', '.join(pct_rank_sql(f) for f in fields)}]), 6) AS y FROM feat" for k, fields in PROXIES.items())
    + f"), pairs AS (SELECT leg, proxy, x, y FROM legs JOIN pr USING (entity) WHERE y IS NOT NULL) SELECT leg, proxy, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT leg, proxy, {pct_rank_sql('x', _PAIR)} AS rx, {pct_rank_sql('y', _PAIR)} AS ry FROM pairs) GROUP BY ALL")
def discriminant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, proxy, rho, n: whether each leg of the index follows its own proxy more than the other's.

    The fields that proxies are made of leave the index before its pillars are built, so that none is correlated with itself; blocked pillars stay those of
    the whole index. A proxy is the mean of its fields' percentile ranks, nulls skipped. All pairs are ranked in one long call.
    """
    cells = imputed(spark, sf_dir).withColumn("missing", ~F.col("provenance").eqNullSafe("observed"))
    fields = F.col("indicator").isin(CONTAMINANTS)
    clean = matrix.normalised(cells.where(~fields), tree(spark)).select("entity", "pillar", "score", "missing")
    away = cells.where(fields).join(F.broadcast(tree(spark)), "indicator").select("entity", "pillar", F.lit(None).cast("double").alias("score"), "missing")
    wide = matrix.pillar_columns(clean.unionByName(away), PILLARS)
    legs = F.array(*(F.struct(F.lit(leg).alias("leg"), F.round(C.blocked_mean([(f"{p}_p", f"{p}_b", own[p]) for p in PILLARS]), 7).alias("x")) for leg, own in LEGS.items()))
    owner = F.create_map(*(F.lit(x) for k, fields in PROXIES.items() for f in fields for x in (f, k)))
    placed = ranks.percent_ranks(matrix.to_long(features(spark, sf_dir), ["entity"], CONTAMINANTS), ["indicator"])
    proxies = placed.groupBy("entity", owner[F.col("indicator")].alias("proxy")).agg(F.round(F.avg("score") / 100, 6).alias("y")).where("y is not null")
    pairs = wide.select("entity", F.inline(legs)).join(proxies, "entity").select("leg", "proxy", "x", "y")
    both = ranks.average_ranks(reused(pairs), ["leg", "proxy"], "x").withColumnRenamed("rank", "rx").drop("n")
    both = ranks.average_ranks(reused(both), ["leg", "proxy"], "y")
    return both.groupBy("leg", "proxy").agg(F.round(F.corr("rx", "rank"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


METHODS, NONE = ["rank", "minmax", "z"], "none"
ARMS = 400


def arm(draw: int) -> tuple[str, bool, int]:
    """A draw's normaliser, whether size and quality meet by a geometric mean, and the number that picks what is left out: each axis by a hash of its own, so all combinations occur."""
    return METHODS[int(uniform(draw, "method") * 3)], uniform(draw, "mean") < 0.5, int(uniform(draw, "left out") * 2**40)


_ARMS = "(VALUES " + ", ".join("({}, '{}', {}, {}::BIGINT)".format(d, *arm(d)) for d in range(ARMS)) + ") v(draw, method, geo, pick)"
_FOUR = INDEX + f""", st AS (SELECT indicator, min(value) AS a, max(value) AS z, avg(value) AS m, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS s FROM imp GROUP BY 1),
nrm AS (SELECT 'rank' AS method, entity, indicator, pillar, 100 * CASE WHEN direction < 0 THEN 1 - r ELSE r END AS score FROM (SELECT *, {pct_rank_sql('value', 'indicator')} AS r FROM imp) JOIN tree USING (indicator)
 UNION ALL SELECT 'minmax', entity, indicator, pillar, CASE WHEN direction < 0 THEN 100 - x ELSE x END FROM (SELECT imp.*, CASE WHEN z > a THEN 100 * (value - a) / (z - a) ELSE 50.0 END AS x FROM imp JOIN st USING (indicator)) JOIN tree USING (indicator)
 UNION ALL SELECT 'z', entity, indicator, pillar, 50 + direction * 10 * (value - m) / s FROM imp JOIN st USING (indicator) JOIN tree USING (indicator)),
ix AS (SELECT indicator, row_number() OVER (ORDER BY indicator) - 1 AS i FROM (SELECT DISTINCT indicator FROM imp)), k AS (SELECT count(*) AS k FROM ix),
dr AS (SELECT draw, method, geo, coalesce(indicator, 'none') AS gone FROM (SELECT v.*, pick % (k + 1) AS i FROM {_ARMS}, k) LEFT JOIN ix USING (i)),
combos AS (SELECT DISTINCT method, gone FROM dr), pa AS (SELECT c.method, c.gone, entity, pillar, avg(score) AS p FROM nrm JOIN combos c ON c.method = nrm.method AND nrm.indicator <> c.gone GROUP BY ALL),
fq AS (SELECT draw, geo, entity, CASE WHEN sum(w * f) > 0 THEN sum(w * f * p) / sum(w * f) ELSE sum(p) / {len(PILLARS)} END AS q
  FROM dr JOIN {factors_sql(ARMS)} USING (draw) JOIN pa USING (method, gone, pillar) JOIN (SELECT entity, pillar, w FROM live) USING (entity, pillar) GROUP BY ALL),
sc AS (SELECT draw, entity, round(CASE WHEN geo THEN 100 * pow(greatest(least(size, 100.0), 1.0) / 100, 0.5) * pow(greatest(least(q, 100.0), 1.0) / 100, 0.5) ELSE 0.5 * size + 0.5 * q END, 7) AS s FROM fq JOIN siz USING (entity)),
rk AS (SELECT draw, entity, row_number() OVER (PARTITION BY draw ORDER BY s DESC, entity) AS r FROM sc)"""


def four_axis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], Scorer]:
    """One row an entity, its columns, and their scores in draws by the whole index: weights within a quarter of their size, three normalisers, two means of size and quality, and one indicator or none left out.

    A row has each indicator's value and rank score once; the other normalisers, the pillars without one indicator and the draws are made from these as arrays beside it. Where size is missing, the arithmetic mean has no score and comes last.
    """
    names = sorted(r["indicator"] for r in gated(spark, sf_dir).select("indicator").distinct().collect())
    ends = imputed(spark, sf_dir).groupBy("indicator").agg(F.min("value").alias("a"), F.max("value").alias("z"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    known = {r["indicator"]: r for r in ends.collect()}  # as many rows as indicators
    way, pillar = {i: d for i, _, d in TREE}, {i: p for i, p, _ in TREE}
    cell = lambda i, x: F.max(F.when(F.col("indicator") == i, F.col(x)))
    columns = ["size", *(f"{p}_b" for p in PILLARS), *(f"{x}_{i}" for i in names for x in ("value", "score"))]
    rows = assembled(spark, sf_dir, tuple(cell(i, x).alias(f"{x}_{i}") for i in names for x in ("value", "score"))).select("entity", *columns)
    drawn = [arm(d) for d in range(ARMS)]
    left = [[*names, NONE][pick % (len(names) + 1)] for _, _, pick in drawn]
    weights = {p: np.array([WEIGHTS[p] * draw_weight(d, p) for d in range(ARMS)]) for p in PILLARS}

    def normal(method: str, i: str, own: dict[str, np.ndarray]) -> np.ndarray:
        if method == "rank":
            return own[f"score_{i}"]
        v, (a, z, m, s) = own[f"value_{i}"], (known[i][x] for x in "azms")
        if method == "z":
            return 50 + way[i] * 10 * (v - m) / (s if s and s > 0 else 1.0)
        x = 100 * (v - a) / (z - a) if z > a else np.where(np.isnan(v), np.nan, 50.0)
        return 100 - x if way[i] < 0 else x

    def score(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        own = {c: x.astype(float) for c, x in zip(columns, arrays)}
        kinds: dict[tuple, list[int]] = {}
        for k, d in enumerate(at):
            kinds.setdefault((drawn[d][0], left[d]), []).append(k)
        cells = {m: {i: normal(m, i, own) for i in names} for m in {m for m, _ in kinds}}
        out = np.empty((len(at), len(arrays[0])))
        size = np.clip(np.where(np.isnan(own["size"]), 100.0, own["size"]), 1.0, 100.0)
        for (method, gone), ks in kinds.items():
            parts = []
            for p in PILLARS:
                mine = [cells[method][i] for i in names if pillar[i] == p and i != gone]
                if mine:
                    n = sum((~np.isnan(x)).astype(int) for x in mine)
                    parts.append((sum(np.nan_to_num(x) for x in mine) / np.maximum(n, 1), own[f"{p}_b"] > 0, weights[p][at[ks]]))
            q = weighed(parts)
            geometric = np.array([drawn[d][1] for d in at[ks]])[:, None]
            out[ks] = np.where(geometric, 100 * np.sqrt(size / 100) * np.sqrt(np.clip(q, 1.0, 100.0) / 100), 0.5 * own["size"] + 0.5 * q)
        return np.nan_to_num(rounded_up(out, 7), copy=False, nan=-np.inf)

    return rows, columns, score


@query(_FOUR + ", base AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY overall DESC, entity) AS r FROM score) WHERE r <= 50) SELECT CAST(draw AS BIGINT) AS draw, count(*) AS overlap FROM rk JOIN base USING (entity) WHERE r <= 50 GROUP BY 1")
def mc_four_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the index's top 50 each of the 400 draws keeps."""
    base = scored(spark, sf_dir).orderBy(F.col("overall").desc(), "entity").limit(50).select("entity")
    rows, columns, score = four_axis(spark, sf_dir)
    return top_in_draws(reused(rows), columns, ARMS, score, 50).join(base, "entity").groupBy(F.col("draw").cast("long").alias("draw")).agg(F.count(F.lit(1)).alias("overlap"))
