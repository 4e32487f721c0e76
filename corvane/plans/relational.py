"""Relational queries: cleaning, two-stage aggregates, joins, set operations, roll-ups and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import resolve as R
from .base import FEAT, features, query, table


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(max(c_acctbal) - min(c_acctbal), 6) AS spread, arg_max(c_custkey, c_acctbal) AS best, arg_min(c_custkey, c_acctbal) AS worst, count(*) FILTER (WHERE c_acctbal > 5000) AS n_rich FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    first = lambda sign: F.when(b.isNotNull(), F.struct(b, sign * k))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(b), 6).alias("mean"), F.round(F.max(b) - F.min(b), 6).alias("spread"),
        F.max_by(k, first(-1)).alias("best"), F.min_by(k, first(1)).alias("worst"),  # ties to the smaller key
        F.count_if(b > 5000).alias("n_rich"),
    )


@query("SELECT o_orderpriority AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS pct FROM orders GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.count(F.lit(1))).scalar()
    return orders.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / total, 6))


@query("SELECT CAST(least(19, floor((c_acctbal - lo) / ((hi - lo) / 20))) AS BIGINT) AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 bins of equal width, the last one closed."""
    rows = table(spark, sf_dir, "customer").select("c_acctbal")
    ends = rows.agg(F.struct(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))).scalar()
    return rows.groupBy(F.least(F.lit(19), F.floor((F.col("c_acctbal") - ends["lo"]) / ((ends["hi"] - ends["lo"]) / 20))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS flag, NULL AS status, sum(l_quantity) AS q FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, NULL, l_linestatus, sum(l_quantity) FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS orderkey, flag, q FROM c WHERE flag IS NOT NULL AND status IS NULL""")
def cube_cut_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pre-cut cube rows, those with exactly one active dimension, which is the return flag."""
    li = table(spark, sf_dir, "lineitem")
    cut = lambda flag, status: li.groupBy("l_orderkey", *([flag] if flag else []), *([status] if status else [])).agg(F.sum("l_quantity").alias("q"))
    rows = cut("l_returnflag", None).unionByName(cut(None, "l_linestatus"), allowMissingColumns=True).unionByName(cut("l_returnflag", "l_linestatus"), allowMissingColumns=True)
    active = F.filter(F.array("l_returnflag", "l_linestatus"), lambda x: x.isNotNull())
    return rows.where((F.size(active) == 1) & F.col("l_returnflag").isNotNull()).select(F.col("l_orderkey").alias("orderkey"), F.col("l_returnflag").alias("flag"), "q")


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, 'flag' AS level, l_returnflag AS k, sum(l_quantity) AS q FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, l_suppkey, 'status', l_linestatus, sum(l_quantity) FROM lineitem GROUP BY ALL),
m AS (SELECT l_orderkey, l_suppkey, level, max(q) AS q FROM s GROUP BY ALL) SELECT l_suppkey AS supplier, sum(q) AS q FROM (SELECT l_orderkey, l_suppkey, max(q) AS q FROM m GROUP BY ALL) GROUP BY 1""")
def level_max_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of alternative enumerations, then sums of those."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    each = li.select("l_orderkey", "l_suppkey", "l_quantity", F.explode(F.array(F.struct(F.lit("flag").alias("level"), F.col("l_returnflag").alias("k")), F.struct(F.lit("status").alias("level"), F.col("l_linestatus").alias("k")))).alias("x"))
    sums = each.groupBy("l_orderkey", "l_suppkey", "x").agg(F.sum("l_quantity").alias("q"))
    return sums.groupBy("l_orderkey", "l_suppkey").agg(F.max("q").alias("q")).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum("q").alias("q"))


@query("SELECT o_custkey AS customer, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0, ["F", "O", "P"])


@query("""SELECT o_custkey AS customer, count(*) FILTER (WHERE k LIKE '1-%_P' AND k NOT LIKE '1-0%') AS n FROM (SELECT o_custkey, o_orderpriority || '_' || o_orderstatus AS k FROM orders) GROUP BY 1""")
def prefix_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over keys chosen by how they begin and end."""
    k = F.concat_ws("_", "o_orderpriority", "o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count_if(k.startswith("1-") & k.endswith("_P") & ~k.startswith("1-0")).alias("n"))


@query("SELECT o_custkey AS customer, round(sum(o_totalprice), 4) AS total, 'orders' AS source FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT c_custkey, round(c_acctbal, 4), 'backfill' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def backfill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for missing keys only; present ones are never overridden."""
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("customer")).agg(F.round(F.sum("o_totalprice"), 4).alias("total")).withColumn("source", F.lit("orders"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.round("c_acctbal", 4).alias("total"), F.lit("backfill").alias("source"))
    return own.unionByName(other.join(own, "customer", "left_anti"))


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, round(arg_max(value, event_id), 6) AS last_value, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds, min(event_id) AS first_id FROM events GROUP BY 1")
def fold_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each key, its first one, and the sorted set of what it had."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_type"), F.round(F.max_by("value", "event_id"), 6).alias("last_value"), F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("kinds"), F.min("event_id").alias("first_id")
    )


@query("SELECT coalesce(c_custkey, o_custkey) AS code, c_name AS name, c_custkey IS NOT NULL AS in_customer, o_custkey IS NOT NULL AS in_orders FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def spine_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine of two sources that each lack codes of the other, with flags."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    both = a.join(b, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_custkey").isNotNull().alias("in_customer"), F.col("o_custkey").isNotNull().alias("in_orders"))


@query("WITH p AS (SELECT CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS code, acct FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, c_acctbal AS acct FROM customer)) SELECT p.code, round(acct, 6) AS balance, n FROM p JOIN (SELECT CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS code, n FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1)) USING (code)")
def padded_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that one side pads meet after both are padded."""
    a = table(spark, sf_dir, "customer").select(C.zero_padded(F.col("c_custkey").cast("string"), 3).alias("code"), F.round("c_acctbal", 6).alias("balance"))
    b = table(spark, sf_dir, "orders").groupBy(C.zero_padded(F.col("o_custkey").cast("string"), 3).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "code")


@query("SELECT p_partkey AS partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_retailprice * 2 END, p_retailprice) AS price FROM part")
def overlay_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repair table over a base, field by field; a null in the repair leaves the base."""
    part = table(spark, sf_dir, "part")
    fixes = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("partkey"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") * 2).alias("fixed"))
    base = part.select(F.col("p_partkey").alias("partkey"), "p_retailprice")
    return base.join(fixes, "partkey", "full_outer").select("partkey", F.coalesce("fixed", "p_retailprice").alias("price"))


@query("SELECT c_custkey AS code, c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("code"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("segment")).join(urgent, "code", "left_semi")


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey", "left_anti")


@query(FEAT + """, l AS (SELECT grp, round(sum(n_orders), 0) AS value FROM feat GROUP BY 1), t AS (SELECT f.grp, entity, coalesce(spend, 0) AS w, l.value FROM feat f JOIN l ON f.grp = l.grp)
SELECT grp AS block, entity AS code, round(value * CASE WHEN sum(w) OVER (PARTITION BY grp) > 0 THEN w / sum(w) OVER (PARTITION BY grp) ELSE 1.0 / count(*) OVER (PARTITION BY grp) END, 6) AS part FROM t""")
def prorate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's order count, spread over its customers by spend."""
    rows = features(spark, sf_dir)
    w = F.coalesce("spend", F.lit(0.0))
    sums = rows.groupBy("grp").agg(F.round(F.sum("n_orders"), 0).alias("value"), F.sum(w).alias("total"), F.count(F.lit(1)).alias("k"))
    part = F.col("value") * F.when(F.col("total") > 0, w / F.nullif(F.col("total"), F.lit(0.0))).otherwise(1.0 / F.col("k"))
    return rows.join(sums, "grp").select(F.col("grp").alias("block"), F.col("entity").alias("code"), F.round(part, 6).alias("part"))


@query("SELECT n_regionkey AS parent, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rollup_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("SELECT name, any_value(code) AS code FROM (SELECT c_mktsegment || '|' || c_nationkey AS name, c_custkey AS code FROM customer) GROUP BY 1 HAVING count(*) = 1")
def unique_target_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for exactly one code: a rate is never split."""
    name = F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")
    return table(spark, sf_dir, "customer").groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("code")).where("n = 1").drop("n")


#: Two states of the customers: what was ordered for at most in 1996, and since.
_A = "(SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)"
_B = "(SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1 HAVING max(year(o_orderdate)) > 1996)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    old = rows.where("y = 1996").groupBy("id").agg(F.max("v").alias("v"))
    return old, rows.where("y between 1996 and 1998").groupBy("id").agg(F.max("v").alias("v"), F.max("y").alias("y")).where("y > 1996").drop("y")


@query(f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'NEW' WHEN b.id IS NULL THEN 'MISSING' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'OK' ELSE 'CHANGED' END AS state FROM {_A} a FULL JOIN {_B} b ON a.id = b.id")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded state against the current one."""
    a, b = _two(spark, sf_dir)
    both = a.select("id", F.col("v").alias("x"), F.lit(True).alias("a")).join(b.select("id", F.col("v").alias("y"), F.lit(True).alias("b")), "id", "full_outer")
    return both.select("id", F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "MISSING").when(F.col("x").eqNullSafe(F.col("y")), "OK").otherwise("CHANGED").alias("state"))


@query(f"SELECT coalesce(a.id, b.id) AS id FROM {_A} a FULL JOIN {_B} b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    both = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full_outer")
    return both.where("a is null or b is null").select("id")


@query(f"SELECT id, 'old' AS source, v, NULL AS note FROM {_A} UNION ALL SELECT id, 'new', v, 'checked' FROM {_B}")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.withColumn("source", F.lit("old")).unionByName(b.withColumn("source", F.lit("new")).withColumn("note", F.lit("checked")), allowMissingColumns=True)


@query(f"SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.v) AS v FROM {_A} a FULL JOIN {_B} b ON a.id = b.id")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New fields over old ones, by key."""
    a, b = _two(spark, sf_dir)
    return a.withColumnRenamed("v", "old").join(b, "id", "full_outer").select("id", F.coalesce("v", "old").alias("v"))


#: Labels of parts are dirtied by rule: suffixes, marks, letters dropped.
_DIRTY = "CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || ' district' WHEN p_partkey % 4 = 1 THEN ' ' || p_name || '!' WHEN p_partkey % 4 = 2 THEN 'old ' || p_name ELSE substring(p_name, 1, length(p_name) - 1) END"
_SUFFIXES = ("district", "city", "corporation")


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    spine = part.groupBy(F.col("p_brand").alias("block"), C.normal_name("p_name").alias("nname")).agg(F.min("p_partkey").alias("code"))
    labels = part.select(F.col("p_brand").alias("block"), F.expr(_DIRTY).alias("label")).distinct()
    aliases = spine.where("code % 2 = 0").select("block", F.concat(F.lit("old "), "nname").alias("alias"), F.lit("RENAME").alias("category"), F.array("code").alias("targets"))
    return labels, spine, aliases


_NORM = "trim(regexp_replace(regexp_replace(replace(lower(trim({0})), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_CASCADE = f"""WITH spine AS (SELECT p_brand AS block, {_NORM.format('p_name')} AS nname, min(p_partkey) AS code FROM part GROUP BY ALL),
alias AS (SELECT block, 'old ' || nname AS alias, code FROM spine WHERE code % 2 = 0),
lab AS (SELECT DISTINCT p_brand AS block, {_DIRTY} AS label FROM part),
nm AS (SELECT *, {_NORM.format('label')} AS plain FROM lab),
st AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(plain, '\\s+(district|city|corporation)$', ''), '\\s+(district|city|corporation)$', ''), '\\s+(district|city|corporation)$', '') AS stripped FROM nm),
j AS (SELECT st.block, label, a.code AS e, b.code AS al, c.code AS se, d.code AS sa FROM st LEFT JOIN spine a ON a.block = st.block AND a.nname = plain LEFT JOIN alias b ON b.block = st.block AND b.alias = plain
  LEFT JOIN spine c ON c.block = st.block AND c.nname = stripped LEFT JOIN alias d ON d.block = st.block AND d.alias = stripped)
SELECT block, label, CASE WHEN e IS NOT NULL THEN 'EXACT' WHEN al IS NOT NULL THEN 'RENAME' WHEN se IS NOT NULL THEN 'SUFFIX+EXACT' WHEN sa IS NOT NULL THEN 'SUFFIX+RENAME' ELSE 'UNRESOLVED' END AS category, coalesce(e, al, se, sa) AS code FROM j"""


@query(_CASCADE)
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers that SQL can express: exact, alias, suffix-stripped."""
    return R.resolve(*_labels(spark, sf_dir), _SUFFIXES, fuzzy=False).select("block", "label", "category", F.col("codes")[0].alias("code"))


@query()
def fuzzy_block_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers, the fuzzy one included."""
    return R.resolve(*_labels(spark, sf_dir), _SUFFIXES).select("block", "label", "category", F.col("codes")[0].alias("code"))


@query()
def fuzzy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and codes of a block, each used once, the most alike first."""
    labels, spine, _ = _labels(spark, sf_dir)
    named = labels.withColumn("plain", C.normal_name("label"))
    found = R.similar_in_block(named, spine, "plain", 0.86).join(spine, ["block", "nname"])
    return R.one_to_one(named.join(found, ["block", "plain"]).select("block", "label", "code", F.col("ratio").alias("score")))


@query("""WITH s AS (SELECT p_brand AS block, p_name AS nname, min(p_partkey) AS code FROM part GROUP BY ALL), l AS (SELECT DISTINCT p_brand AS block, substring(p_name, 2) AS label FROM part)
SELECT block, label, d, code FROM (SELECT l.block, label, levenshtein(label, nname) AS d, code, row_number() OVER (PARTITION BY l.block, label ORDER BY levenshtein(label, nname), nname) AS r FROM l JOIN s ON l.block = s.block) WHERE r = 1""")
def nearest_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least edit distance within a block, ties to the first name."""
    part = table(spark, sf_dir, "part")
    spine = part.groupBy(F.col("p_brand").alias("block"), F.col("p_name").alias("nname")).agg(F.min("p_partkey").alias("code"))
    labels = part.select(F.col("p_brand").alias("block"), F.expr("substring(p_name, 2)").alias("label")).distinct()
    best = labels.join(spine, "block").groupBy("block", "label").agg(F.min(F.struct(F.levenshtein("label", "nname").cast("long").alias("d"), "nname", "code")).alias("b"))
    return best.select("block", "label", "b.d", "b.code")


@query(f"WITH spine AS (SELECT p_brand AS block, {_NORM.format('p_name')} AS nname, min(p_partkey) AS code FROM part GROUP BY ALL) SELECT p_brand AS block, p_name AS alias, p_partkey AS code FROM part WHERE p_partkey NOT IN (SELECT code FROM spine)")
def alias_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias targets that the spine lacks: every part is an alias here, and those that do not stand for their name are missing from the spine."""
    _, spine, _ = _labels(spark, sf_dir)
    aliases = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.col("p_name").alias("alias"), F.array("p_partkey").alias("targets"))
    return R.missing_targets(aliases, spine)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND (contains(lower(c_name), '7') OR contains(CAST(c_custkey AS VARCHAR), '7'))")
def view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list view's conjunctive filter with a needle over name or code."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0")
    return c.where(F.lower("c_name").contains("7") | F.col("c_custkey").cast("string").contains("7")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, " + _NORM.format("p_type || ' & ' || p_brand") + " AS name FROM part")
def slug_norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.slug("p_name").alias("slug"), C.normal_name(F.concat_ws(" & ", "p_type", "p_brand")).alias("name"))


@query("SELECT id, x, try_cast(CASE WHEN lower(trim(x)) IN ('nan', 'none', '', 'null') THEN NULL ELSE x END AS DOUBLE) AS v FROM (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN '' WHEN 2 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer)")
def missing_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 5 == 0, " NaN ").when(F.col("c_custkey") % 5 == 1, "").when(F.col("c_custkey") % 5 == 2, "x1").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("x")).withColumn("v", C.number("x"))
