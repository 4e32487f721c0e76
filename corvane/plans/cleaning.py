"""Cleaning queries: projections, text, dates, maps and JSON, status and export lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import matrix
from ..sources import registry
from .base import FEAT, INDICATORS, features, query, table


@query("SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer")
def project_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the descriptive ones."""
    return table(spark, sf_dir, "customer").drop("c_name", "c_mktsegment")


_LOW = ["balance", *INDICATORS]


@query(FEAT + ", r AS (SELECT entity, list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} < 0 THEN '{c}' END" for c in _LOW) + "], lambda x: x IS NOT NULL)) AS r, balance, delta FROM feat) SELECT entity, CASE WHEN balance >= 0 THEN balance END AS balance, CASE WHEN delta >= 0 THEN delta END AS delta, CAST(len(r) AS BIGINT) AS rejected, array_to_string(r[1:40], ';') AS fields FROM r")
def range_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative cells are dropped and named, in order, up to 40 names."""
    rows = features(spark, sf_dir)
    bad = F.sort_array(F.filter(F.array(*(F.when(F.col(c) < 0, c) for c in _LOW)), lambda x: x.isNotNull()))
    kept = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return rows.select("entity", kept("balance"), kept("delta"), F.size(bad).cast("long").alias("rejected"), F.array_join(F.slice(bad, 1, 40), ";").alias("fields"))


@query("SELECT o_custkey AS id, round(CASE WHEN u <> 0 AND t <> 0 THEN 100 * u / t END, 6) AS share FROM (SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS u, sum(o_totalprice) AS t FROM orders GROUP BY 1)")
def null_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage that is null where either side is null or zero."""
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0)).alias("u")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(urgent, F.sum("o_totalprice").alias("t"))
    return rows.select("id", F.round(C.share(F.col("u"), F.col("t")), 6).alias("share"))


_ROUNDS = """WITH r AS (SELECT o_custkey AS entity, CAST(count(*) FILTER (WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1996) AS DOUBLE) AS rare, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS DOUBLE) AS usual,
  CAST(count(*) FILTER (WHERE year(o_orderdate) = 2000) AS DOUBLE) AS later FROM orders GROUP BY 1), s AS (SELECT avg(CASE WHEN rare = 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS a, avg(CASE WHEN usual = 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS b FROM r)"""


@query(_ROUNDS + " SELECT entity, later - CASE WHEN a AND rare = 0 THEN NULL ELSE rare END AS d_rare, later - CASE WHEN b AND usual = 0 THEN NULL ELSE usual END AS d_usual FROM r, s")
def delta_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between rounds; a zero of a field that is mostly zero is no value."""
    y, count = F.year("o_orderdate"), lambda cond: F.count_if(cond).cast("double")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(count((F.col("o_orderstatus") == "P") & (y == 1996)).alias("rare"), count(y == 1996).alias("usual"), count(y == 2000).alias("later"))
    clean = matrix.without_sentinels(matrix.to_long(rows, ["entity"], ["rare", "usual"]), 0.6)
    wide = matrix.to_wide(clean, ["entity"], ["rare", "usual"])
    return rows.select("entity", "later").join(wide, "entity").select("entity", (F.col("later") - F.col("rare")).alias("d_rare"), (F.col("later") - F.col("usual")).alias("d_usual"))


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


@query("SELECT a.k AS needle, count(*) AS n FROM (SELECT DISTINCT lower(p_name) AS k FROM part) a JOIN part b ON substring(lower(b.p_name), 1, 6) = substring(a.k, 1, 6) GROUP BY 1")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that equal a needle or share its first six characters: an equi-join on the prefix, which equal names share too."""
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"))
    per_prefix = part.groupBy(F.substring("name", 1, 6).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return part.distinct().select(F.col("name").alias("needle"), F.substring("name", 1, 6).alias("p")).join(per_prefix, "p").select("needle", "n")


@query("SELECT c_custkey AS id, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS x FROM customer")
def log_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(F.when(F.col("c_acctbal") > 0, F.log10("c_acctbal")), 6).alias("x"))


@query("SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities, round(max(o_totalprice), 4) AS most FROM orders GROUP BY 1")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document, one level flattened: sizes of its map and array, and its plain field."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"))
    kinds = by.agg(F.collect_set("o_orderstatus").alias("s"), F.collect_set("o_orderpriority").alias("p"), F.max("o_totalprice").alias("m"))  # sets of a few values
    docs = kinds.select("id", F.struct(F.map_from_arrays("s", F.transform("s", lambda x: F.lit(1))).alias("statuses"), F.col("p").alias("priorities"), F.round("m", 4).alias("most")).alias("doc"))
    return docs.select("id", *T.flattened(docs.schema["doc"].dataType, "doc"))


@query("SELECT event_id AS id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, coalesce(CAST(json_extract(props, '$.absent') AS BIGINT), 7) AS absent, coalesce(json_extract_string(props, '$.a.b'), 'none') AS nested FROM events")
def tolerant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two versions: absent fields, at any depth, take defaults."""
    doc = F.from_json("props", "k bigint, absent bigint, a map<string,string>")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), doc.alias("d"))
    return rows.select("id", F.coalesce("d.k", F.lit(-1).cast("long")).alias("k"), F.coalesce("d.absent", F.lit(7).cast("long")).alias("absent"), F.coalesce(F.try_element_at("d.a", F.lit("b")), F.lit("none")).alias("nested"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def map_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, CAST(len(n) AS BIGINT) AS numbers, CAST(list_sum(list_transform(n, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM (SELECT event_id, regexp_extract_all('{\"a\": {\"b\": ' || event_id || '}, \"p\": ' || props || '}', '[0-9]+') AS n FROM events)")
def numeric_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a nested fact document, whatever their depth."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.struct(F.struct(F.col("event_id").alias("b")).alias("a"), F.from_json("props", "k bigint").alias("p")).alias("facts"))
    numbers = F.filter(F.array(*T.numeric_leaves(rows.schema["facts"].dataType, "facts")), lambda x: x.isNotNull())
    return rows.select("id", F.size(numbers).cast("long").alias("numbers"), F.aggregate(numbers, F.lit(0).cast("double"), lambda a, x: a + x).cast("long").alias("total"))


@query("SELECT o_custkey AS id, md5('{' || string_agg('\"' || o_orderstatus || '\":' || n, ',' ORDER BY o_orderstatus) || '}') AS digest FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as JSON with sorted keys, so that equal maps have equal digests."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))  # one entry a status
    return maps.select("id", F.md5(T.sorted_json("m")).alias("digest"))


@query("SELECT o_custkey AS id, string_agg(o_orderstatus || '=' || n, ';' ORDER BY o_orderstatus) AS counts FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from category to count for each key, written out as joined targets are."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("counts"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_diacritics("text")).alias("digest"))


_ALIASES = {"BUILDING": "construction", "MACHINERY": "engineering", "AUTOMOBILE": "vehicles"}


@query("SELECT c_custkey AS id, " + "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIASES.items()) + " ELSE lower(c_mktsegment) END AS segment FROM customer")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.aliased("c_mktsegment", _ALIASES, F.lower("c_mktsegment")).alias("segment"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_totalprice * 100 >= 1e7 THEN o_totalprice * 100 / 1e7 WHEN o_totalprice * 100 >= 1e5 THEN o_totalprice * 100 / 1e5 WHEN o_totalprice * 100 >= 1e3 THEN o_totalprice * 100 / 1e3 ELSE o_totalprice * 100 END, 2) AS amount, CASE WHEN o_totalprice * 100 >= 1e7 THEN 'crore' WHEN o_totalprice * 100 >= 1e5 THEN 'lakh' WHEN o_totalprice * 100 >= 1e3 THEN 'thousand' ELSE '' END AS unit FROM orders")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts to hundredths of their unit, rounded by their binary value: a number that only prints as a tie (69.195 is a little less) is none."""
    amount, unit = T.compact(F.col("o_totalprice") * 100)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.round(amount * 100) / 100).alias("amount"), unit.alias("unit"))


@query("SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'hardware' WHEN contains(lower(p_name), 'red') THEN 'colour' ELSE 'other' END AS layer FROM part")
def metric_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layer one of whose marks a name holds."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.layer("p_name", [("hardware", ("ring", "bolt")), ("colour", ("red",))], "other").alias("layer"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '|' || p_brand AS key, p_brand AS second FROM part")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title case, two names joined to a key, and the key split again."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", F.initcap("p_name"), "p_brand").alias("key"))
    return rows.withColumn("second", F.split("key", r"\|")[1])


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS fenced FROM events")
def json_from_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object in an answer's prose, fenced or not."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {ok}."))).otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" as asked.")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), said.alias("said"))
    return rows.select("id", F.from_json(T.first_object("said"), "k bigint")["k"].alias("k"), F.col("said").contains("```").alias("fenced"))


_NESTED = """(CASE event_id % 4 WHEN 0 THEN '{"k": ' || event_id || '}' WHEN 1 THEN '{"a": {"b": {"c": {"k": ' || event_id || '}}}, "d": {}}' WHEN 2 THEN '{"s": "} {\\" }", "k": ' || event_id || '}' ELSE '{"s": "é{\\\\", "t": [{"k": ' || event_id || '}, {}]}' END)"""


@query(f"SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN {_NESTED} END AS object FROM events")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects at any depth, with braces and escaped quotes in their strings, out of prose and fences; an object that is never closed is none."""
    own, k = F.expr(_NESTED.replace("\\", "\\\\")), F.col("event_id")
    said = F.when(k % 11 == 0, F.concat(F.lit("cut: "), F.expr("substring('{{}', 1, 3)"), F.lit('"}"'))).when(k % 3 == 0, F.concat(F.lit("```json\n"), own, F.lit("\n```\nDone {ok}.")))
    said = said.when(k % 3 == 1, F.concat(F.lit("Answer: "), own, F.lit(" as asked }."))).otherwise(own)
    return table(spark, sf_dir, "events").select(k.alias("id"), T.answered_object(said).alias("object"))


@query("SELECT conv_id, turn, left(replace(replace(text, chr(10), ' '), '|', '/'), 80) AS error FROM conversations")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines for a status table: one line, no bars, cut at 80 characters (the cut is the feature)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.error_line("text", 80).alias("error"))


@query("SELECT event_type, event_type || ' | ' || count(*) || ' | ' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') || ' | ' || CASE WHEN count(*) FILTER (WHERE value > 99) > 0 THEN 'error' ELSE 'ok' END AS line FROM events GROUP BY 1")
def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered line a source: name, rows, last time, state."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"), F.count_if(F.col("value") > 99).alias("bad"))
    return rows.select("event_type", F.concat_ws(" | ", "event_type", F.col("n").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("bad") > 0, "error").otherwise("ok")).alias("line"))


@query("SELECT event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY 1")
def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_custkey || ',' || CASE WHEN regexp_matches(x, '[\",]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END || ',' || c_mktsegment AS line FROM (SELECT *, CASE WHEN c_nationkey < 8 THEN c_name || ', \"' || c_nationkey || '\"' ELSE c_name END AS x FROM customer)")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV export: cells with commas, quotes or line feeds are quoted, quotes doubled."""
    name = F.when(F.col("c_nationkey") < 8, F.concat("c_name", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.csv_line(F.col("c_custkey").cast("string"), name, "c_mktsegment").alias("line"))


@query(FEAT + " SELECT entity, " + ", ".join(f"round(CASE WHEN {c} <> 0 THEN {c} END, 6) AS {c}" for c in INDICATORS) + " FROM feat")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are not (NaN) become null and the rest is rounded, as JSON needs it."""
    rows = features(spark, sf_dir).select("entity", *(F.when(F.col(c) == 0, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in INDICATORS))
    return rows.select("entity", *(T.json_number(c, 6).alias(c) for c in INDICATORS))


@query("SELECT o_orderkey AS id, CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start, strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', CAST(date_trunc('year', o_orderdate) AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders")
def year_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of the year, the range's end as text, an ISO date's slice, and the days between."""
    d = F.col("o_orderdate")
    first = F.trunc(d, "year")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("year_start"), F.date_format(d, "dd/MM/yyyy").alias("shown"), F.substring(F.date_format(d, "yyyy-MM-dd"), 1, 7).alias("month"), F.datediff(d, first).cast("long").alias("days"))


@query("SELECT c_custkey AS id, CAST(round(20 + t * 210) AS BIGINT) AS r, CAST(round(40 + t * 100) AS BIGINT) AS g, CAST(round(200 - t * 150) AS BIGINT) AS b FROM (SELECT c_custkey, greatest(0.0, least(1.0, (c_acctbal + 1000) / 11000)) AS t FROM customer)")
def colour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour between two ends, by a clamped position."""
    t = C.clipped((F.col("c_acctbal") + 1000) / 11000, 0.0, 1.0)
    r, g, b = T.interpolated(t, (20, 40, 200), (230, 140, 50))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT o_custkey AS id, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM (SELECT o_custkey, unnest(regexp_extract_all('total [ ' || o_orderkey || ' ] of [' || o_custkey || ']', '\\[\\s*(\\d+)\\s*\\]', 1)) AS x FROM orders) GROUP BY 1")
def bracketed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("total [ "), F.col("o_orderkey").cast("string"), F.lit(" ] of ["), F.col("o_custkey").cast("string"), F.lit("]"))
    each = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.explode(T.bracketed(said)).alias("x"))
    return each.groupBy("id").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS id, count(*) AS n, CAST(least(ceil(count(*) / 10.0), 5) AS BIGINT) AS pages, count(*) > 50 AS count_mismatch FROM customer GROUP BY 1")
def page_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten rows, five at most, against the count that the source states."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    pages = rows.withColumn("pages", F.least(F.ceil(F.col("n") / 10), F.lit(5)).cast("long"))
    return pages.withColumn("count_mismatch", F.col("pages") * 10 < F.col("n"))


@query(" UNION ALL ".join(f"SELECT '{s.id}' AS id, '{s.kind}' AS kind, count(*) AS n, count(*) BETWEEN {s.least} AND {s.most} AS verified FROM {s.id}" for s in registry.SOURCES))
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered source, read by its kind's reader, with its count held against its bounds."""
    return registry.snapshot(spark, sf_dir)


@query("SELECT event_type AS id, arg_max(value, event_id) AS value, max(event_id) AS run FROM events GROUP BY 1")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("value", "event_id"), "event_id").alias("b")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(best).select("id", "b.value", F.col("b.event_id").alias("run"))


@query("WITH n AS (SELECT event_type AS source, count(*) AS total FROM events GROUP BY 1) SELECT source, md5(source || ':' || total) AS hash, total % 2 = 0 AS changed FROM n")
def cheap_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source has changed if the hash of its name and row count differs from the recorded one; here every odd total was recorded."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("total"))
    rows = rows.withColumn("hash", F.md5(F.concat_ws(":", "source", F.col("total").cast("string"))))
    recorded = rows.where("total % 2 = 1").select("source", F.col("hash").alias("was"))
    return rows.join(recorded, "source", "left").select("source", "hash", (~F.col("hash").eqNullSafe(F.col("was"))).alias("changed"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN round(value * 2, 4) ELSE round(value, 4) END AS value, CASE WHEN event_type = 'error' THEN 'again' ELSE 'kept' END AS source FROM events")
def selective_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only failed rows are computed again; they replace what was there."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    done = rows.select("id", F.round("value", 4).alias("value"), F.lit("kept").alias("source"))
    again = rows.where("event_type = 'error'").select("id", F.round(F.col("value") * 2, 4).alias("value"), F.lit("again").alias("source"))
    return done.join(again, "id", "left_anti").unionByName(again)
