"""Entity resolution: labels keyed by dirty names meet a coded spine, first hit wins: exact, alias, suffix-stripped, fuzzy, unresolved."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normal_name, without_suffixes
from .storage import written

CUTOFF = 0.88


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two names; Spark has no such function (levenshtein is another measure)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def exact_and_alias(labels: DataFrame, spine: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """block, label, <name> with codes (array, null without a hit) and category, from an exact name or else an alias."""
    by_name = spine.groupBy("block", F.col("nname").alias(name)).agg(F.max("code").alias("_exact"))
    by_alias = aliases.select("block", F.col("alias").alias(name), F.col("targets").alias("_targets"), F.col("category").alias("_category"))
    out = labels.join(by_name, ["block", name], "left").join(by_alias, ["block", name], "left")
    codes = F.when(F.col("_exact").isNotNull(), F.array("_exact")).otherwise(F.col("_targets"))
    category = F.when(F.col("_exact").isNotNull(), "EXACT").when(F.col("_targets").isNotNull(), F.col("_category"))
    return out.withColumn("codes", codes).withColumn("category", category).drop("_exact", "_targets", "_category")


def _needed(a: Column, b: Column, cutoff: float, size: int) -> Column:
    """How many substrings of 1 or 2 characters (each counted as often as in both) two names of lengths a and b share at least if their ratio reaches the cutoff.

    The ratio is 2 M / (a + b) for M characters in matching blocks, so M >= cutoff * (a + b) / 2. Blocks are disjoint and lie apart, so there are at most
    (a - M) + (b - M) + 1 of them, and each hides one border: M - blocks pairs of characters are shared as well.
    """
    m = F.ceil(cutoff * (a + b) / 2 - 1e-9)
    return m if size == 1 else 3 * m - a - b - 1


def _prefixes(names: DataFrame, name: str, cutoff: float, other: bool) -> DataFrame:
    """names with `size` (1 or 2 characters) and `grams`: array of numbered substrings, one row a size that the name is looked up by.

    A looked-up name takes pairs where these are needed at all, else single characters; a name that is found (`other`) is stored by both.
    """
    n, least = F.length(name), F.ceil(F.length(name) * cutoff / (2 - cutoff) - 1e-9)
    cut = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array(F.lit("")))
    numbered = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("gram"), F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).alias("copy")))
    entry = lambda size: F.struct(F.lit(size).alias("size"), numbered(cut(size)).alias("grams"), F.greatest(_needed(n, least, cutoff, size), F.lit(1)).alias("needed"))
    pairs = _needed(n, least, cutoff, 2) >= 1
    chosen = F.array(entry(1), entry(2)) if other else F.array(F.when(pairs & F.lit(cutoff > 0.7), entry(2)).otherwise(entry(1)))
    return names.select("*", F.inline(chosen))


def _rare_first(names: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """keys, gram, copy: of each name, as many of its rarest grams as must hold a shared one."""
    each = names.select(*keys, "size", "needed", F.size("grams").alias("held"), F.explode("grams").alias("g")).select(*keys, "size", "needed", "held", "g.gram", "g.copy")
    ranked = each.join(counts, ["size", "gram", "copy"], "left")
    place = F.row_number().over(Window.partitionBy(*keys, "size").orderBy(F.coalesce("n", F.lit(0)), "gram", "copy"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= F.col("held") - F.col("needed") + 1).select(*keys, "size", "gram", "copy")


def similar_in_block(labels: DataFrame, spine: DataFrame, name: str, cutoff: float = CUTOFF) -> DataFrame:
    """block, <name>, nname, ratio: all pairs of different labels' and spine's names of a block whose ratio reaches the cutoff.

    No block's names meet all others: names are looked up by their rarest substrings (a prefix filter over an inverted index) within the lengths that the
    cutoff allows, and only what is found is compared. Neither bound can lose a pair.
    """
    asked = labels.select("block", name).where(F.col(name).isNotNull()).distinct()
    known = spine.select("block", "nname").where("nname is not null").distinct()
    stored, looked = _prefixes(known, "nname", cutoff, True), _prefixes(asked, name, cutoff, False)
    counts = stored.select("size", F.explode("grams").alias("g")).groupBy("size", "g.gram", "g.copy").agg(F.count(F.lit(1)).alias("n"))
    left, right = _rare_first(looked, ["block", name], counts), _rare_first(stored, ["block", "nname"], counts)
    a, b = F.length(name), F.length("nname")
    fits = (b >= a * cutoff / (2 - cutoff) - 1e-9) & (a >= b * cutoff / (2 - cutoff) - 1e-9)
    found = left.join(right, ["block", "size", "gram", "copy"]).where(fits).select("block", name, "nname").distinct()
    return found.withColumn("ratio", sequence_ratio(F.col("nname"), F.col(name))).where(F.col("ratio") >= cutoff)


def best_in_block(labels: DataFrame, spine: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """label rows (block, label, stripped) with the spine's most alike name of the same block, ties to the larger name: code, ratio."""
    found = similar_in_block(labels, spine, "stripped", cutoff).join(spine.select("block", "nname", "code"), ["block", "nname"])
    pairs = labels.select("block", "label", "stripped").join(found, ["block", "stripped"])
    best = pairs.groupBy("block", "label").agg(F.max(F.struct("ratio", "nname", "code")).alias("best"))
    return best.select("block", "label", "best.code", "best.ratio")


def resolve(labels: DataFrame, spine: DataFrame, aliases: DataFrame, suffixes: tuple[str, ...], cutoff: float = CUTOFF, fuzzy: bool = True) -> DataFrame:
    """block, label, category, codes of every label (block, label).

    spine: block, nname, code. aliases: block, alias, category, targets. A hit after suffixes were taken off has SUFFIX+ before its
    category; consumers test how a category ends, so that SUFFIX+PRORATE is spread like PRORATE. Only what no earlier
    tier takes is compared with its block's names.
    """
    named = labels.withColumn("plain", normal_name("label")).withColumn("stripped", without_suffixes(normal_name("label"), suffixes))
    first = exact_and_alias(named, spine, aliases, "plain")
    second = exact_and_alias(first.where("category is null").drop("codes", "category"), spine, aliases, "stripped")
    second = second.withColumn("category", F.concat(F.lit("SUFFIX+"), "category"))
    parts = [first.where("category is not null"), second.where("category is not null")]
    rest = second.where("category is null").drop("codes", "category")
    if fuzzy:
        found = best_in_block(rest, spine, cutoff)
        rest = rest.join(found, ["block", "label"], "left")
        rest = rest.withColumn("codes", F.when(F.col("code").isNotNull(), F.array("code"))).withColumn("category", F.when(F.col("code").isNotNull(), "FUZZY").otherwise("UNRESOLVED"))
    else:
        rest = rest.withColumn("codes", F.lit(None).cast("array<bigint>")).withColumn("category", F.lit("UNRESOLVED"))
    columns = ["block", "label", "category", "codes"]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(rest.select(*columns))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """block, label, code, score: within each block the highest scores first, each label and code once; ties by label, then code.

    A pair that comes first both among its label's and among its code's pairs is taken whatever else is, so all of these are taken together and what they touch goes;
    this is repeated until no pair is left. That gives what taking pairs one by one in order gives. Pairs without a score, label or code are no pairs.
    """
    columns = ["block", "label", "code", "score"]
    rest = pairs.where("label is not null and code is not null and score is not null").groupBy("block", "label", "code").agg(F.max("score").alias("score")).select(*columns)
    rest, out = written(rest, "pairs"), None
    while out is None or not rest.isEmpty():
        of_label = F.row_number().over(Window.partitionBy("block", "label").orderBy(F.desc("score"), "code"))
        of_code = F.row_number().over(Window.partitionBy("block", "code").orderBy(F.desc("score"), "label"))
        taken = written(rest.withColumn("_l", of_label).withColumn("_c", of_code).where("_l = 1 and _c = 1").select(*columns), "taken")
        out = taken if out is None else out.unionByName(taken)
        same = lambda key: rest.alias("r").join(taken.select(F.col("block").alias("_b"), F.col(key).alias("_k")), F.col("block").eqNullSafe(F.col("_b")) & (F.col(key) == F.col("_k")), "left_anti")
        rest = same("label")
        rest = written(same("code").select(*columns), "pairs")
    return out


def spread(resolved: DataFrame, weights: DataFrame) -> DataFrame:
    """label rows with `codes` and `value`, one row a code with its part: by weight (code, weight), evenly where weights sum to zero."""
    each = resolved.select("block", "label", "value", F.explode("codes").alias("code")).join(weights, "code", "left")
    w = Window.partitionBy("block", "label")
    total, n = F.sum(F.coalesce("weight", F.lit(0.0))).over(w), F.count(F.lit(1)).over(w)
    part = F.when(total > 0, F.coalesce("weight", F.lit(0.0)) / F.when(total > 0, total)).otherwise(1.0 / n)
    return each.withColumn("part", F.col("value") * part).select("block", "label", "code", "part")


def missing_targets(aliases: DataFrame, spine: DataFrame) -> DataFrame:
    """Alias targets that the spine does not know: must be empty."""
    return aliases.select("block", "alias", F.explode("targets").alias("code")).join(spine.select("code"), "code", "left_anti")
