"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of a text's word shingles, as hex it is a fixed-width
string. Sketches merge by union and cut, so parts of a corpus can be sketched apart and put together; two of them estimate
resemblance, containment and the number of distinct shingles.

Defined edges: a null text is empty; an empty text has an empty sketch, and two empty sketches resemble each other fully
(1.0), an empty and another not at all (0.0). A text of fewer words than a shingle takes has its whole word sequence as one.
Equal texts have equal sketches. Rows are ordered by doc_id descending, null last, ties by text. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS, BITS, PART_BYTES = 64, 5, 48, 1 << 25


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>: the k smallest distinct hashes of the text's shingles of lower-cased words."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def shingles(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(words))), 64 - BITS))
        return F.slice(F.array_sort(F.array_distinct(parts)), 1, k)

    return F.when(F.length(F.trim(text)) == 0, F.array().cast("array<bigint>")).otherwise(
        F.element_at(F.transform(F.array(tokens), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(shingles(w))), 1)
    )


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both shingle sets together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the merged sketch that both hold."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a fraction."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (F.element_at(a, -1).cast("double") / float(1 << BITS)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def merge_sketches(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key, of all texts under it: distinct hashes are counted out before the shuffle, and the k smallest of each key stay.

    A key of a third of all rows is dealt over 64 salts first; no task gathers more than k hashes of each.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    salted = hashes.withColumn("_salt", F.pmod("_hash", F.lit(64)))
    order = Window.partitionBy(*keys, "_salt").orderBy("_hash")
    least = salted.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)  # Spark cuts such groups before it shuffles them
    own = least.groupBy(*keys, "_salt").agg(F.array_sort(F.collect_list("_hash")).alias("_own"))
    return own.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_own"))), 1, k).alias(column))


def as_hex(a: Column) -> Column:
    """A sketch as text: 12 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def place_in(cuts: Column, n: int, x: Column) -> Column:
    """How many of the n sorted cuts are at most x, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.coalesce(F.get(cuts, at + k - 1) <= x, F.lit(False)), at + k).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Each row with `columns` of the next row by doc_id descending as next_*; the last row's next is the first.

    Rows are dealt into ranges of doc_id of about `part_bytes` of text, so their number follows the input; the driver gets the borders
    (approximate quantiles of doc_id) and the largest doc_id of each, three numbers a range. The first rows of each range also stand at
    the end of the range before it, so each window sees the row that follows its last.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, -(-size // part_bytes))
    spaced = F.from_json(F.lit(json.dumps([i / parts for i in range(1, parts)])), "array<double>")
    cuts = docs.agg(F.percentile_approx("doc_id", spaced, max(10000, 10 * parts)).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    numbers = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
    # range 0 holds the largest doc_ids, the last one the smallest and null
    part = F.lit(len(cuts)) - F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place_in(numbers(cuts), len(cuts), F.col("doc_id")))
    dealt = docs.select("doc_id", *columns, part.cast("int").alias("part"))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()  # one row a range
    if not tops:
        return dealt.select("doc_id", *columns, *(F.col(c).alias(f"next_{c}") for c in columns))
    top_of, before = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, t in enumerate(tops):
        top_of[t["part"]], before[t["part"]] = t["top"], tops[i - 1]["part"]
    head = F.col("doc_id").eqNullSafe(F.get(numbers(top_of), F.col("part")))
    home = lambda part, copy: F.struct(part.cast("int").alias("part"), F.lit(copy).alias("copy"))
    own, other = home(F.col("part"), False), home(F.get(numbers(before), F.col("part")), True)
    spread = dealt.select("doc_id", *columns, F.explode(F.when(head, F.array(own, other)).otherwise(F.array(own))).alias("home")).select("doc_id", *columns, "home.part", "home.copy")
    spread = spread.repartitionById(len(cuts) + 1, "part")  # a range a task, however many ranges
    order = Window.partitionBy("part").orderBy(F.col("copy"), F.col("doc_id").desc_nulls_last(), *columns[:1])
    return spread.select("doc_id", *columns, "copy", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("not copy").drop("copy")


def fingerprint_digests(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the sketch's other estimates.

    The edited text is the text with its last floor(n_chars/3) code points replaced by the first as many of the next document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text"), k, words))
    pairs = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    made = pairs.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    made = made.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("sketch")).alias("fingerprint"), as_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"), distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"),
    )
