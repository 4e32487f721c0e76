"""License scans: ordered signature rules over normalised words, in DataFrame functions only.

A text becomes its lower-cased words, each with a space on either side, so a rule is a regular expression over whole words and its
places are word numbers. Rules are written by hand (signatures) and gated by a keyword that each of their matches holds; texts that hold none of a few roots, which
are derived from the rules, are not looked at. Detections are intervals of words; one that lies inside another's
interval is suppressed unless its rule has a higher priority (equal intervals of equal priority: the rule listed first stays).

Defined edges: null text is empty and has no words. Repeated rows give repeated results. An empty table gives an empty
result. Texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signatures import signatures

FOLD = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The places that the contract counts.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def pattern(words: str) -> str:
    """A rule's regular expression: words, `a|b` choices, a trailing `?` for words that may be missing, `*` for any one word."""
    out = []
    for token in words.split():
        optional, token = token.endswith("?"), token.rstrip("?")
        one = "[^ ]+" if token == "*" else token if "|" not in token else f"(?:{token})"
        out.append(f"(?: {one} )?" if optional else f" {one} ")
    return "".join(out)


def rules() -> list[tuple[str, str, int, float, str, str]]:
    """(rule, label, priority, confidence, keyword, regular expression), in order of precedence; the contract's phrases come last."""
    own = [(f"{label}/{n}", label, priority, confidence, keyword, pattern(words)) for n, (label, priority, confidence, keyword, words) in enumerate(signatures())]
    return own + [(f"base/{label}", label, 1, 0.6, "license", pattern(words)) for label, words in BASE]


def held(words: str) -> set[str]:
    """Substrings of at least five letters that every match of a rule holds: of its fixed words, and what all of a choice's words share."""
    out = set()
    for token in words.split():
        if token.endswith("?") or token == "*":
            continue
        first, *others = token.split("|")
        parts = {first[i:j] for i in range(len(first)) for j in range(i + 5, len(first) + 1)} if others else {first}
        out |= {p for p in parts if len(p) >= 5 and all(p in o for o in others)}
    return out


#: Words that most prose holds: as roots they would let every text through.
PLAIN = {"above", "after", "agreed", "between", "other", "their", "these", "under", "which", "without", "written"}


def roots() -> list[str]:
    """A few substrings, by greedy cover: every rule's match holds at least one, so texts without any of them have no detection. A rule's keyword is in all of its matches as well."""
    left = [(held(words) - PLAIN) | {keyword} for _, _, _, keyword, words in signatures()] + [held(words) - PLAIN for _, words in BASE]
    out = []
    while left:
        counts: dict[str, int] = {}
        for own in left:
            for part in own:
                counts[part] = counts.get(part, 0) + 1
        out.append(max(counts, key=lambda part: (counts[part], len(part), part)))
        left = [own for own in left if out[-1] not in own]
    return sorted(r for r in out if not any(o != r and o in r for o in out))


def let(value: Column, body) -> Column:
    """body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(spaced: Column) -> Column:
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def normalised(text: Column) -> Column:
    """Lower-cased words, one space between two."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def rows_of(names: str, rows: list[tuple]) -> Column:
    """A constant array of structs."""
    fields = [n.split(":")[0] for n in names.split(",")]
    return F.from_json(F.lit(json.dumps([dict(zip(fields, r)) for r in rows])), f"array<struct<{names}>>")


def folded(items: Column, seed: Column, empty: Column, step) -> Column:
    """The rows that step(state, item) -> (state, row) gives for all items in turn.

    Rows are gathered in blocks of FOLD, since appending to an array copies it: the cost is linear for any array that a row can hold.
    """

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            state, row = step(acc["state"], item)
            return F.struct(state.alias("state"), F.array_append(acc["rows"], row).alias("rows"))

        return F.aggregate(block, F.struct(state.alias("state"), empty.alias("rows")), one)

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / FOLD).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * FOLD + 1, FOLD))
    start = F.struct(seed.alias("state"), F.slice(F.array(empty), 1, 0).alias("blocks"))
    added = lambda acc, block: let(inner(acc["state"], block), lambda made: F.struct(made["state"].alias("state"), F.array_append(acc["blocks"], made["rows"]).alias("blocks")))
    return F.flatten(F.aggregate(blocks, start, added)["blocks"])


HIT = "struct<start:int,end:int,rule:int>"


def rule_hits(spaced: Column, rule: Column) -> Column:
    """The word intervals where one rule matches: a mark is put before each match, and is a word of its own that tells its place."""
    none = F.array().cast(f"array<{HIT}>")

    def places(found: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(spaced, rule["pattern"], F.lit("\x01$0"))), " +")
        marks = F.filter(F.transform(words, lambda w, i: F.when(w == "\x01", i)), lambda i: i.isNotNull())
        starts = F.transform(marks, lambda i, n: i - n)
        return F.zip_with(starts, found, lambda a, m: F.struct(a.alias("start"), (a + word_count(m)).alias("end"), rule["n"].alias("rule")))

    return let(F.regexp_extract_all(spaced, rule["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, places(found)).otherwise(none))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, and detections array<struct<rule, label, priority, confidence, start, end, kept>> by place."""
    table = rules()
    gated = rows_of("n:int,keyword:string,pattern:string", [(n, k, p) for n, (*_, k, p) in enumerate(table)])
    about = rows_of("rule:string,label:string,priority:int,confidence:double", [r[:4] for r in table])
    words = normalised(F.col(text))
    rows = docs.select(*keep, words.alias("_words"))
    rows = rows.withColumn("n_words", F.when(F.col("_words") == "", 0).otherwise(F.octet_length("_words") - F.octet_length(F.replace("_words", F.lit(" "), F.lit(""))) + 1).cast("long"))
    likely = F.lit(False)
    for root in roots():
        likely = likely | F.contains("_words", F.lit(root))
    spaced = F.concat(F.lit(" "), F.replace(F.col("_words"), F.lit(" "), F.lit("  ")), F.lit(" "))
    found = let(spaced, lambda s: F.flatten(F.transform(F.filter(gated, lambda r: F.contains(F.col("_words"), r["keyword"])), lambda r: rule_hits(s, r))))
    rows = rows.withColumn("_hits", F.when(likely, found).otherwise(F.array().cast(f"array<{HIT}>")))

    def full(h: Column) -> Column:
        a = F.element_at(about, h["rule"] + 1)
        return F.struct(h["start"].alias("start"), (-h["end"]).alias("last"), (-a["priority"]).alias("rank"), h["rule"].alias("n"), a["rule"].alias("rule"), a["label"].alias("label"), a["confidence"].alias("confidence"))

    shape = "struct<rule:string,label:string,priority:int,confidence:double,start:int,end:int,kept:boolean>"
    none = F.array().cast(f"array<{shape}>")

    def sweep(ends: Column, d: Column) -> tuple[Column, Column]:
        """By start, then longest, highest, first: what an earlier interval of equal or higher priority reaches over is suppressed."""
        end, priority = -d["last"], -d["rank"]
        reach = F.greatest(F.when(priority <= 1, ends["e1"]).otherwise(0), F.when(priority <= 2, ends["e2"]).otherwise(0), ends["e3"])
        row = F.struct(d["rule"].alias("rule"), d["label"].alias("label"), priority.alias("priority"), d["confidence"].alias("confidence"), d["start"].alias("start"), end.alias("end"), (reach < end).alias("kept"))
        return F.struct(*(F.when(priority == p, F.greatest(ends[f"e{p}"], end)).otherwise(ends[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3))), row

    ordered = F.array_sort(F.transform("_hits", full))
    zero = F.struct(*(F.lit(0).alias(f"e{p}") for p in (1, 2, 3)))
    swept = F.when(F.size("_hits") == 0, none).otherwise(let(ordered, lambda hits: folded(hits, zero, none, sweep)))
    return rows.select(*keep, "n_words", swept.alias("detections"))


def license_digests(docs: DataFrame) -> DataFrame:
    """One row a document: counts and places of the base phrases, all labels, and the best confidence of a kept detection."""
    found = scan(docs)
    found = found.withColumn("_base", F.filter("detections", lambda d: d["rule"].startswith("base/"))).withColumn("_kept", F.filter("detections", lambda d: d["kept"]))

    def names(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(column, lambda d: d["label"])))

    starts = F.transform("_base", lambda d: d["start"])
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(names("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(names("_base"), names("_kept"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"), (F.size("detections") - F.size("_kept")).cast("long").alias("n_suppressed"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL, over the same rule table."""
    values = ",\n".join(f"({n}, '{r}', '{label}', {p}, {c}, '{k}', '{x}')" for n, (r, label, p, c, k, x) in enumerate(rules()))
    likely = " OR ".join(f"contains(w, '{r}')" for r in roots())
    return rf"""
WITH rules(n, rule, label, priority, confidence, keyword, pattern) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS w FROM documents),
s AS (SELECT k, w, ' ' || replace(w, ' ', '  ') || ' ' AS s FROM d WHERE {likely}),
m AS (SELECT k, n, rule, label, priority, confidence, regexp_extract_all(s, pattern) AS m, string_split_regex(s, pattern) AS p FROM s, rules WHERE contains(w, keyword)),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
c AS (SELECT *, list_transform(m, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS mw, list_transform(p, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS pw FROM u),
h AS (SELECT k, n, rule, label, priority, confidence, list_sum(pw[1:i]) + coalesce(list_sum(mw[1:i - 1]), 0) AS a, list_sum(pw[1:i]) + list_sum(mw[1:i]) AS b FROM c),
x AS (SELECT h.*, NOT EXISTS (SELECT 1 FROM h e WHERE e.k = h.k AND e.a <= h.a AND e.b >= h.b AND e.priority >= h.priority
        AND (e.a < h.a OR e.b > h.b OR e.priority > h.priority OR e.n < h.n)) AS kept FROM h),
g AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE NOT kept) AS gone, count(*) FILTER (WHERE rule LIKE 'base/%') AS n_base, min(a) FILTER (WHERE rule LIKE 'base/%') AS fw, max(a) FILTER (WHERE rule LIKE 'base/%') AS lw,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE rule LIKE 'base/%') AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kept OR rule LIKE 'base/%') AS al, max(confidence) FILTER (WHERE kept) AS score FROM x GROUP BY k)
SELECT doc_id, CAST(CASE WHEN w = '' THEN 0 ELSE length(w) - length(replace(w, ' ', '')) + 1 END AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(fw AS BIGINT) AS first_word, CAST(lw AS BIGINT) AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(g.n, 0) AS n_detections, coalesce(gone, 0) AS n_suppressed
FROM d LEFT JOIN g USING (k)
"""
