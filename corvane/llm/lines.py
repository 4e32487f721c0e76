"""Line dedup: range-partitioned key hashes, first occurrences streamed in sorted order, keep bitmaps out.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. A key of at least `min_chars`
code points held by at least `min_docs` documents keeps its lines in the largest doc_id that holds it; its other lines go.

Defined edges: null or empty text is one empty line. Rows without doc_id keep every line and count for no key. A doc_id that
repeats counts once; equal rows get equal bitmaps. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, with_new_text, with_text_key

STRIP = b" \t\n\x0b\x0c\r"
DROP, OPEN, RUN = 0, 1, 2

KEYS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("lines", pa.binary())])
KEYS_DDL = "hi long, lo long, doc_id long, text_key long, n_lines long, lines binary"
MARKS = pa.schema([("kind", pa.int32()), *KEYS, ("n_docs", pa.int64()), ("max_doc", pa.int64())])
MARKS_DDL = f"kind int, {KEYS_DDL}, n_docs long, max_doc long"


def code_points(raw: bytes, at_least: int) -> bool:
    """Whether UTF-8 bytes hold at least so many code points."""
    return len(raw) >= 4 * at_least or len(raw) >= at_least and len(raw.decode("utf-8", "replace")) >= at_least


def line_keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """One row for each document and key of enough code points: the key's 128-bit hash and its line numbers."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in KEYS}
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
            lines = text.lower().split(b"\n") if isinstance(text, bytes) else text.encode().lower().split(b"\n")
            found: dict[bytes, list[int]] = {}
            for n, line in enumerate(lines):
                if len(line) >= min_chars and code_points(line := line.strip(STRIP), min_chars):
                    found.setdefault(xxhash.xxh3_128_digest(line), []).append(n)
            for digest, at in found.items():
                hi, lo = np.frombuffer(digest, dtype=">i8").tolist()
                for name, value in zip(out, (hi, lo, doc, key, len(lines), np.array(at, dtype="<u4").tobytes())):
                    out[name].append(value)
        yield batch_of(KEYS, **out)


def stream_runs(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and doc_id descending: rows to drop, rows left open, and a summary of the first and last run.

    A run that starts inside the partition starts with its key's largest doc_id, so its rows are settled once `min_docs`
    documents were seen. Only the first run may go on from the partition before; its rows stay open. Of the last run, rows
    seen before that count stay open. State is one run's counters and the few rows that wait.
    """
    key, first, n_docs, top, last = None, True, 0, None, None
    waiting: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(f.name).to_pylist() for f in KEYS)))
        out: list[tuple] = []
        for row in rows:
            if row[:2] != key:
                if key is not None and first:
                    out.append((RUN, *key, None, None, None, None, n_docs, top))
                first = key is None
                key, n_docs, top, last, waiting = row[:2], 0, row[2], None, []
            if row[2] != last:
                n_docs, last = n_docs + 1, row[2]
            if first:
                out.append((OPEN, *row, None, None))
            elif row[2] != top:
                waiting.append(row)
                if n_docs >= min_docs:
                    out.extend((DROP, *w, None, None) for w in waiting)
                    waiting = []
        yield batch_of(MARKS, **dict(zip(MARKS.names, zip(*out) if out else [()] * len(MARKS))))
    if key is not None:
        out = [(OPEN, *w, None, None) for w in waiting] + [(RUN, *key, None, None, None, None, n_docs, top)]
        yield batch_of(MARKS, **dict(zip(MARKS.names, zip(*out))))


def pack_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, key, n, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "n_lines", "parts"))):
            keep = np.ones(n, dtype=bool)
            keep[np.frombuffer(b"".join(parts), dtype="<u4")] = False
            for name, value in zip(out, (doc, key, n, int(n - keep.sum()), zlib.compress(np.packbits(keep).tobytes()))):
                out[name].append(value)
        yield batch_of(schema, **out)


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep_bitmap (zlib over bits, a set bit keeps its line) of documents that lose lines.

    Documents without a row keep every line. The range is dealt by key and doc_id, so a key that a third of all documents
    hold spreads over many partitions; the runs that cross a border meet in a summary of two rows a partition.
    """
    source = with_text_key(docs).where("doc_id is not null")
    # written once: range bounds are then sampled from small rows, not from a second pass over the texts
    keys = materialize(source.mapInArrow(lambda it: line_keys(it, min_chars), KEYS_DDL))
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc()]
    runs = materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: stream_runs(it, min_docs), MARKS_DDL))
    settled = runs.where(F.col("kind") == DROP).select(*KEYS.names)
    border = runs.where(F.col("kind") == RUN).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
    border = border.where(F.col("n_docs") >= min_docs).drop("n_docs")  # two rows a partition at most
    late = runs.where(F.col("kind") == OPEN).select(*KEYS.names).join(F.broadcast(border), ["hi", "lo"]).where("doc_id < max_doc").select(*KEYS.names)
    marks = settled.unionByName(late).groupBy("doc_id", "text_key", "n_lines").agg(F.collect_set("lines").alias("parts"))
    return marks.mapInArrow(pack_bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, its lines before that, and how many were dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines)).astype(bool)
    return "\n".join(line for line, k in zip(lines, keep.tolist()) if k), len(lines), int(len(lines) - keep.sum())


def joined_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, the whole row as a struct (its columns can't clash with ours) and keep_bitmap (null: keep all)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_key"), "text", F.struct(*docs.columns).alias("row"))
    return keyed.join(bitmaps.select("doc_id", "text_key", "keep_bitmap"), ["doc_id", "text_key"], "left")


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text, bitmap in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "keep_bitmap"))):
                kept, n, dropped = kept_lines(text or "", bitmap)
                for name, value in zip(out, (doc, n, dropped, hashlib.sha256(kept.encode()).hexdigest())):
                    out[name].append(value)
            yield batch_of(schema, **out)

    texts = joined_bitmaps(docs.select("doc_id", "text"), line_bitmaps(docs, **how))
    return texts.select("doc_id", "text", "keep_bitmap").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with each text cut down to its kept lines; null texts stay null, other columns stay, n_chars follows the text."""

    @F.pandas_udf("string")
    def cut(text, bitmap):
        return text.combine(bitmap, lambda t, b: t if b is None or t is None else kept_lines(t, b)[0])

    out = joined_bitmaps(docs, line_bitmaps(docs, **how))
    out = out.withColumn("text", F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(cut("text", "keep_bitmap")))
    return with_new_text(out, docs.columns)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
