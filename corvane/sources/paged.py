"""A Spark data source of paged endpoints: a partition is a page or a run of pages, and an interrupted scan is resumed instead of done again.

An endpoint is a folder whose page=<k> folders hold one page each, {"result": {"total": n, "records": [...]}}, as an API gives them by limit and offset. Where pages are many,
a folder for each costs more than its rows: with `group` pages to a folder, the folders are group=<k div group> and each line is a page, {"page": k, "result": {...}}.
Pages are asked for by the tasks, so a lost executor costs the pages that it was reading. Nothing is read before the endpoint's own total is within its
bounds and its first record has the required fields.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: With more pages than that, a task asks for several in a row.
TASKS = 512


def _documents(endpoint: str, folder: str) -> list[dict]:
    """The documents of a folder's one file, a line each. A file that is not there, is cut off or is no JSON is an error."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(endpoint) if ":/" in endpoint else (fs.LocalFileSystem(), endpoint)
    files = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}")) if f.is_file and not f.base_name.startswith((".", "_"))]
    if len(files) != 1:
        raise ValueError(f"{endpoint} has {len(files)} files in {folder}")
    raw = store.open_input_stream(files[0].path, compression=None).read()
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    return [json.loads(line) for line in raw.split(b"\n") if line.strip()] if folder.startswith("group=") else [json.loads(raw)]


def fetch_pages(endpoint: str, first: int, last: int, group: int = 1) -> Iterator[tuple[int, dict]]:
    """Pages first to last and their `result`; a folder is read once. A page that is not there is an error."""
    if group == 1:
        for page in range(first, last + 1):
            yield page, _documents(endpoint, f"page={page}")[0]["result"]
        return
    for g in range(first // group, last // group + 1):
        found = {d["page"]: d["result"] for d in _documents(endpoint, f"group={g}")}
        for page in range(max(first, g * group), min(last, g * group + group - 1) + 1):
            if page not in found:
                raise ValueError(f"{endpoint} has no page {page} in group={g}")
            yield page, found[page]


def fetch_page(endpoint: str, page: int, group: int = 1) -> dict:
    """One page's `result`."""
    return next(fetch_pages(endpoint, page, page, group))[1]


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    total: int

    def __post_init__(self):
        super().__init__(self.first)


class PagedSource(DataSource):
    """spark.read.format("paged"): options endpoint, limit, group, first_page, least, most, required (names joined by commas).

    The schema names the fields that are wanted, all of them text; `_page` and `_total` come on top where it has them. A record without a field has null.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the fields that are wanted as the schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(dict(self.options), schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.endpoint, self.limit = options["endpoint"], int(options.get("limit", 5000))
        self.group = int(options.get("group", 1))
        self.first, self.least, self.most = (int(options.get(k, d)) for k, d in (("first_page", 0), ("least", 0), ("most", 1 << 62)))
        self.required = [c for c in options.get("required", "").split(",") if c]
        self.fields = [f.name for f in schema.fields]

    def partitions(self) -> list[Pages]:
        head = fetch_page(self.endpoint, 0, self.group)
        total, records = head.get("total"), head.get("records", [])
        if total is None or not self.least <= total <= self.most:
            raise ValueError(f"{self.endpoint}: a total of {total}, not {self.least} to {self.most}")
        lacking = [c for c in self.required if records and c not in records[0]]
        if lacking:
            raise ValueError(f"{self.endpoint}: the first record lacks {lacking}")
        pages = -(-total // self.limit)
        run = -(-max(1, -(-(pages - self.first) // TASKS)) // self.group) * self.group  # whole folders
        starts = [self.first, *range((self.first // run + 1) * run, pages, run)] if self.first < pages else []
        return [Pages(p, min(p // run * run + run, pages) - 1, total) for p in starts]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        if partition is None:  # there is no page to read
            return
        for page, found in fetch_pages(self.endpoint, partition.first, partition.last, self.group):
            wanted = min(self.limit, partition.total - page * self.limit)
            if len(found["records"]) != wanted:
                raise ValueError(f"{self.endpoint}: page {page} has {len(found['records'])} records, not {wanted}")
            own = {"_page": str(page), "_total": str(found["total"])}
            for record in found["records"]:
                known = {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in record.items()} | own
                yield tuple(known.get(c) for c in self.fields)


def scan(spark: SparkSession, endpoint: str, fields: list[str], limit: int, first_page: int = 0, **checks) -> DataFrame:
    """The records of an endpoint's pages from first_page on; checks: least, most, required, and group where folders hold several pages."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").schema(", ".join(f"`{f}` string" for f in fields)).option("endpoint", endpoint).option("limit", limit).option("first_page", first_page)
    for key, value in checks.items():
        reader = reader.option(key, ",".join(value) if isinstance(value, (list, tuple)) else value)
    return reader.load()


def resume_from(landed: DataFrame) -> int:
    """The page that an interrupted scan goes on with; landed has a row for each page (or line of a page) there, with its number `page`.

    The last page is never trusted, as the scan may have died while it was written. If the others are not 0, 1, 2, ... the scan starts anew.
    """
    last, n = landed.select(F.col("page").cast("long").alias("page")).agg(F.max("page"), F.count_distinct("page")).first()
    return 0 if last is None or n != last + 1 else int(last)


def landed_pages(spark: SparkSession, landed: str, group: int = 1) -> DataFrame:
    """page, value: what a scan has landed. A line that was cut before its number was whole has none, so it counts as not there."""
    if group == 1:
        return spark.read.schema("value string, page long").text(landed, wholetext=True)
    rows = spark.read.schema("value string, group long").text(landed)
    return rows.select("value", F.nullif(F.regexp_extract("value", r'^\{"page":(\d+),', 1), F.lit("")).cast("long").alias("page"))


def resumed(spark: SparkSession, endpoint: str, landed: str, fields: list[str], limit: int, group: int = 1, **checks) -> tuple[DataFrame, int]:
    """All records of an endpoint, and the first page that was asked for: what an interrupted scan has landed (folders as the endpoint's) is kept but for its last page."""
    there = landed_pages(spark, landed, group)
    first = resume_from(there)
    fresh = scan(spark, endpoint, fields, limit, first, group=group, **checks)
    if not first:
        return fresh, 0
    shape = "struct<result: struct<records: array<struct<" + ",".join(f"`{f}`: string" for f in fields) + ">>>>"
    kept = there.where(F.col("page") < first).select(F.inline(F.from_json("value", shape, {"mode": "FAILFAST"})["result"]["records"]))
    return kept.unionByName(fresh), first


@dataclass(frozen=True)
class Scanned:
    """What a scan did: rows, the hash to remember, whether nothing had changed, and a note."""

    rows: int
    content_hash: str
    unchanged: bool
    note: str


def scan_if_changed(spark: SparkSession, source_id: str, endpoint: str, fields: list[str], limit: int, previous_hash: str | None = None, **checks) -> tuple[DataFrame | None, Scanned]:
    """The records and what was done; no page but the first is read if the endpoint's total is the one behind previous_hash."""
    total = int(fetch_page(endpoint, 0)["total"])
    digest = hashlib.sha256(f"{source_id}:total={total}".encode()).hexdigest()
    if digest == previous_hash:
        return None, Scanned(total, digest, True, f"unchanged (total={total} matches previous ingest)")
    return scan(spark, endpoint, fields, limit, **checks), Scanned(total, digest, False, f"{total} rows")
