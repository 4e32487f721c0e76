"""Streams: windows over event time, deduplication, change detection, keyed upserts by batch, and the due rule of polled sources."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, schema, delay: str = "1 hour") -> DataFrame:
    """A file stream of events with a watermark; ts without a zone is cast, as watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return _counted(events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours") -> DataFrame:
    return _counted(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Per user, runs of events with no pause of `gap`."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _counted(events: DataFrame, window: Column) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; later ones within the watermark's delay are dropped, and state older than that goes."""
    return events.dropDuplicatesWithinWatermark(keys)


def poll(stream: DataFrame, handle, checkpoint: str, every: str = "60 seconds"):
    """Starts a polling loop: each tick hands what is new to handle(batch, batch_id). stop() on the query ends it after the batch at work is done or given up; a restart repeats that batch under its id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into an in-memory table: for tests and fixtures only."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def upsert_batches(stream: DataFrame, key: str, folder: str, checkpoint: str):
    """Starts a query that merges each batch into the newest state of `folder`: a state a batch id, so a repeated batch does no harm.

    Later rows (by ts) win within a batch; null fields leave what was there. The state of the batch before is read, merged by
    a full outer join, and written under the batch's own id.
    """
    columns = [c for c in stream.columns if c != key]

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = F.struct("ts", *[c for c in columns if c != "ts"])
        new = batch.groupBy(key).agg(F.max(newest).alias("_new")).select(key, *(F.col(f"_new.{c}").alias(f"_n_{c}") for c in columns))
        if batch_id == 0:
            state = new.select(key, *(F.col(f"_n_{c}").alias(c) for c in columns))
        else:
            old = batch.sparkSession.read.parquet(f"{folder}/batch={batch_id - 1}")
            state = old.join(new, key, "full_outer").select(key, *(F.coalesce(f"_n_{c}", c).alias(c) for c in columns))
        state.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CarriedFold(StatefulProcessor):
    """A key's fold in state: totals of the key, and by field the count, sum and the last value; what a batch touches comes out.

    Values are added in whatever order they come; the last value is that of the largest (at, order). A key that event time has passed by `idle` is sealed: its
    fields come out once more with sealed = true, and its state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.key_state = handle.getValueState("key", "first_us long, last_us long, timer long")
        self.fields = handle.getMapState("fields", "field string", "n long, total double, last double, last_us long, last_order long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        touched, first, last = {}, None, None
        for r in rows:
            n, total, value, at, order = touched.get(r["field"]) or (self.fields.getValue((r["field"],)) if self.fields.containsKey((r["field"],)) else None) or (0, 0.0, None, None, None)
            newer = at is None or (r["us"], r["order"]) >= (at, order)
            touched[r["field"]] = (n + 1, total + (r["value"] or 0.0), *((r["value"], r["us"], r["order"]) if newer else (value, at, order)))
            first, last = (r["us"] if x is None else pick(x, r["us"]) for x, pick in ((first, min), (last, max)))
        if not touched:
            return
        timer = None
        if self.key_state.exists():
            was_first, was_last, timer = self.key_state.get()
            first, last = min(first, was_first), max(last, was_last)
        due = last // 1000 + self.idle_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.key_state.update((first, last, due))
        for field, own in touched.items():
            self.fields.updateValue((field,), own)
            yield Row(key=key[0], field=field, n=own[0], total=own[1], last=own[2], first_us=first, last_us=last, sealed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, _ = self.key_state.get()
        for (field,), (n, total, value, _, _) in list(self.fields.iterator()):
            yield Row(key=key[0], field=field, n=n, total=total, last=value, first_us=first, last_us=last, sealed=True)
        self.fields.clear()
        self.key_state.clear()

    def close(self) -> None:
        pass


FOLD_DDL = "key long, field string, n long, total double, last double, first_at timestamp, last_at timestamp, sealed boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def carried_fold(events: DataFrame, idle: float = 30 * 86400.0) -> DataFrame:
    """FOLD_DDL rows of a stream (key, field, value, at, order) with a watermark on `at`: what each batch changes, in update mode.

    State is kept key by key in the state store and written as changes, so a batch costs what it touches, not what has been folded so far; a restart goes on from the
    last batch that was done. The session has to use the store of `with_state_store`.
    """
    rows = events.where("at is not null").select("key", "field", "value", "at", "order", F.unix_micros("at").alias("us"))
    told = rows.groupBy("key").transformWithState(CarriedFold(int(idle * 1000)), "key long, field string, n long, total double, last double, first_us long, last_us long, sealed boolean", "Update", "EventTime")
    return told.select("key", "field", "n", "total", "last", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"), "sealed")


@contextmanager
def with_state_store(spark: SparkSession):
    """The store that keyed state needs, for queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def run_fold(events: DataFrame, folder: str, checkpoint: str, idle: float = 30 * 86400.0) -> None:
    """Folds what is there now into change rows of `folder`, one batch=<id> folder a batch: a batch that is done again replaces its own."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    with with_state_store(events.sparkSession):
        stream = carried_fold(events, idle).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each key and field that run_fold() has written; fields of one key share its newest first_at and last_at."""
    rows = spark.read.schema(f"{FOLD_DDL}, batch long").parquet(folder)
    columns = ["n", "total", "last", "first_at", "last_at", "sealed"]
    newest = rows.groupBy("key", "field").agg(F.max_by(F.struct("batch", *columns), F.struct("batch", "sealed")).alias("r"))
    ends = rows.groupBy("key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return newest.select("key", "field", "r.n", "r.total", "r.last", "r.sealed").join(ends, "key")


def is_due(status: Column, last_attempt: Column, last_success: Column, cadence_h: Column, now: Column) -> Column:
    """Whether a polled source is due: errors back off by a quarter of the cadence within half an hour and six hours."""
    hours = lambda a: (now.cast("double") - a.cast("double")) / 3600
    back_off = F.least(F.lit(6.0), F.greatest(F.lit(0.5), cadence_h / 4))
    return (
        F.when((status == "error") & last_attempt.isNotNull(), hours(last_attempt) >= back_off).when((status == "skipped") & last_attempt.isNotNull(), hours(last_attempt) >= cadence_h)
        .when((status == "todo") | last_success.isNull(), F.lit(True)).otherwise(hours(last_success) >= cadence_h)
    )


def changed(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """key, hash of what is new or differs from what was recorded (both key, hash)."""
    return current.join(recorded.select("key", F.col("hash").alias("_was")), "key", "left").where(~F.col("hash").eqNullSafe(F.col("_was"))).drop("_was")


def within_budget(writes: DataFrame, day: Column, budget: int) -> DataFrame:
    """day, n, allowed: whole batches of a day are refused once they would pass the budget."""
    return writes.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("n") <= budget)
