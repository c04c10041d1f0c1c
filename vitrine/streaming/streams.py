"""Structured Streaming forms of the event operators.

ST1/ST2 relay outbox rows to topic folders, ST5 one query (and checkpoint)
per consumer group, ST6 idempotency, ST9 incremental fold into a document table
of which a micro-batch rewrites the parts it touches, ST10 daily view counters, ST13 trigger
choices and daily runs, U1-U3 listener registry (per-batch and per-message
handlers). Checkpoints live under the cluster's spark.checkpoint.dir.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators import fold as FO
from vitrine.operators import outbox as OB
from vitrine.session import checkpoint_dir
from vitrine.sources.stored import KeyedTable, VersionedTable
from vitrine.sources.tables import read_topic

# ST13: schedules of the reference (relay every 1 s as configured, retries
# every 10 s, view counters flushed every 30 s, retention once a day).
RELAY_TRIGGER = {"processingTime": "1 second"}
RETRY_TRIGGER = {"processingTime": "10 seconds"}
VIEW_FLUSH_TRIGGER = {"processingTime": "30 seconds"}
PURGE_TRIGGER = {"processingTime": "24 hours"}
PURGE_AT = dt.time(2, 0)
AVAILABLE_NOW = {"availableNow": True}


def event_time(ts) -> Column:
    """An event-time (TIMESTAMP) column for watermarks from a wall-clock
    TIMESTAMP_NTZ, independent of the session time zone: its epoch is the
    wall-clock value read as UTC, so 1-day windows are calendar days."""
    c = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, c))


def _checkpoint(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def _start(writer, trigger: dict) -> StreamingQuery:
    return writer.trigger(**trigger).start()


def ticks(spark: SparkSession) -> DataFrame:
    """A clock: one row a second. Joined to a source (``with_clock``) it makes micro-batches
    happen when time passes and no file arrives."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(True).alias("_tick"))


def with_clock(source: DataFrame) -> DataFrame:
    """The source and a clock; rows of the clock are null but for ``_tick``."""
    return source.withColumn("_tick", F.lit(False)).unionByName(ticks(source.sparkSession), allowMissingColumns=True)


# ST1 / ST2 --------------------------------------------------------------------------
def relay_stream(spark: SparkSession, outbox_path: str, topics_path: str, schema,
                 as_of: Column | Callable[[], Column], trigger: dict = RELAY_TRIGGER, name: str = "relay",
                 max_files: int = 1, clock: bool = True) -> StreamingQuery:
    """Outbox files -> topic folders (``batch=N/topic=T``, ST2). Each micro-batch
    relays its fresh and due rows and those of earlier batches that have become
    due; rows not yet due wait in a table beside the topics. With ``clock``, a micro-batch
    comes each second with or without a new file, so a row leaves when it is due. ``as_of`` is the
    time, asked once a micro-batch if callable. A re-run of a micro-batch
    rewrites its own folder and the same version of the waiting rows."""
    waiting = VersionedTable(f"{topics_path.rstrip('/')}-waiting")

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of if isinstance(as_of, Column) else as_of()
        if clock:
            batch = batch.where(~F.col("_tick")).drop("_tick")
        before = waiting.latest_before(batch.sparkSession, batch_id)
        rows = (batch if before is None else batch.unionByName(before)).persist()
        due = OB.relay(rows, now)
        arrived, leaving = not batch.isEmpty(), not due.isEmpty()
        if leaving:
            OB.route(due, f"{topics_path.rstrip('/')}/batch={batch_id}", mode="overwrite")
        if arrived or leaving:                      # a tick that changes nothing writes nothing
            waiting.write(rows.filter(OB.lifecycle(now) == "retry_waiting"), batch_id)
        rows.unpersist()

    source = read_topic(spark, outbox_path, max_files, schema)
    w = ((with_clock(source) if clock else source).writeStream.foreachBatch(handle)
         .option("checkpointLocation", _checkpoint(spark, name)))
    return _start(w, trigger)


# ST13 ------------------------------------------------------------------------------
def last_due(now: dt.datetime, at: dt.time) -> dt.datetime:
    """The last time before or at ``now`` that a daily job at ``at`` was due."""
    today = dt.datetime.combine(now.date(), at)
    return today if today <= now else today - dt.timedelta(days=1)


def daily_stream(spark: SparkSession, job: Callable[[SparkSession, dt.datetime, int], None], runs_path: str,
                 now: Callable[[], dt.datetime], at: dt.time = PURGE_AT, name: str = "daily",
                 trigger: dict = RETRY_TRIGGER) -> StreamingQuery:
    """Runs ``job`` (session, due time, run number) once a day at ``at``, as the clock passes it. The due times
    that have run are kept in ``runs_path``; a day missed while the stream was down runs once it is back."""
    runs = VersionedTable(runs_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session, due = batch.sparkSession, last_due(now(), at)
        before = runs.latest_before(session, batch_id)
        if before is not None and not before.where(F.col("due") >= F.lit(due.isoformat(" ")).cast("timestamp_ntz")).isEmpty():
            return
        job(session, due, batch_id)
        runs.write(session.createDataFrame([(due,)], "due timestamp_ntz").coalesce(1), batch_id)

    w = ticks(spark).writeStream.foreachBatch(handle).option("checkpointLocation", _checkpoint(spark, name))
    return _start(w, trigger)


def purge_stream(spark: SparkSession, outbox: VersionedTable, now: Callable[[], dt.datetime], name: str = "purge",
                 trigger: dict = RETRY_TRIGGER) -> StreamingQuery:
    """ST12 daily: the outbox without processed rows past retention, as its next version."""
    def job(session: SparkSession, due: dt.datetime, run: int) -> None:
        rows = outbox.latest_before(session, VersionedTable.FIRST_RUN + run)
        outbox.write(OB.purge(rows, F.lit(due.isoformat(" ")).cast("timestamp_ntz")), VersionedTable.FIRST_RUN + run)

    return daily_stream(spark, job, f"{outbox.path}-purges", now, name=name, trigger=trigger)


# ST5 / ST6 --------------------------------------------------------------------------
def consume(spark: SparkSession, topic_path: str, schema, group: str,
            handler: Callable[[DataFrame, int], None], trigger: dict = AVAILABLE_NOW,
            watermark: str | None = None, max_files: int = 1) -> StreamingQuery:
    """One consumer group = one streaming query with its own checkpoint, so
    every group reads every message once, from its own position (ST5); the
    handler gets (batch, batch_id) (U2). With ``watermark``, duplicates of an
    idempotency key within it are dropped before the handler sees them, with
    bounded state, and so are rows older than it; without, all rows arrive and
    the handler drops duplicates (``fold_handler`` does, exactly)."""
    src = read_topic(spark, topic_path, max_files, schema)
    if watermark:
        src = (src.withColumn("_idem", F.coalesce(F.col("headers")["idempotency-key"], F.col("id")))
               .withColumn("_et", event_time("timestamp"))
               .withWatermark("_et", watermark)
               .dropDuplicatesWithinWatermark(["_idem"]).drop("_idem", "_et"))
    w = src.writeStream.foreachBatch(handler).option("checkpointLocation", _checkpoint(spark, group))
    return _start(w, trigger)


class SeenKeys:
    """ST6 across micro-batches: the idempotency keys seen so far, in folders
    ``epoch=E/bucket=B/batch=N`` by offset range and hash of the key. A batch reads the buckets its own
    keys lie in. With ``horizon``, a message that comes again more than so many
    offsets after its first delivery is not known any more, and epochs that no later message can
    need are deleted: what a batch reads and what is kept is then bounded, however
    long the log. Without, all keys stay and every repeat is found."""

    SCHEMA = "key string, offset long, epoch long, bucket int, batch long"

    def __init__(self, path: str, buckets: int = 16, epoch: int = 1_000_000, horizon: int | None = None):
        self.path, self.buckets, self.epoch, self.horizon = path.rstrip("/"), buckets, epoch, horizon

    def _keyed(self, messages: DataFrame) -> DataFrame:
        key = F.coalesce(F.col("headers")["idempotency-key"], F.col("id"))
        return messages.withColumns({"_key": key, "_bucket": F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")})

    def _oldest(self, messages: DataFrame) -> int | None:
        """The first epoch that the messages can have repeats in."""
        if self.horizon is None:
            return None
        low = messages.agg(F.min("offset")).first()[0]
        return None if low is None else max(0, low - self.horizon) // self.epoch

    def known(self, messages: DataFrame, before: int) -> DataFrame | None:
        """(bucket, key) of earlier batches that the messages can meet."""
        spark = messages.sparkSession
        to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to_path(self.path)):
            return None
        buckets = [r["_bucket"] for r in self._keyed(messages).select("_bucket").distinct().collect()]     # at most ``buckets``
        seen = spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("bucket").isin(buckets) & (F.col("batch") < before))
        oldest = self._oldest(messages)
        return seen if oldest is None else seen.where(F.col("epoch") >= oldest)

    def fresh(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """The messages whose key no earlier batch had."""
        seen = self.known(messages, batch_id)
        if seen is None:
            return messages
        rows, seen = self._keyed(messages), seen.select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), F.col("offset").alias("_at"))
        if self.horizon is None:
            return rows.join(seen, ["_bucket", "_key"], "left_anti").drop("_bucket", "_key")
        last = seen.groupBy("_bucket", "_key").agg(F.max("_at").alias("_at"))
        again = F.coalesce(F.col("offset") - F.col("_at") <= self.horizon, F.lit(False))
        return rows.join(last, ["_bucket", "_key"], "left").where(~again).drop("_bucket", "_key", "_at")

    def add(self, messages: DataFrame, batch_id: int) -> None:
        """Keep the keys of a batch; a re-run writes the same folders again."""
        rows = (self._keyed(messages).groupBy("_key", "_bucket").agg(F.max("offset").alias("offset"))
                .select(F.col("_key").alias("key"), "offset", F.expr(f"offset div {self.epoch}").alias("epoch"),
                        F.col("_bucket").alias("bucket"), F.lit(batch_id).cast("long").alias("batch")))
        (rows.repartition("epoch", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch", "bucket", "batch").parquet(self.path))
        oldest = self._oldest(messages)
        if oldest:
            spark = messages.sparkSession
            to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            fs = to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(to_path(self.path)):
                name = s.getPath().getName()
                if name.startswith("epoch=") and int(name[6:]) < oldest:
                    fs.delete(s.getPath(), True)


def documents_table(path: str, parts: int = 16) -> KeyedTable:
    return KeyedTable(path, "product_id", parts)


def fold_handler(table: KeyedTable, seen: SeenKeys | None = None) -> Callable[[DataFrame, int], None]:
    """U2 handler that folds each micro-batch into the parts of the table that its
    products lie in. Messages whose key an earlier batch had are dropped,
    however late they come (ST6). Metric events that find no document
    when their batch is folded go to ``<table>-dropped/batch=N``."""
    seen = seen or SeenKeys(f"{table.path}-keys")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        # every payload is parsed once, and the fold reads the fields it needs
        new = FO.parse_events(seen.fresh(FO.dedupe(batch), batch_id)).drop("payload", "headers").persist()
        touched = table.touched(new)
        docs, dropped = FO.merge_parsed(table.read(batch.sparkSession, touched, before=batch_id), new)
        table.write(docs, batch_id, touched)
        dropped.write.mode("overwrite").parquet(f"{table.path}-dropped/batch={batch_id}")
        seen.add(batch, batch_id)
        new.unpersist()
        batch.unpersist()
    return handle


def fold_stream(spark: SparkSession, topic_path: str, schema, docs_path: str,
                trigger: dict = AVAILABLE_NOW, group: str = "search-sync",
                max_files: int | None = None) -> StreamingQuery:
    """ST9 stream form: product events -> (ST6) -> incremental fold (U2) ->
    search documents. Same result as the batch fold of the log."""
    return consume(spark, topic_path, schema, group, fold_handler(documents_table(docs_path)),
                   trigger=trigger, max_files=max_files)


# ST10 ------------------------------------------------------------------------------
def daily_view_stream(spark: SparkSession, views_path: str, schema, out_path: str,
                      trigger: dict = VIEW_FLUSH_TRIGGER, name: str = "daily-views",
                      max_files: int | None = None) -> StreamingQuery:
    """Views per product and day. Each micro-batch's counts are added to the
    parts of a counter table that its products lie in, so the table is current after every
    flush, no state is held in memory and views count however late they come."""
    table = KeyedTable(out_path, "product_id")

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = FO.daily_views(batch.where(F.col("product_id").isNotNull())).persist()
        touched = table.touched(counts)
        prev = table.read(batch.sparkSession, touched, before=batch_id)
        total = counts if prev is None else (prev.unionByName(counts).groupBy("product_id", "day")
                                             .agg(F.sum("views").alias("views")))
        table.write(total, batch_id, touched)
        counts.unpersist()

    source = read_topic(spark, views_path, max_files, schema)
    w = source.writeStream.foreachBatch(add).option("checkpointLocation", _checkpoint(spark, name))
    return _start(w, trigger)


# U1 - U3 ---------------------------------------------------------------------------
@dataclass
class Listener:
    """A listener = the topics it reads + a handler. ``batch_handler``
    takes precedence over ``message_handler`` (U1, applied per partition to
    pandas batches of messages, i.e. per message but Arrow-batched)."""
    name: str
    topics: list[str]
    batch_handler: Callable[[DataFrame, int], None] | None = None
    message_handler: Callable | None = None
    output_schema: str | None = None
    options: dict = field(default_factory=dict)


def as_batch_handler(listener: Listener, sink: Callable[[DataFrame, int], None]
                     ) -> Callable[[DataFrame, int], None]:
    if listener.batch_handler is not None:
        return listener.batch_handler

    def handle(batch: DataFrame, batch_id: int) -> None:
        def per_partition(it):
            for pdf in it:
                yield listener.message_handler(pdf)
        sink(batch.mapInPandas(per_partition, listener.output_schema), batch_id)
    return handle


def run_until(query: StreamingQuery, done: Callable[[], bool], seconds: int = 120) -> None:
    """Let a stream that never ends run until ``done``, then stop it; raises after ``seconds``."""
    stop = time.monotonic() + seconds
    try:
        while not done():
            if query.awaitTermination(1) or time.monotonic() > stop:
                raise TimeoutError(f"{query.name or 'stream'} has not got there in {seconds} s: {query.status}")
    finally:
        query.stop()


def start_listeners(spark: SparkSession, topics_root: str, schema, listeners: list[Listener],
                    sink: Callable[[DataFrame, int], None] | None = None,
                    trigger: dict = AVAILABLE_NOW, max_files: int | None = None) -> list[StreamingQuery]:
    """One streaming query per listener (its own checkpoint = its own group)."""
    out = []
    for lst in listeners:
        # topic folders are partitions of one root: the filter prunes them
        src = read_topic(spark, topics_root, max_files, schema).filter(F.col("topic").isin(lst.topics))
        handler = as_batch_handler(lst, sink or (lambda df, i: None))
        w = src.writeStream.foreachBatch(handler).option(
            "checkpointLocation", _checkpoint(spark, f"listener-{lst.name}"))
        out.append(_start(w, trigger))
    return out
