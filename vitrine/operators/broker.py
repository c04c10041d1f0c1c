"""Topic operators as set operations over a message frame ``M``.

W1 dense per-topic offsets, ST16 publish, ST3 messages after a commit position, ST4 commit
positions, ST8 retry / dead-letter split, A6-A9 topic, publishing and delivery statistics.
All of them read the delivery outcome that the outbox records with every message; consumer groups
are streaming queries (``streaming.streams.consume``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import messaging as MX
from vitrine.session import checkpoint_dir

#: Messages that the outbox relay publishes at a time.
PUBLISH_BATCH = 50


def assign_offsets(M: DataFrame, order: list[str], start: DataFrame | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Gap-free offsets from 1 per topic in ``order`` (must be a total order).

    Not one window per topic (that would put a whole topic in one task):
      1. range-partition by (topic, *order) and sort inside each partition, so
         partition i holds one contiguous slice of the global order;
      2. tag each row with (partition id, position) and cut lineage with a
         reliable checkpoint so the tags are fixed even if a task is re-run;
      3. count rows per (topic, partition) - at most topics x partitions rows,
         a bound set by configuration, not by data - and prefix-sum them;
      4. offset = start + rows of the topic in earlier partitions + rank here.
    ``start``: optional (topic, last_offset) to continue after (ST16).
    """
    spark = M.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = (M.repartitionByRange(n, "topic", *order)
             .sortWithinPartitions("topic", *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_pos", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    counts = keyed.groupBy("topic", "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                                F.min("_pos").alias("_first"))
    before = Window.partitionBy("topic").orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if start is not None:
        counts = (counts.join(start.select("topic", F.col("last_offset").alias("_base")), "topic", "left"))
    else:
        counts = counts.withColumn("_base", F.lit(0).cast("bigint"))
    # counts has at most topics x n rows: safe to broadcast
    out = keyed.join(F.broadcast(counts.drop("_n")), ["topic", "_pid"])
    off = (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_before")
           + (F.col("_pos") - F.col("_first")) + 1).cast("bigint")
    return out.withColumn("offset", off).drop("_pid", "_pos", "_first", "_before", "_base")


def publish(new: DataFrame, M: DataFrame, order: list[str]) -> DataFrame:
    """ST16: append a batch with offsets continuing after each topic's last."""
    last = M.groupBy("topic").agg(F.max("offset").alias("last_offset"))
    return assign_offsets(new.drop("offset"), order, start=last)


def progress(M: DataFrame) -> DataFrame:
    """ST4: per topic the commit position ``offset``, up to which every message has been
    processed, the last offset, and how many messages after the position wait."""
    open_at = F.min(F.when(F.col("processed_at").isNull(), F.col("offset")))
    return M.groupBy("topic").agg(
        F.coalesce(open_at - 1, F.max("offset")).alias("offset"), F.max("offset").alias("last_offset"),
        F.count_if(F.col("processed_at").isNull()).alias("waiting"))


def commit(committed: DataFrame, acks: DataFrame) -> DataFrame:
    """ST4: new commit position per topic; monotone (max), so a late
    acknowledgement cannot move it back (Q11)."""
    u = committed.select("topic", "offset").unionByName(acks.select("topic", "offset"))
    return u.groupBy("topic").agg(F.max("offset").alias("offset"))


def poll(M: DataFrame, committed: DataFrame, n: int | None = None) -> DataFrame:
    """ST3: the messages after each topic's commit position, all or the first ``n`` of each topic (cut before
    the shuffle). A topic without a position is read from its start."""
    c = F.broadcast(committed.select("topic", F.col("offset").alias("_committed")))      # one row a topic
    pending = M.join(c, "topic", "left").filter(F.col("offset") > F.coalesce(F.col("_committed"), F.lit(0))).drop("_committed")
    if n is None:
        return pending
    w = Window.partitionBy("topic").orderBy("offset")
    return pending.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def split_retry_dead(failed: DataFrame, max_retries: int = MX.MAX_CONSUMER_RETRIES) -> DataFrame:
    """ST8: failed messages: retry-count header < max -> 'retry' with the header
    incremented and a backoff (F19); otherwise 'dead' (acknowledged)."""
    r = MX.retry_count_header("headers")
    out = failed.withColumn("_retry", r)
    return (out.withColumn("outcome", F.when(F.col("_retry") < max_retries, "retry").otherwise("dead"))
            .withColumn("headers", F.when(F.col("outcome") == "retry", F.map_concat(
                F.map_filter("headers", lambda k, v: k != "retry-count"),
                F.create_map(F.lit("retry-count"), (F.col("_retry") + 1).cast("string"))))
                .otherwise(F.col("headers")))
            .withColumn("backoff_ms", F.when(F.col("outcome") == "retry",
                                             MX.consumer_backoff_ms(F.col("_retry"))))
            .drop("_retry"))


def broker_stats(M: DataFrame) -> DataFrame:
    """Per topic: messages (= its last offset when offsets are dense), event types, first and last time."""
    return M.groupBy("topic", "event_type").agg(
        F.count(F.lit(1)).alias("messages"), F.max("offset").alias("last_offset"), F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at")).groupBy("topic").agg(
        F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("event_types"), F.max("last_offset").alias("last_offset"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def publisher_stats(M: DataFrame) -> DataFrame:
    """Per topic, over its publishing days: messages, days, failed messages, mean messages a day, last time."""
    days = M.groupBy("topic", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("retry_count") > 0).alias("failed"), F.max("timestamp").alias("last"))
    return days.groupBy("topic").agg(
        F.sum("messages").alias("total_messages"), F.count(F.lit(1)).alias("total_batches"), F.sum("failed").alias("total_failures"),
        (F.sum("messages") / F.count(F.lit(1))).alias("avg_batch_size"), F.max("last").alias("last_publish"))


def batch_stats(M: DataFrame, size: int = PUBLISH_BATCH) -> DataFrame:
    """A7 over the whole log: messages, publishing batches (``size`` offsets of a topic) and failed messages, in one row."""
    batches = M.groupBy("topic", F.floor((F.col("offset") - 1) / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("retry_count") > 0).alias("failed"))
    return batches.agg(F.sum("messages").alias("total_messages"), F.count(F.lit(1)).alias("total_batches"), F.sum("failed").alias("total_failures"))


def consumer_stats(M: DataFrame) -> DataFrame:
    """Delivery per topic and event type: messages, processed, failed, retried, dead, mean time from
    creation to processing, last processing and last offset."""
    r = F.col("retry_count")
    lag = (F.unix_millis(F.col("processed_at").cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp")))
    return M.groupBy("topic", "event_type").agg(
        F.count(F.lit(1)).alias("consumed"), F.count("processed_at").alias("processed"), F.count_if(r > 0).alias("failed"),
        F.count_if((r > 0) & (r < MX.MAX_OUTBOX_RETRIES)).alias("retried"), F.count_if(r >= MX.MAX_OUTBOX_RETRIES).alias("dead"),
        F.avg(lag).alias("avg_ms_per_message"), F.max("processed_at").alias("last_processed"), F.max("offset").alias("max_offset"))


def group_stats(per_consumer: DataFrame) -> DataFrame:
    """Per topic: sums, and the unweighted mean of its event types' mean times."""
    return per_consumer.groupBy("topic").agg(
        F.count(F.lit(1)).alias("event_types"), F.sum("consumed").alias("consumed"), F.sum("failed").alias("failed"),
        F.sum("dead").alias("dead"), F.avg("avg_ms_per_message").alias("avg_ms_per_message"))
