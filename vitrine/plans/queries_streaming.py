"""Registered streaming queries: each writes an event log derived from the
driver's tables into the shared checkpoint folder as ordered slices, runs the
stream to completion (availableNow) and returns what the sink holds; the
oracle is the batch definition of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import outbox as OB
from vitrine.plans import views as V
from vitrine.plans.queries_events import FOLD_SQL, _fold_out, product_topic
from vitrine.plans.queries_outbox import DUE_SQL
from vitrine.plans.registry import register
from vitrine.session import scratch_path
from vitrine.streaming import streams as ST

# Fixed slice boundaries (event time) used to replay a log as several files.
SLICE_EDGES = ["2024-01-08", "2024-01-16", "2024-01-24"]


def slices(df, ts_col: str):
    """A log cut into consecutive event-time slices (fixed edges)."""
    edges = [None] + [F.lit(e).cast("timestamp_ntz") for e in SLICE_EDGES] + [None]
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(ts_col) >= lo)
        if hi is not None:
            cond = cond & (F.col(ts_col) < hi)
        yield df.filter(cond)


def replay(df, ts_col: str, path: str, start_stream) -> None:
    """Let the log arrive slice by slice: append a slice, then run the stream
    (availableNow, same checkpoint) over whatever is new - one micro-batch per
    slice, in log order."""
    for part in slices(df, ts_col):
        part.write.mode("append").parquet(path)
        start_stream().awaitTermination()


@register("stream_fold", FOLD_SQL, ("pevents_v",))
def q_stream_fold(spark, sf):
    """ST9 (stream form) + ST5/ST6/U2: the product topic replayed as slices and
    folded batch by batch into the parts its products lie in; equals the batch fold."""
    log = product_topic(spark, sf)
    src = scratch_path(spark, "topic-product-events")
    docs = scratch_path(spark, "docs")
    group = f"search-sync-{docs.rsplit('-', 1)[-1]}"
    replay(log, "timestamp", src, lambda: ST.fold_stream(spark, src, log.schema, docs, group=group))
    return _fold_out(ST.documents_table(docs).latest(spark))


@register("stream_daily_views", """
SELECT product_id, CAST(ts AS DATE) AS day, count(*) AS views FROM views_v GROUP BY 1, 2""", ("views_v",))
def q_stream_daily_views(spark, sf):
    """ST10: daily view counters maintained by a stream."""
    v = V.views(spark, sf)
    src = scratch_path(spark, "views")
    out = scratch_path(spark, "daily-views")
    name = f"daily-views-{out.rsplit('-', 1)[-1]}"
    replay(v, "ts", src, lambda: ST.daily_view_stream(spark, src, v.schema, out,
                                                      trigger=ST.AVAILABLE_NOW, name=name))
    return ST.KeyedTable(out, "product_id").latest(spark)


@register("stream_relay", f"""
SELECT 'outbox-' || CAST(id AS VARCHAR) AS id,
       CASE lower(aggregate_type) WHEN 'product' THEN 'product-events' WHEN 'order' THEN 'order-events'
            WHEN 'user' THEN 'user-events' ELSE 'general-events' END AS topic,
       event_type, aggregate_id AS partition_key
FROM outbox_v WHERE (NOT processed AND retry_count = 0) OR {DUE_SQL}""", ("outbox_v",))
def q_stream_relay(spark, sf):
    """ST1/ST2/ST13: outbox files relayed by a stream into per-topic folders; due retries leave by the clock."""
    O = V.outbox(spark, sf)
    src = scratch_path(spark, "outbox")
    topics = scratch_path(spark, "topics")
    name = f"relay-{topics.rsplit('-', 1)[-1]}"
    start = lambda now, clock, trigger: ST.relay_stream(
        spark, src, topics, O.schema, now, trigger=trigger, name=name, max_files=None, clock=clock)
    early = F.lit(V.AS_OF_TEXT).cast("timestamp_ntz") - F.make_dt_interval(F.lit(400))
    # every file arrives while no retry is due; what falls due later leaves when the clock says so, without a file
    replay(O, "created_at", src, lambda: start(early, True, ST.AVAILABLE_NOW))
    sent = lambda: spark.read.parquet(topics).count()
    before, waiting = sent(), O.filter(OB.is_retry_due(V.as_of()) & ~OB.is_retry_due(early)).count()
    ST.run_until(start(V.as_of(), True, ST.RELAY_TRIGGER), lambda: sent() >= before + waiting)
    return spark.read.parquet(topics).select("id", "topic", "event_type", "partition_key")
