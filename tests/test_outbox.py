"""Outbox rules: the retry / dead-letter truth tables, backoff, routing,
headers and retention of the reference's outbox tests."""

import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import outbox as OB
from vitrine.sources import schemas as SC

AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)
def as_of_col():
    return F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")


def _rows(spark, rows):
    base = dict(aggregate_id="123", aggregate_type="Product", event_type="ProductCreated",
                event_data='{"productId": 123}', created_at=AS_OF - dt.timedelta(hours=1),
                processed=False, processed_at=None, retry_count=0, next_retry_at=None,
                error_message=None)
    data = [tuple({**base, **r}[f.name] for f in SC.OUTBOX.fields) for r in rows]
    return spark.createDataFrame(data, SC.OUTBOX)


def test_retry_truth_table(spark):
    m = dt.timedelta(minutes=1)
    O = _rows(spark, [
        dict(id=1, retry_count=2, next_retry_at=AS_OF - m),          # due
        dict(id=2, retry_count=2, next_retry_at=None),               # due
        dict(id=3, retry_count=2, processed=True),                   # processed: not due
        dict(id=4, retry_count=5),                                   # limit reached
        dict(id=5, retry_count=2, next_retry_at=AS_OF + 5 * m),      # not yet
        dict(id=6, retry_count=0),                                   # fresh
    ])
    due = {r.id for r in OB.retryable(O, as_of_col()).collect()}
    assert due == {1, 2}
    status = {r.id: r.status for r in OB.classify(O, as_of_col()).collect()}
    assert status == {1: "retry_due", 2: "retry_due", 3: "processed", 4: "dead",
                      5: "retry_waiting", 6: "fresh"}


def test_dead_letter(spark):
    O = _rows(spark, [dict(id=1, retry_count=5), dict(id=2, retry_count=5, processed=True),
                      dict(id=3, retry_count=3)])
    assert [r.id for r in OB.dead_letter(O).collect()] == [1]


def test_backoff_after_failure(spark):
    O = _rows(spark, [dict(id=1, retry_count=2), dict(id=2, retry_count=0)])
    fails = spark.createDataFrame([(1, "boom")], "id long, error string")
    out = {r.id: r for r in OB.apply_failures(O, fails, as_of_col()).collect()}
    assert out[1].retry_count == 3
    assert out[1].next_retry_at == AS_OF + dt.timedelta(minutes=8)
    assert out[1].error_message == "boom"
    assert out[2].retry_count == 0 and out[2].next_retry_at is None


def test_routing_and_headers(spark):
    O = _rows(spark, [dict(id=1, aggregate_type="Product"), dict(id=2, aggregate_type="Order"),
                      dict(id=3, aggregate_type="Inventory"), dict(id=4, aggregate_type="USER")])
    msgs = {r.outbox_id: r for r in OB.relay(O, as_of_col()).collect()}
    assert {k: v.topic for k, v in msgs.items()} == {1: "product-events", 2: "order-events",
                                                      3: "general-events", 4: "user-events"}
    h = msgs[1].headers
    assert h["idempotency-key"] == "outbox-event-1"
    assert h["aggregate-id"] == "123" and h["source"] == "vitrine"
    assert msgs[1].partition_key == "123"


def test_retention_cutoff(spark):
    d = dt.timedelta(days=1)
    O = _rows(spark, [dict(id=1, processed=True, processed_at=AS_OF - 8 * d),
                      dict(id=2, processed=True, processed_at=AS_OF - 6 * d),
                      dict(id=3, processed=False)])
    assert sorted(r.id for r in OB.purge(O, as_of_col()).collect()) == [2, 3]


def test_stats(spark):
    O = _rows(spark, [dict(id=1), dict(id=2, processed=True), dict(id=3, retry_count=2)])
    s = OB.outbox_stats(O).first()
    assert s.unprocessed_count == 2 and s.status_groups == 3
