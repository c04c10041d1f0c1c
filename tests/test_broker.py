"""Topic offsets, bounded poll, commit and broker statistics."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import broker as B

T0 = dt.datetime(2024, 1, 1)


def _msgs(spark, rows):
    return spark.createDataFrame(
        [(f"m{i}", t, T0 + dt.timedelta(seconds=s), i) for i, (t, s) in enumerate(rows)],
        "id string, topic string, timestamp timestamp_ntz, seq long")


def test_offsets_start_at_one_per_topic(spark):
    M = _msgs(spark, [("a", 1), ("a", 2), ("a", 3)])
    got = sorted(r.offset for r in B.assign_offsets(M, ["timestamp", "seq"]).collect())
    assert got == [1, 2, 3]


def test_offsets_match_row_number_on_many_partitions(spark):
    rows = [("t%d" % (i % 3), (i * 7919) % 5000) for i in range(3000)]
    M = _msgs(spark, rows).repartition(7)
    got = B.assign_offsets(M, ["timestamp", "seq"], partitions=11)
    w = Window.partitionBy("topic").orderBy("timestamp", "seq")
    want = M.withColumn("offset", F.row_number().over(w))
    assert got.select("id", "offset").exceptAll(want.select("id", "offset")).count() == 0
    assert got.count() == 3000


def test_publish_continues_offsets(spark):
    M = B.assign_offsets(_msgs(spark, [("a", 1), ("a", 2)]), ["timestamp", "seq"])
    new = _msgs(spark, [("a", 10), ("b", 11)]).withColumn("id", F.concat(F.lit("n"), "id"))
    out = {(r.topic, r.offset) for r in B.publish(new, M, ["timestamp", "seq"]).collect()}
    assert out == {("a", 3), ("b", 1)}


def _log(spark, done):
    """Topic a with one message per entry, processed where true, and topic b with one open message."""
    M = B.assign_offsets(_msgs(spark, [("a", i) for i in range(len(done))] + [("b", 50)]), ["timestamp", "seq"])
    rows = [(i, T0 + dt.timedelta(hours=1) if x else None, 0 if x else 1 + i) for i, x in enumerate([*done, False])]
    out = spark.createDataFrame(rows, "seq long, processed_at timestamp_ntz, retry_count int")
    return M.join(out, "seq").withColumns({"created_at": F.col("timestamp"), "event_type": F.concat(F.lit("E"), F.col("seq") % 2)})


def test_poll_limit_and_after_commit(spark):
    M = _log(spark, [True, True, False, True, False])
    position = B.progress(M)
    assert {(r.topic, r.offset, r.last_offset, r.waiting) for r in position.collect()} == {("a", 2, 5, 2), ("b", 0, 1, 1)}
    assert {(r.topic, r.offset) for r in B.poll(M, position).collect()} == {("a", 3), ("a", 4), ("a", 5), ("b", 1)}
    assert {(r.topic, r.offset) for r in B.poll(M, position, 2).collect()} == {("a", 3), ("a", 4), ("b", 1)}
    none = position.limit(0)
    assert sorted(r.offset for r in B.poll(M, none, 3).where("topic = 'a'").collect()) == [1, 2, 3]


def test_everything_processed_leaves_nothing_to_poll(spark):
    M = _log(spark, [True, True]).where("topic = 'a'")
    assert B.progress(M).first().offset == 2 and B.poll(M, B.progress(M)).count() == 0


def test_commit_is_monotone(spark):
    c = spark.createDataFrame([("a", 5)], "topic string, offset long")
    acks = spark.createDataFrame([("a", 3), ("b", 2)], "topic string, offset long")
    assert {(r.topic, r.offset) for r in B.commit(c, acks).collect()} == {("a", 5), ("b", 2)}


def test_topic_statistics(spark):
    M = _log(spark, [True, True, False, True, False])
    s = {r.topic: r for r in B.broker_stats(M).collect()}
    assert (s["a"].messages, s["a"].event_types, s["a"].last_offset) == (5, 2, 5) and s["b"].messages == 1
    p = {r.topic: r for r in B.publisher_stats(M).collect()}
    assert (p["a"].total_messages, p["a"].total_batches, p["a"].total_failures, p["a"].avg_batch_size) == (5, 1, 2, 5.0)
    c = {(r.topic, r.event_type): r for r in B.consumer_stats(M).collect()}
    e0 = c["a", "E0"]                                   # messages 0, 2, 4: the last two open, after 3 and 5 attempts
    assert (e0.consumed, e0.processed, e0.failed, e0.retried, e0.dead, e0.max_offset) == (3, 1, 2, 1, 1, 5)
    assert e0.avg_ms_per_message == 3_600_000
    g = {r.topic: r for r in B.group_stats(B.consumer_stats(M)).collect()}
    assert (g["a"].event_types, g["a"].consumed, g["a"].failed, g["a"].dead) == (2, 5, 2, 1)


def test_batches_of_the_publish_log(spark):
    M = B.assign_offsets(_msgs(spark, [("a", i) for i in range(101)] + [("b", 5)]), ["timestamp", "seq"])
    r = B.batch_stats(M.withColumn("retry_count", (F.col("seq") % 2).cast("int"))).first()
    assert (r.total_messages, r.total_batches, r.total_failures) == (102, 4, 51)


def test_retry_then_dead(spark):
    M = spark.createDataFrame([("m1", {"retry-count": "1"}), ("m2", {"retry-count": "3"}), ("m3", {})],
                              "id string, headers map<string,string>")
    out = {r.id: r for r in B.split_retry_dead(M).collect()}
    assert out["m1"].outcome == "retry" and out["m1"].headers["retry-count"] == "2"
    assert out["m1"].backoff_ms == 2000
    assert out["m2"].outcome == "dead"
    assert out["m3"].outcome == "retry" and out["m3"].backoff_ms == 1000
