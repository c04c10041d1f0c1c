"""Stream forms equal their batch definitions."""

import os
import tempfile

from pyspark.sql import functions as F

from vitrine.operators import broker as B
from vitrine.operators import fold as FO
from vitrine.streaming import streams as ST
from tests.test_fold import _frame, _random_log, _result, model


def test_stream_fold_equals_model(spark):
    msgs = _random_log(11, n=60)
    M = _frame(spark, msgs)
    root = tempfile.mkdtemp(prefix="vitrine-test-stream-")
    src, docs = os.path.join(root, "topic"), os.path.join(root, "docs")
    group = "g-" + os.path.basename(root)
    for lo, hi in ((0, 20), (20, 40), (40, 61)):
        M.filter((F.col("offset") > lo) & (F.col("offset") <= hi)).write.mode("append").parquet(src)
        ST.fold_stream(spark, src, M.schema, docs, group=group).awaitTermination()
    assert _result(ST.documents_table(docs).latest(spark)) == model(msgs)


def test_stream_fold_takes_late_events_and_drops_late_repeats(spark):
    """Event times run backwards, a day a message: nothing is too late."""
    msgs = _random_log(12, n=45)
    M = _frame(spark, msgs).withColumn(
        "timestamp", F.expr("timestamp_ntz'2024-06-01 00:00:00' - make_dt_interval(cast(offset as int))"))
    root = tempfile.mkdtemp(prefix="vitrine-test-late-")
    src, docs = os.path.join(root, "topic"), os.path.join(root, "docs")
    for lo, hi in ((0, 15), (15, 30), (30, 46)):
        M.filter((F.col("offset") > lo) & (F.col("offset") <= hi)).write.mode("append").parquet(src)
        ST.fold_stream(spark, src, M.schema, docs, group="late-" + os.path.basename(root)).awaitTermination()
    assert _result(ST.documents_table(docs).latest(spark)) == model(msgs)


def test_relay_stream_sends_rows_once_they_fall_due(spark):
    import datetime as dt

    from vitrine.sources import schemas as SC
    day = lambda d: dt.datetime(2024, 1, d)

    def row(i, retries, due):
        values = dict(id=i, aggregate_id="1", aggregate_type="Product", event_type="ProductUpdated", event_data="{}",
                      created_at=day(1), processed=False, retry_count=retries, next_retry_at=due)
        return tuple(values.get(f.name) for f in SC.OUTBOX.fields)

    root = tempfile.mkdtemp(prefix="vitrine-test-relay-")
    src, topics = os.path.join(root, "outbox"), os.path.join(root, "topics")
    for today, rows, sent in ((2, [row(1, 0, None), row(2, 1, day(3)), row(3, 1, day(9))], [1]),
                              (4, [row(4, 0, None)], [1, 2, 4]), (5, [row(5, 5, day(1))], [1, 2, 4])):
        spark.createDataFrame(rows, SC.OUTBOX).write.mode("append").parquet(src)
        ST.relay_stream(spark, src, topics, SC.OUTBOX, lambda: F.lit(str(day(today))).cast("timestamp_ntz"),
                        trigger=ST.AVAILABLE_NOW, name="relay-" + os.path.basename(root), clock=False).awaitTermination()
        assert sorted(r.outbox_id for r in spark.read.parquet(topics).collect()) == sent


def test_relay_stream_sends_due_rows_without_a_new_file(spark):
    import datetime as dt

    from vitrine.sources import schemas as SC

    row = dict(id=1, aggregate_id="1", aggregate_type="Product", event_type="ProductUpdated", event_data="{}",
               created_at=dt.datetime(2024, 1, 1), processed=False, retry_count=1, next_retry_at=dt.datetime(2024, 1, 5))
    fresh = row | dict(id=2, retry_count=0, next_retry_at=None)
    root = tempfile.mkdtemp(prefix="vitrine-test-clock-")
    src, topics = os.path.join(root, "outbox"), os.path.join(root, "topics")
    spark.createDataFrame([tuple(r.get(f.name) for f in SC.OUTBOX.fields) for r in (row, fresh)], SC.OUTBOX).write.parquet(src)
    today = ["2024-01-04"]
    query = ST.relay_stream(spark, src, topics, SC.OUTBOX, lambda: F.lit(today[0]).cast("timestamp_ntz"),
                            name="clock-" + os.path.basename(root))

    def sent():
        return sorted(r.outbox_id for r in spark.read.parquet(topics).collect()) if os.path.exists(topics) else []

    def step():
        if sent() == [2]:
            today[0] = "2024-01-06"             # time passes; no file arrives
        return sent() == [1, 2]

    ST.run_until(query, step, 90)
    batches = [d for d in os.listdir(topics) if d.startswith("batch=")]
    assert len(batches) == 2 and ST.VersionedTable(topics + "-waiting").latest(spark).count() == 0


def test_daily_job_runs_once_a_day(spark):
    import datetime as dt
    assert ST.last_due(dt.datetime(2024, 1, 5, 1, 59), dt.time(2)) == dt.datetime(2024, 1, 4, 2)
    assert ST.last_due(dt.datetime(2024, 1, 5, 2), dt.time(2)) == dt.datetime(2024, 1, 5, 2)
    now, runs = [dt.datetime(2024, 1, 5, 1)], []
    root = tempfile.mkdtemp(prefix="vitrine-test-daily-")
    polls = [0]

    def job(session, due, run):
        runs.append(due.isoformat())

    def step():
        polls[0] += 1
        if len(runs) == 1 and polls[0] > 4:
            now[0] = dt.datetime(2024, 1, 7, 3)     # two due times have passed: the last one runs
        return len(runs) == 2 and polls[0] > 8
    query = ST.daily_stream(spark, job, os.path.join(root, "runs"), lambda: now[0], name="daily-" + os.path.basename(root),
                            trigger=ST.RELAY_TRIGGER)
    ST.run_until(query, step, 90)
    assert runs == ["2024-01-04T02:00:00", "2024-01-07T02:00:00"]


def _part_files(table, spark):
    """part -> its current files and their times."""
    found = {}
    for p, versions in table.versions(spark).items():
        folder = f"{table.path}/v={versions[-1]:012d}/part={p}"
        found[p] = sorted((folder, f, os.stat(os.path.join(folder, f)).st_mtime_ns) for f in os.listdir(folder))
    return found


def test_keyed_table_rewrites_touched_parts_only(spark):
    root = tempfile.mkdtemp(prefix="vitrine-test-keyed-")
    table = ST.KeyedTable(os.path.join(root, "t"), "product_id", parts=8)
    rows = lambda ids, x: spark.createDataFrame([(i, x) for i in ids], "product_id long, x long")
    table.write(rows(range(200), 0), 0, range(8))
    before = _part_files(table, spark)
    touched = table.touched(rows([3, 4], 1))
    assert 1 <= len(touched) <= 2
    new = table.read(spark, touched, before=1).where("product_id not in (3, 4)").unionByName(rows([3, 4], 1))
    for _ in range(2):                              # a re-run writes the same
        table.write(new, 1, touched)
    after = _part_files(table, spark)
    assert all(after[p] == before[p] for p in range(8) if p not in touched) and all(after[p] != before[p] for p in touched)
    assert {(r.product_id, r.x) for r in table.latest(spark).collect()} == {(i, int(i in (3, 4))) for i in range(200)}
    assert table.read(spark, before=1).where("x = 1").count() == 0
    table.write(new.limit(0), 2, touched)           # nothing is left of these parts
    assert table.read(spark, touched) is None and table.latest(spark).count() < 200
    table.write(rows([3], 5), 3, touched)
    assert max(len(v) for v in table.versions(spark).values()) == 2


def test_stream_fold_keeps_untouched_parts_and_lists_dropped_metrics(spark):
    import datetime as dt

    from vitrine.sources import schemas as SC

    def message(i, kind, product, payload="{}"):
        return (f"m{i}", "product-events", kind, payload, {"aggregate-id": product, "idempotency-key": f"k{i}"},
                dt.datetime(2024, 1, 1), product, i)

    created = lambda i, p: message(i, "ProductCreated", p, f'{{"productId":{p},"name":"n{p}","price":1.5,"sku":"S{p}"}}')
    root = tempfile.mkdtemp(prefix="vitrine-test-parts-")
    src, docs = os.path.join(root, "topic"), os.path.join(root, "docs")
    slices = [[created(i, str(i)) for i in range(1, 40)],
              [message(50, "ProductViewed", "7"), message(51, "ProductViewed", "99"), message(52, "ProductViewed", "x")],
              [message(60, "ProductDeleted", "7", '{"productId":7}'), message(61, "ProductPurchased", "7"), message(50, "ProductViewed", "8")]]
    table, seen = ST.documents_table(docs), []
    for rows in slices:
        spark.createDataFrame(rows, SC.MESSAGE).coalesce(1).write.mode("append").parquet(src)
        ST.fold_stream(spark, src, SC.MESSAGE, docs, group="parts-" + os.path.basename(root)).awaitTermination()
        seen.append(_part_files(table, spark))
    own = {r[0] for r in spark.createDataFrame([(7,), (99,)], "product_id long").select(table.part()).collect()}
    assert all((seen[1][p] == seen[0][p]) == (p not in own) for p in seen[0])
    dropped = sorted((r.product_id, r.offset) for r in spark.read.parquet(f"{docs}-dropped").collect() if r.product_id)
    assert dropped == [(7, 61), (99, 51)]
    assert [r.offset for r in spark.read.parquet(f"{docs}-dropped").where("product_id is null").collect()] == [52]
    out = {r.product_id: r.click_count for r in table.latest(spark).collect()}
    assert set(out) == set(range(1, 40)) - {7} and out[8] == 0      # key k50 came again


def test_seen_keys_read_a_bounded_part_of_the_log(spark):
    """50 batches: what a batch reads does not grow once the horizon is reached."""
    root = tempfile.mkdtemp(prefix="vitrine-test-seen-")
    keys = ST.SeenKeys(os.path.join(root, "keys"), buckets=2, epoch=40, horizon=80)
    read = []

    def messages(rows):
        return spark.createDataFrame([(f"m{o}", {"idempotency-key": k}, o) for k, o in rows], "id string, headers map<string,string>, offset long")

    for b in range(50):
        new = [(f"k{20 * b + i}", 20 * b + i) for i in range(18)]
        again = [(f"k{20 * b - 40}", 20 * b + 18), (f"k{20 * b - 35}", 20 * b + 19)] if b > 2 else []
        batch = messages(new + again)
        known = keys.known(batch, b)
        read.append(0 if known is None else sum(os.path.getsize(f.replace("file://", "").replace("file:", "")) for f in known.inputFiles()
                                               if int(f.split("epoch=")[1].split("/")[0]) >= keys._oldest(batch)))
        assert sorted(r.offset for r in keys.fresh(batch, b).collect()) == [o for _, o in new]
        keys.add(batch, b)
    assert max(read[40:]) <= 1.3 * max(read[10:20])
    assert len([d for d in os.listdir(keys.path) if d.startswith("epoch=")]) <= 5
    late = messages([("k10", 1000)])                 # long past the horizon: not known any more
    assert keys.fresh(late, 50).count() == 1
    whole = ST.SeenKeys(os.path.join(root, "all"))
    whole.add(messages([("a", 1)]), 0)
    assert whole.fresh(messages([("a", 10**9), ("b", 10**9 + 1)]), 1).count() == 1


def test_daily_view_stream_equals_batch(spark):
    import datetime as dt
    rows = [(i, i % 3, dt.datetime(2024, 1, 1 + i // 10, i % 24)) for i in range(50)]
    v = spark.createDataFrame(rows, "event_id long, product_id long, ts timestamp_ntz")
    root = tempfile.mkdtemp(prefix="vitrine-test-views-")
    src, out = os.path.join(root, "views"), os.path.join(root, "daily")
    name = "dv-" + os.path.basename(root)
    for lo, hi in ((25, 50), (0, 25)):            # the later days first
        v.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).write.mode("append").parquet(src)
        ST.daily_view_stream(spark, src, v.schema, out, trigger=ST.AVAILABLE_NOW, name=name).awaitTermination()
    got = {(r.product_id, r.day, r.views) for r in ST.KeyedTable(out, "product_id").latest(spark).collect()}
    want = {(r.product_id, r.day, r.views) for r in FO.daily_views(v).collect()}
    assert got == want


_ = B


def test_listeners_batch_and_message_handlers(spark):
    import datetime as dt

    from vitrine.sources import schemas as SC
    rows = [(f"m{i}", ["product-events", "order-events"][i % 2], "ProductViewed", "{}", {},
             dt.datetime(2024, 1, 1, 0, i), str(i), i + 1) for i in range(10)]
    M = spark.createDataFrame(rows, SC.MESSAGE)
    root = tempfile.mkdtemp(prefix="vitrine-test-listeners-")
    topics = os.path.join(root, "topics")
    M.write.partitionBy("topic").parquet(topics)
    seen = {}

    def batch_handler(df, batch_id):
        seen["batch"] = sorted(r.id for r in df.collect())

    def per_message(pdf):
        return pdf[["id"]].assign(length=pdf["id"].str.len())

    def sink(df, batch_id):
        seen["message"] = sorted((r.id, r.length) for r in df.collect())

    listeners = [
        ST.Listener("search-" + os.path.basename(root), ["product-events"], batch_handler=batch_handler),
        ST.Listener("notify-" + os.path.basename(root), ["order-events"], message_handler=per_message,
                    output_schema="id string, length long"),
    ]
    for q in ST.start_listeners(spark, topics, SC.MESSAGE, listeners, sink=sink):
        q.awaitTermination()
    assert seen["batch"] == [f"m{i}" for i in (0, 2, 4, 6, 8)]
    assert seen["message"] == [(f"m{i}", 2) for i in (1, 3, 5, 7, 9)]
