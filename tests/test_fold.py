"""The event fold: the batch formula and the incremental (per slice) merge
must equal a one-event-at-a-time model of the reference's handler."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tests.conftest import SF001
from vitrine.operators import fold as FO
from vitrine.plans import queries_events as QE
from vitrine.plans import views as V
from vitrine.sources import schemas as SC

T0 = dt.datetime(2024, 1, 1)


def _payload(kind, pid, off, meta=None, qty=None):
    ts = (T0 + dt.timedelta(minutes=off)).strftime("%Y-%m-%dT%H:%M:%S")
    if kind in ("ProductCreated", "ProductUpdated"):
        d = {"productId": pid, "name": f"p{pid}-{off}", "description": "d", "categories": ["C"],
             "price": 10.5, "sku": f"S-{pid}", "attributes": {"brand": "B"}, "images": []}
        d["createdAt" if kind == "ProductCreated" else "updatedAt"] = ts
        return json.dumps(d)
    if kind == "ProductDeleted":
        return json.dumps({"productId": pid, "sku": f"S-{pid}", "deletedAt": ts})
    d = {"productId": pid, "metadata": meta or {}}
    if qty is not None:
        d["quantity"] = qty
    return json.dumps(d)


def _msg(off, kind, pid, key=None, meta=None, qty=None, agg=None):
    return dict(id=f"m{off}", topic="product-events", event_type=kind,
                payload=_payload(kind, pid, off, meta, qty),
                headers={"idempotency-key": key or f"k{off}", "aggregate-id": agg or str(pid)},
                timestamp=T0 + dt.timedelta(minutes=off), partition_key=str(pid), offset=off)


def _frame(spark, msgs):
    return spark.createDataFrame([tuple(m[f.name] for f in SC.MESSAGE.fields) for m in msgs], SC.MESSAGE)


def model(msgs):
    docs, seen = {}, set()
    for m in sorted(msgs, key=lambda x: x["offset"]):
        k = m["headers"]["idempotency-key"]
        if k in seen:
            continue
        seen.add(k)
        t, p = m["event_type"], json.loads(m["payload"])
        if t == "ProductCreated":
            docs[p["productId"]] = dict(name=p["name"], clicks=0, buys=0, pop=0.0)
        elif t == "ProductUpdated":
            docs[p["productId"]] = dict(name=p["name"], clicks=None, buys=None, pop=None)
        elif t == "ProductDeleted":
            docs.pop(p["productId"], None)
        else:
            try:
                pid = int(m["headers"]["aggregate-id"])
            except ValueError:
                continue
            d = docs.get(pid)
            if d is None:
                continue
            meta = p.get("metadata") or {}
            if t == "ProductViewed":
                try:
                    inc = int(meta["view_increment"]) if "view_increment" in meta else 1
                except ValueError:
                    inc = 1
                d["clicks"] = int(meta["total_views"]) if "total_views" in meta else (d["clicks"] or 0) + inc
                pop = float(meta["popularity_score"]) if "popularity_score" in meta else None
                d["pop"] = pop if pop is not None else (d["clicks"] or 0) * 1.0 + (d["buys"] or 0) * 10.0
            else:
                inc = int(meta["purchase_increment"]) if "purchase_increment" in meta else (p.get("quantity") or 1)
                d["buys"] = (d["buys"] or 0) + inc
                d["pop"] = (d["clicks"] or 0) * 1.0 + d["buys"] * 10.0
    return {k: (v["name"], v["clicks"], v["buys"], v["pop"]) for k, v in docs.items()}


def _result(df):
    return {r.product_id: (r.name, r.click_count, r.purchase_count, r.popularity_score) for r in df.collect()}


def test_fold_cases(spark):
    msgs = [
        _msg(1, "ProductCreated", 1), _msg(2, "ProductViewed", 1), _msg(3, "ProductViewed", 1),
        _msg(4, "ProductCreated", 2), _msg(5, "ProductUpdated", 2), _msg(6, "ProductViewed", 2),
        _msg(7, "ProductCreated", 3), _msg(8, "ProductDeleted", 3), _msg(9, "ProductViewed", 3),
        _msg(10, "ProductViewed", 4), _msg(11, "ProductCreated", 4),
        _msg(12, "ProductPurchased", 1, qty=3), _msg(13, "ProductPurchased", 1, key="k12", qty=3),
        _msg(14, "ProductViewed", 4, meta={"view_increment": "x"}),
        _msg(15, "ProductViewed", 4, agg="product-4"),
        _msg(16, "ProductViewed", 1, meta={"popularity_score": "42.5"}),
    ]
    doc, dropped = FO.fold_events(_frame(spark, msgs))
    got = _result(doc)
    assert got == model(msgs)
    assert got[1] == ("p1-1", 3, 3, 42.5)          # view, view, purchase x3 (dup ignored), absolute score
    assert got[2] == ("p2-5", 1, None, 1.0)        # counters restart after an update
    assert 3 not in got                            # deleted
    assert got[4] == ("p4-11", 1, 0, 1.0)          # view before create dropped; bad increment -> 1
    # after the last lifecycle event: deleted product, unreadable id
    assert {r.offset for r in dropped.collect()} == {9, 15}


def test_absolute_views_restart_the_clicks(spark):
    msgs = [_msg(1, "ProductCreated", 1), _msg(2, "ProductViewed", 1), _msg(3, "ProductViewed", 1, meta={"total_views": "40"}),
            _msg(4, "ProductViewed", 1), _msg(5, "ProductViewed", 2, meta={"total_views": "9"}),
            _msg(6, "ProductCreated", 2), _msg(7, "ProductViewed", 2)]
    M = _frame(spark, msgs)
    for mode in ("replace", "merge"):
        doc, _ = FO.fold_events(M, mode)
        assert {k: v[1] for k, v in _result(doc).items()} == {1: 41, 2: 1}
    D = spark.createDataFrame([], FO.fold_events(M)[0].schema)
    for lo, hi in ((0, 2), (2, 4), (4, 7)):
        D = FO.merge_batch(D, M.filter((F.col("offset") > lo) & (F.col("offset") <= hi)))
        D = spark.createDataFrame(D.collect(), D.schema)
    assert _result(D) == model(msgs)


def _random_log(seed, n=60, products=4):
    rnd = random.Random(seed)
    msgs = []
    kinds = (["ProductCreated"] * 2 + ["ProductUpdated", "ProductDeleted"] + ["ProductViewed"] * 6
             + ["ProductPurchased"] * 3)
    for off in range(1, n + 1):
        kind = rnd.choice(kinds)
        pid = rnd.randrange(products)
        meta = {}
        if kind == "ProductViewed":
            if rnd.random() < 0.3:
                meta["view_increment"] = rnd.choice(["2", "3", "bad"])
            if rnd.random() < 0.1:
                meta["popularity_score"] = "7.25"
            if rnd.random() < 0.15:
                meta["total_views"] = str(rnd.randrange(100))
        if kind == "ProductPurchased" and rnd.random() < 0.3:
            meta["purchase_increment"] = "4"
        key = f"k{rnd.randrange(1, off)}" if off > 1 and rnd.random() < 0.1 else None
        msgs.append(_msg(off, kind, pid, key=key, meta=meta, qty=rnd.choice([None, 1, 2])))
    return msgs


def test_fold_matches_model_on_random_logs(spark):
    for seed in range(3):
        msgs = _random_log(seed)
        doc, _ = FO.fold_events(_frame(spark, msgs))
        assert _result(doc) == model(msgs), seed


def test_incremental_merge_matches_batch(spark):
    msgs = _random_log(7, n=80)
    M = FO.dedupe(_frame(spark, msgs))
    D = None
    for lo, hi in ((0, 20), (20, 45), (45, 81)):
        D = FO.merge_batch(D, M.filter((F.col("offset") > lo) & (F.col("offset") <= hi)))
        D = spark.createDataFrame(D.collect(), D.schema)   # materialise the version, as the sink does
    assert _result(D) == model(msgs)


def test_malformed_payloads_go_to_the_error_output(spark):
    rows = [("m1", 1, "ProductCreated", '{"productId": 1, "name": "a", "sku": "s"}', {"aggregate-id": "1"}),
            ("m2", 2, "ProductCreated", '{"productId": 2, "name"', {"aggregate-id": "2"}),
            ("m3", 3, "ProductUpdated", '{"name": "no id"}', {"aggregate-id": "3"}),
            ("m4", 4, "ProductViewed", "not json", {"aggregate-id": "1"})]
    M = spark.createDataFrame(rows, "id string, offset long, event_type string, payload string, headers map<string,string>")
    docs, _ = FO.fold_events(M)
    assert [(r.product_id, r.name) for r in docs.collect()] == [(1, "a")]
    assert sorted(r.id for r in FO.corrupt_events(M).collect()) == ["m2", "m3", "m4"]


def test_lifecycle_aggregates_carry_numbers_not_events(spark):
    """an event's payload is joined to its position, never sorted through an aggregate."""
    E = FO.parse_events(_frame(spark, _random_log(1, n=20)))
    for rows in (FO.latest_lifecycle(E), FO.latest_lifecycle(E, "merge"), *FO.fold_parsed(E)):
        assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_topic_offsets_are_assigned_to_narrow_rows(spark):
    """Payloads are made after the offsets, and readers of the relay log take the columns they need."""
    rows = QE.topic_rows(spark, SF001)
    assert "payload" not in rows.columns
    assert set(QE.topic_log(spark, SF001, []).columns) == {"topic", "timestamp", "outbox_id", "offset"}
    whole = V.product_messages(rows, "offset")
    assert whole.columns == [*V.product_events(spark, SF001).columns, "offset"]
    assert whole.count() == V.product_events(spark, SF001).count() > 0
