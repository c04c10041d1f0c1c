"""Request validation and the create / update / delete batches."""

from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.operators import dml as DM
from vitrine.operators import quality as Q
from vitrine.sources import schemas as SC

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def _req(spark, rows):
    base = dict(request_id=0, name="Integration Test Product", description="d",
                categories=["Electronics", "Test"], price=Decimal("199.99"), sku="INT-TEST-001",
                attributes={"color": "blue"}, images=["https://x/1.jpg"])
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in SC.CREATE_REQUEST.fields)
                                  for r in rows], SC.CREATE_REQUEST)


def _catalogue(spark):
    rows = [(1, "Test Product", None, ["Electronics"], Decimal("99.99"), "TEST-001", {}, [],
             None, None, 0, 10, 5, 6.5)]
    return spark.createDataFrame(rows, SC.PRODUCT)


def test_all_bad_request_has_four_field_errors(spark):
    r = _req(spark, [dict(name="", categories=[], price=Decimal("-10.00"), sku="")])
    errs = Q.validate_create(r).first().errors
    assert set(errs) == {"name", "categories", "price", "sku"}
    assert errs["price"] == "Product price must be greater than 0"


def test_digits_and_patterns(spark):
    r = _req(spark, [dict(request_id=1, price=Decimal("1.005")), dict(request_id=2, sku="abc"),
                     dict(request_id=3, images=["ftp://x"]), dict(request_id=4, attributes={"k": " "}),
                     dict(request_id=5, price=Decimal("123456789.00")), dict(request_id=6)])
    errs = {x.request_id: set(x.errors) for x in Q.validate_create(r).collect()}
    assert errs == {1: {"price"}, 2: {"sku"}, 3: {"images"}, 4: {"attributes"}, 5: {"price"}, 6: set()}


def test_create_rejects_duplicates_and_emits_events(spark):
    P = _catalogue(spark)
    r = _req(spark, [dict(request_id=1), dict(request_id=2), dict(request_id=3, sku="test-001 ".upper().strip()),
                     dict(request_id=4, price=Decimal("-10.00"), sku="")])
    newP, events, rejects = DM.create_products(P, r, as_of())
    assert newP.count() == 2
    assert events.count() == 1 and events.first().event_type == "ProductCreated"
    codes = sorted((x.request_id, x.code) for x in rejects.collect())
    assert codes == [(2, "PRODUCT_ALREADY_EXISTS"), (3, "PRODUCT_ALREADY_EXISTS"), (4, "VALIDATION_ERROR")]


def test_partial_update_and_unknown_id(spark):
    P = _catalogue(spark)
    upd = spark.createDataFrame(
        [(1, 1, "Renamed", None, None, Decimal("149.99"), None, None, None),
         (2, 99, "x", None, None, None, None, None, None)], SC.UPDATE_REQUEST)
    newP, events, rejects = DM.update_products(P, upd, as_of())
    row = newP.filter("id = 1").first()
    assert row.name == "Renamed" and row.price == Decimal("149.99") and row.sku == "TEST-001"
    assert row.version == 1
    ev = events.first()
    assert ev.event_type == "ProductUpdated" and '"changedFields":["name","price"]' in ev.event_data
    assert [(x.request_id, x.code) for x in rejects.collect()] == [(2, "PRODUCT_NOT_FOUND")]


def test_several_updates_of_a_product_apply_in_order(spark):
    P = _catalogue(spark)
    P = P.unionByName(P.withColumn("id", F.lit(2).cast("long")).withColumn("sku", F.lit("TEST-002")))
    upd = spark.createDataFrame(
        [(1, 1, "Renamed", None, None, None, None, None, None),
         (2, 1, None, None, None, Decimal("5.00"), "NEW-1", None, None),
         (3, 2, "Lost", None, None, None, "NEW-1", None, None),          # asked for earlier in the batch
         (4, 2, None, None, None, Decimal("-1"), None, None, None),      # breaks a rule
         (5, 1, "Again", None, None, None, "TEST-001", None, None)], SC.UPDATE_REQUEST)
    newP, events, rejects = DM.update_products(P, upd, as_of())
    rows = {r.id: r for r in newP.collect()}
    assert (rows[1].name, rows[1].price, rows[1].sku, rows[1].version) == ("Again", Decimal("5.00"), "TEST-001", 3)
    assert (rows[2].name, rows[2].sku, rows[2].version) == ("Test Product", "TEST-002", 0)
    after = [r[0] for r in events.orderBy("id").select(F.get_json_object("event_data", "$.name")).collect()]
    assert after == ["Renamed", "Renamed", "Again"]
    assert sorted((x.request_id, x.code) for x in rejects.collect()) == [
        (3, "PRODUCT_ALREADY_EXISTS"), (4, "VALIDATION_ERROR")]


def test_delete_unknown_is_rejected_without_event(spark):
    P = _catalogue(spark)
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    newP, events, missing = DM.delete_products(P, ids, as_of())
    assert newP.count() == 0 and events.count() == 1
    assert [x.detail for x in missing.collect()] == ["2"]
