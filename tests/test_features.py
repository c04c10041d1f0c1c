"""Product rules (entity tests of the reference: popularity, availability,
defaults) and the derived document features."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.functions import features as FX


def test_entity_popularity(spark):
    df = spark.createDataFrame([(10, 5), (11, 5), (10, 6), (0, 0)], "c long, p long")
    got = [round(r[0], 6) for r in df.select(FX.popularity("c", "p", "entity")).collect()]
    assert got == [6.5, 6.8, 7.2, 0.0]


def test_sync_popularity_treats_null_as_zero(spark):
    df = spark.createDataFrame([(3, None), (None, 2)], "c long, p long")
    assert [r[0] for r in df.select(FX.popularity("c", "p", "sync")).collect()] == [3.0, 20.0]


def test_availability(spark):
    df = spark.createDataFrame([(Decimal("50.00"),), (Decimal("0"),), (None,), (Decimal("-10.00"),)],
                               "price decimal(10,2)")
    assert [r[0] for r in df.select(FX.is_available("price")).collect()] == [True, False, False, False]


def test_price_bands_both_forms(spark):
    prices = [None, "25", "25.01", "50", "99.99", "100", "250", "500", "500.01", "999.99", "1000"]
    df = spark.createDataFrame([(None if p is None else Decimal(p),) for p in prices], "price decimal(10,2)")
    doc = [r[0] for r in df.select(FX.price_range("price")).collect()]
    ev = [r[0] for r in df.select(FX.price_range("price", "event")).collect()]
    assert doc == ["unknown", "0-25", "25-50", "25-50", "50-100", "50-100", "100-250", "250-500",
                   "500+", "500+", "500+"]
    assert ev == ["unknown", "0-50", "0-50", "50-100", "50-100", "100-200", "200-500", "500-1000",
                  "500-1000", "500-1000", "1000+"]


def test_document_tags(spark):
    df = spark.createDataFrame([
        (["Electronics", "Gadgets"], Decimal("99.99"), 60.0, 101),
        (["Home"], Decimal("600.00"), None, 500),
        ([], Decimal("0"), 10.0, 0)],
        "categories array<string>, price decimal(10,2), pop double, buys long")
    got = [r[0] for r in df.select(FX.tags("categories", "price", "pop", "buys")).collect()]
    assert got == [["Electronics", "Gadgets", "budget", "popular", "bestseller", "available"],
                   ["Home", "premium", "available"],
                   ["budget"]]


def test_event_tags(spark):
    df = spark.createDataFrame([(["Audio", "Acme"], Decimal("120.00"), {"brand": "Acme"})],
                               "categories array<string>, price decimal(10,2), attributes map<string,string>")
    created = df.select(FX.tags("categories", "price", None, None, "created", F.col("attributes"))).first()[0]
    updated = df.select(FX.tags("categories", "price", None, None, "updated", F.col("attributes"))).first()[0]
    assert created == ["Audio", "Acme", "100-200"]
    assert updated == ["Audio", "Acme", "Acme"]


def test_score_boost(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([
        (100.0, dt.datetime(2024, 1, 20), ["a.jpg"]),     # 1 + 0.5 + 0.2 + 0.1 = 1.8
        (500.0, dt.datetime(2023, 1, 1), []),            # capped at 2.0
        (None, dt.datetime(2023, 12, 1), None)],         # 1.0
        "pop double, created timestamp_ntz, images array<string>")
    got = [round(r[0], 6) for r in df.select(FX.score_boost("pop", "created", "images", as_of)).collect()]
    assert got == [1.8, 2.0, 1.0]


def test_all_text_forms(spark):
    df = spark.createDataFrame([("Phone", None, "SKU-1", ["A", "B"], {"size": "m", "color": "blue"})],
                               "name string, d string, sku string, c array<string>, a map<string,string>")
    doc = df.select(FX.all_text("name", "d", "sku", "c", "a")).first()[0]
    ev = df.select(FX.all_text("name", "d", "sku", "c", "a", form="event")).first()[0]
    assert doc == "Phone SKU-1 A B blue m"
    assert ev == "Phone SKU-1 A B color blue size m"
