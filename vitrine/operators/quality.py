"""Validation of create / update request batches (V1-V6).

Every rule is a boolean Column; a row's field errors are a map field ->
message (first failing rule per field), so valid and quarantined rows are two
filters of one frame and nothing is raised per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.joins import salted

# Limits, patterns (F23) and messages of the request contract.
NAME_MAX, DESCRIPTION_MAX, SKU_MAX = 255, 5000, 100
PRICE_MIN = "0.01"
PRICE_INTEGER_DIGITS, PRICE_FRACTION_DIGITS = 8, 2
SKU_PATTERN = r"^[A-Z0-9-_]+$"
IMAGE_PATTERN = r"^https?://.*"
MESSAGES = {
    "name_required": "Product name is required",
    "name_size": "Product name must not exceed 255 characters",
    "description_size": "Product description must not exceed 5000 characters",
    "categories_required": "At least one category is required",
    "category_blank": "Category name cannot be blank",
    "price_required": "Product price is required",
    "price_min": "Product price must be greater than 0",
    "price_digits": "Price must have at most 8 integer digits and 2 decimal places",
    "sku_required": "Product SKU is required",
    "sku_size": "SKU must not exceed 100 characters",
    "sku_pattern": "SKU must contain only uppercase letters, numbers, hyphens, and underscores",
    "attribute_blank": "must not be blank",
    "image_pattern": "Image URL must be a valid HTTP/HTTPS URL",
}
# error codes of the API's error envelope
VALIDATION_ERROR = "VALIDATION_ERROR"
PRODUCT_ALREADY_EXISTS = "PRODUCT_ALREADY_EXISTS"
PRODUCT_NOT_FOUND = "PRODUCT_NOT_FOUND"
PAGE_SIZE_MAX = 100


def blank(c: Column) -> Column:
    """null, empty or only whitespace."""
    return c.isNull() | c.rlike(r"^\s*$")


def _first(*pairs: tuple[Column, str]) -> Column:
    e = None
    for cond, key in pairs:
        e = F.when(cond, F.lit(MESSAGES[key])) if e is None else e.when(cond, F.lit(MESSAGES[key]))
    return e


def _price_rules(p: Column) -> list[tuple[Column, str]]:
    digits_ok = (p == F.round(p, PRICE_FRACTION_DIGITS)) & (F.abs(p) < 10 ** PRICE_INTEGER_DIGITS)
    return [(p < F.lit(PRICE_MIN).cast("decimal(18,4)"), "price_min"), (~digits_ok, "price_digits")]


def field_errors(req: DataFrame, mode: str = "create") -> Column:
    """V1 (create) / V2 (update: every field optional, same limits) -> map of
    field -> message; empty map when valid."""
    name, desc, sku, price = F.col("name"), F.col("description"), F.col("sku"), F.col("price")
    cats, attrs, imgs = F.col("categories"), F.col("attributes"), F.col("images")
    create = mode == "create"
    name_r = ([(blank(name), "name_required")] if create else []) + \
        [(F.length(name) > NAME_MAX, "name_size")]
    cat_r = ([(cats.isNull() | (F.size(cats) == 0), "categories_required")] if create else []) + \
        [(F.exists(cats, lambda x: blank(x)), "category_blank")]
    price_r = ([(price.isNull(), "price_required")] if create else []) + _price_rules(price)
    sku_r = ([(blank(sku), "sku_required")] if create else []) + \
        [(F.length(sku) > SKU_MAX, "sku_size"), (~sku.rlike(SKU_PATTERN), "sku_pattern")]
    attr_r = [(F.exists(F.map_entries(attrs), lambda e: blank(e["key"]) | blank(e["value"])),
               "attribute_blank")]
    img_r = [(F.exists(imgs, lambda x: ~F.coalesce(x.rlike(IMAGE_PATTERN), F.lit(False))),
              "image_pattern")]
    m = F.create_map(
        F.lit("name"), _first(*name_r), F.lit("description"), _first((F.length(desc) > DESCRIPTION_MAX,
                                                                       "description_size")),
        F.lit("categories"), _first(*cat_r), F.lit("price"), _first(*price_r),
        F.lit("sku"), _first(*sku_r), F.lit("attributes"), _first(*attr_r),
        F.lit("images"), _first(*img_r))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def validate_create(req: DataFrame) -> DataFrame:
    """V1: adds ``errors`` (map field -> message)."""
    return req.withColumn("errors", field_errors(req, "create"))


def validate_update(req: DataFrame) -> DataFrame:
    """V2."""
    return req.withColumn("errors", field_errors(req, "update"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V3: (valid rows, quarantined rows with code VALIDATION_ERROR)."""
    bad = F.size("errors") > 0
    return (checked.filter(~bad).drop("errors"),
            checked.filter(bad).withColumn("code", F.lit(VALIDATION_ERROR)))


def validate_queries(queries: DataFrame) -> DataFrame:
    """V4: paging limits of search requests: page >= 0, 1 <= size <= 100."""
    ok = (F.col("page") >= 0) & (F.col("size") >= 1) & (F.col("size") <= PAGE_SIZE_MAX)
    return queries.withColumn("valid", F.coalesce(ok, F.lit(False)))


def duplicate_skus(req: DataFrame, P: DataFrame, sku_col: str = "sku_norm") -> DataFrame:
    """V5: requests whose normalised SKU exists in the table, or repeats an
    earlier request (lower request_id) of the same batch. Adds ``code``.
    The earliest request of a SKU is found with a min aggregate, not a window,
    and the requests meet it dealt over parts, so a SKU may be repeated in a third of the batch."""
    first = req.groupBy(sku_col).agg(F.min("request_id").alias("_first"))
    existing = P.select(F.col("sku").alias(sku_col)).distinct().withColumn("_exists", F.lit(True))
    j = salted(req, first.join(existing, sku_col, "left"), sku_col, "request_id").where(F.col("_first").isNotNull())
    dup = F.coalesce(F.col("_exists"), F.lit(False)) | (F.col("request_id") != F.col("_first"))
    return (j.filter(dup).drop("_first", "_exists")
            .withColumn("code", F.lit(PRODUCT_ALREADY_EXISTS)))


def rejection_summary(bad: DataFrame) -> DataFrame:
    """V6: rejected requests by error code."""
    return bad.groupBy("code").agg(F.count(F.lit(1)).alias("rejected"))
