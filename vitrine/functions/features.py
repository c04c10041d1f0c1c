"""Derived product features as Column expressions (all JVM-side, codegen'd).

F5/F6 search text, F7/F8 price bands, F9/F10 tags, F11 score boost,
F12/F13 popularity, F20 whole days, F25 two decimals, F26 keyword cap,
F27 null-coalescing counter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price-band edges and labels (document form, upper bound
# inclusive; event form, upper bound exclusive).
DOCUMENT_BANDS = [(25, "0-25"), (50, "25-50"), (100, "50-100"), (250, "100-250"),
                  (500, "250-500")]
DOCUMENT_TOP_BAND = "500+"
EVENT_BANDS = [(50, "0-50"), (100, "50-100"), (200, "100-200"), (500, "200-500"),
               (1000, "500-1000")]
EVENT_TOP_BAND = "1000+"
BUDGET_BELOW, PREMIUM_ABOVE = 100, 500
POPULAR_ABOVE, BESTSELLER_ABOVE = 50, 100
KEYWORD_IGNORE_ABOVE = 256
MAX_BOOST = 2.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sorted_values(attrs: Column) -> Column:
    # map iteration order is unspecified in the reference; sort by key (H9)
    return F.transform(F.array_sort(F.map_keys(attrs)), lambda k: attrs[k])


def all_text(name, description, sku, categories, attributes, form: str = "document") -> Column:
    """F5 (document: attribute values) / F6 (event: attribute key and value).
    Pieces joined by single spaces, then trimmed; null pieces are skipped."""
    attrs = _c(attributes)
    if form == "document":
        attr_text = F.array_join(_sorted_values(attrs), " ")
    else:
        attr_text = F.array_join(F.transform(
            F.array_sort(F.map_keys(attrs)), lambda k: F.concat_ws(" ", k, attrs[k])), " ")
    cats = F.array_join(_c(categories), " ")
    return F.trim(F.concat_ws(" ", _c(name), _c(description), _c(sku), cats, attr_text))


def price_range(price, form: str = "document") -> Column:
    """F7 (document) / F8 (event) price band; null price -> 'unknown'."""
    p = _c(price)
    if form == "document":
        e = F.when(p.isNull(), "unknown")
        for edge, label in DOCUMENT_BANDS:
            e = e.when(p <= edge, label)
        return e.otherwise(DOCUMENT_TOP_BAND)
    e = F.when(p.isNull(), "unknown")
    for edge, label in EVENT_BANDS:
        e = e.when(p < edge, label)
    return e.otherwise(EVENT_TOP_BAND)


def is_available(price) -> Column:
    """P23."""
    return F.coalesce(_c(price) > 0, F.lit(False))


def tags(categories, price, popularity, purchases, form: str = "document",
         attributes=None) -> Column:
    """F9 document tags: categories + budget/premium/mid-range + popular +
    bestseller (only when popularity is known) + available.
    F10 ``created``: distinct(categories + brand + event band);
    ``updated``: categories + brand + budget/premium (no mid-range), not distinct."""
    cats = F.coalesce(_c(categories), F.array().cast("array<string>"))
    p = _c(price)
    if form == "document":
        pop = _c(popularity)
        extra = F.array(
            F.when(p < BUDGET_BELOW, "budget").when(p > PREMIUM_ABOVE, "premium")
             .when(p.isNotNull(), "mid-range"),
            F.when(pop.isNotNull() & (pop > POPULAR_ABOVE), "popular"),
            F.when(pop.isNotNull() & (_c(purchases) > BESTSELLER_ABOVE), "bestseller"),
            F.when(is_available(p), "available"))
        return F.concat(cats, F.filter(extra, lambda x: x.isNotNull()))
    brand = _c(attributes)["brand"]
    if form == "created":
        extra = F.array(brand, F.when(p.isNotNull(), price_range(p, "event")))
        return F.array_distinct(F.concat(cats, F.filter(extra, lambda x: x.isNotNull())))
    extra = F.array(brand, F.when(p < BUDGET_BELOW, "budget").when(p > PREMIUM_ABOVE, "premium"))
    return F.concat(cats, F.filter(extra, lambda x: x.isNotNull()))


def whole_days(start, end) -> Column:
    """whole days between two timestamps (truncated, may be negative)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def score_boost(popularity, created_at, images, as_of: Column) -> Column:
    """min(2.0, 1 + score/100*0.5 + 0.2 if younger than 30 days + 0.1 if
    it has images)."""
    pop = _c(popularity)
    b = F.lit(1.0) + F.coalesce(pop / 100.0 * 0.5, F.lit(0.0))
    b = b + F.when(_c(created_at).isNotNull() & (whole_days(created_at, as_of) < 30), 0.2).otherwise(0.0)
    b = b + F.when(F.coalesce(F.size(_c(images)) > 0, F.lit(False)), 0.1).otherwise(0.0)
    return F.least(b, F.lit(MAX_BOOST))


def popularity(clicks, purchases, model: str = "entity") -> Column:
    """F12 entity: 0.3 clicks + 0.7 purchases; F13 sync: 1.0 clicks + 10.0 purchases."""
    c, p = _c(clicks), _c(purchases)
    if model == "entity":
        return c * 0.3 + p * 0.7
    return F.coalesce(c, F.lit(0)) * 1.0 + F.coalesce(p, F.lit(0)) * 10.0


def scaled2(x) -> Column:
    """the index keeps scaled floats with two decimals."""
    return F.round(_c(x), 2)


def keyword(x) -> Column:
    """keyword sub-field: values over 256 characters are not indexed."""
    return F.when(F.length(_c(x)) <= KEYWORD_IGNORE_ABOVE, _c(x))


def add_counter(x, n) -> Column:
    """(x ?: 0) + n."""
    return F.coalesce(_c(x), F.lit(0)) + _c(n)


def normalise_sku(sku) -> Column:
    """upper then trim."""
    return F.trim(F.upper(_c(sku)))


def is_blank(x) -> Column:
    """null or only whitespace."""
    return F.coalesce(F.length(F.trim(_c(x))) == 0, F.lit(True))
