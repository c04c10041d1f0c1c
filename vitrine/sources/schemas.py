"""Fixed schemas of the catalogue's records, messages and event payloads."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
ARR = T.ArrayType(S)
MAP = T.MapType(S, S)


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRODUCT = _st(("id", L), ("name", S), ("description", S), ("categories", ARR),
              ("price", MONEY), ("sku", S), ("attributes", MAP), ("images", ARR),
              ("created_at", TS), ("updated_at", TS), ("version", L),
              ("click_count", L), ("purchase_count", L), ("popularity_score", D))

# price is wider than the table column so that a third fraction digit or a
# ninth integer digit can be seen (and rejected) by validation.
CREATE_REQUEST = _st(("request_id", L), ("name", S), ("description", S), ("categories", ARR),
                     ("price", T.DecimalType(18, 4)), ("sku", S), ("attributes", MAP),
                     ("images", ARR))
UPDATE_REQUEST = _st(("request_id", L), ("id", L), ("name", S), ("description", S),
                     ("categories", ARR), ("price", T.DecimalType(18, 4)), ("sku", S),
                     ("attributes", MAP), ("images", ARR))

OUTBOX = _st(("id", L), ("aggregate_id", S), ("aggregate_type", S), ("event_type", S),
             ("event_data", S), ("created_at", TS), ("processed", B), ("processed_at", TS),
             ("retry_count", I), ("next_retry_at", TS), ("error_message", S))

MESSAGE = _st(("id", S), ("topic", S), ("event_type", S), ("payload", S),
              ("headers", MAP), ("timestamp", TS), ("partition_key", S), ("offset", L))

SEARCH_REQUEST = _st(("query_id", L), ("q", S), ("categories", ARR), ("min_price", MONEY),
                     ("max_price", MONEY), ("page", I), ("size", I), ("sort_by", S),
                     ("sort_direction", S))

# Event payloads (JSON text). Times are yyyy-MM-dd'T'HH:mm:ss.
PRODUCT_CREATED = _st(("productId", L), ("name", S), ("description", S), ("categories", ARR),
                      ("price", MONEY), ("sku", S), ("attributes", MAP), ("images", ARR),
                      ("createdAt", TS), ("createdBy", S))
PRODUCT_UPDATED = _st(("productId", L), ("name", S), ("description", S), ("categories", ARR),
                      ("price", MONEY), ("sku", S), ("attributes", MAP), ("images", ARR),
                      ("updatedAt", TS), ("updatedBy", S), ("changedFields", ARR),
                      ("previousValues", S))
PRODUCT_DELETED = _st(("productId", L), ("sku", S), ("name", S), ("deletedAt", TS),
                      ("deletedBy", S), ("reason", S))
PRODUCT_VIEWED = _st(("productId", L), ("sku", S), ("userId", S), ("sessionId", S),
                     ("viewedAt", TS), ("referrer", S), ("metadata", MAP))
PRODUCT_PURCHASED = _st(("productId", L), ("sku", S), ("userId", S), ("orderId", S),
                        ("quantity", I), ("unitPrice", MONEY), ("totalPrice", T.DecimalType(18, 2)),
                        ("purchasedAt", TS), ("metadata", MAP))
PRODUCT_INVENTORY_CHANGED = _st(("productId", L), ("sku", S), ("previousQuantity", I),
                                ("newQuantity", I), ("quantityChange", I), ("changeReason", S),
                                ("changedAt", TS), ("changedBy", S))

# One schema that covers every payload field, so a mixed topic parses in one
# pass; fields absent in a type are null.
EVENT_UNION = T.StructType(list({f.name: f for s in (
    PRODUCT_CREATED, PRODUCT_UPDATED, PRODUCT_DELETED, PRODUCT_VIEWED,
    PRODUCT_PURCHASED, PRODUCT_INVENTORY_CHANGED) for f in s.fields}.values()))

JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
