"""Message-level helpers: topic routing, headers, backoff, metadata parsing.

F15 topic route, F16 header map, F17 metadata lookup with default,
F18 outbox backoff, F19 consumer backoff, F24 deterministic message id,
F28 retry count from headers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic per aggregate type (lower-cased), and the fallback topic.
TOPICS = {"product": "product-events", "order": "order-events", "user": "user-events"}
GENERAL_TOPIC = "general-events"
SOURCE_NAME = "vitrine"
MAX_OUTBOX_RETRIES = 5
MAX_CONSUMER_RETRIES = 3
CONSUMER_BACKOFF_MS = 1000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def topic_for(aggregate_type) -> Column:
    """lower(aggregateType) -> product/order/user-events, else general-events."""
    t = F.lower(_c(aggregate_type))
    e = None
    for k, v in TOPICS.items():
        e = F.when(t == k, v) if e is None else e.when(t == k, v)
    return e.otherwise(GENERAL_TOPIC)


def ts_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def outbox_headers(id_, aggregate_id, aggregate_type, event_type, created_at,
                   source: str = SOURCE_NAME) -> Column:
    """F16: idempotency-key outbox-event-<id>, aggregate-id, aggregate-type,
    event-type, source, created-at."""
    return F.create_map(
        F.lit("idempotency-key"), F.concat(F.lit("outbox-event-"), _c(id_).cast("string")),
        F.lit("aggregate-id"), _c(aggregate_id),
        F.lit("aggregate-type"), _c(aggregate_type),
        F.lit("event-type"), _c(event_type),
        F.lit("source"), F.lit(source),
        F.lit("created-at"), ts_text(created_at))


def outbox_backoff(as_of: Column, retry_count) -> Column:
    """the next attempt after a failure that takes the count to n+1 is
    as_of + 2^(n+1) minutes."""
    n = F.coalesce(_c(retry_count), F.lit(0)) + 1
    return as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.call_function("shiftleft", F.lit(1), n))


def consumer_backoff_ms(retry) -> Column:
    """1000 ms x 2^retry."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _c(retry)) * CONSUMER_BACKOFF_MS


def retry_count_header(headers: str = "headers") -> Column:
    """retry-count header as int, default 0."""
    return F.coalesce(F.expr(f"try_cast(try_element_at(`{headers}`, 'retry-count') AS INT)"), F.lit(0))


def message_id(topic, key, offset) -> Column:
    """a replay-safe id: sha2(topic|key|offset) instead of a random uuid."""
    return F.sha2(F.concat_ws("|", _c(topic), _c(key), _c(offset).cast("string")), 256)
