"""Joins in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16                  # parts the rows of a key are dealt over
SIDE_ROWS = 50_000          # a side that grows with requests, not with documents, is broadcast up to so many rows


def salted(rows: DataFrame, small: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined with ``small``, which has a key at most once and narrow rows. The rows of a key are
    dealt over ``salts`` parts by column ``by`` and ``small`` is repeated for each, so
    that an aggregate by the key afterwards starts with partial sums."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def request_side(small: DataFrame) -> DataFrame:
    """``small``, the requests of a join with documents: broadcast if it has up to SIDE_ROWS rows, else both sides
    are shuffled. Spark would go by the size of the documents' files, and an array exploded from
    them has many times that size; it must never be the side that goes through the driver."""
    return F.broadcast(small) if small.limit(SIDE_ROWS + 1).count() <= SIDE_ROWS else small.hint("merge")
