"""Monitoring roll-ups (A14 component health, A15 one-row system metrics).

One-row results from several aggregates are combined through a tagged union
and one aggregate (each column is non-null in exactly one input row), never
through a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import messaging as MX

UP, WARN, DOWN = "UP", "WARN", "DOWN"


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = []
    for p in parts:
        cols += p.columns
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def health(components: DataFrame) -> DataFrame:
    """Overall UP only if every component is UP (WARN counts as not UP)."""
    return components.agg(
        F.when(F.every(F.col("status") == UP), F.lit(UP)).otherwise(F.lit(DOWN)).alias("status"),
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("status") != UP).alias("not_up"))


def sync_component(sync_stats: DataFrame) -> DataFrame:
    """Sync service: UP when source and index counts agree, else WARN."""
    return sync_stats.select(F.lit("syncService").alias("component"),
                             F.when(F.col("in_sync"), UP).otherwise(WARN).alias("status"))


def _component(name: str, df: DataFrame, status) -> DataFrame:
    return df.select(F.lit(name).alias("component"), status.alias("status"))


def database_component(P: DataFrame) -> DataFrame:
    """Database: UP when product ids are unique and no product lacks its SKU or price. Repeats of an id are
    found by its partial counts, not by one distinct list."""
    per_id = P.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sku").isNull() | F.col("price").isNull()).alias("lacking"))
    sums = per_id.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("lacking"), F.lit(0)).alias("lacking"))
    return _component("database", sums, F.when((F.col("repeated") == 0) & (F.col("lacking") == 0), UP).otherwise(DOWN))


def broker_component(M: DataFrame) -> DataFrame:
    """Message broker: UP when every topic's offsets run from 1 without gaps."""
    topics = M.groupBy("topic").agg(((F.count(F.lit(1)) == F.max("offset")) & (F.min("offset") == 1)).alias("dense"))
    return _component("messageBroker", topics.agg(F.every("dense").alias("dense")), F.when(F.coalesce("dense", F.lit(True)), UP).otherwise(DOWN))


def outbox_component(O: DataFrame) -> DataFrame:
    """Outbox service: UP without dead letters, else WARN."""
    dead = O.agg(F.count_if(~F.col("processed") & (F.col("retry_count") >= MX.MAX_OUTBOX_RETRIES)).alias("dead"))
    return _component("outboxService", dead, F.when(F.col("dead") == 0, UP).otherwise(WARN))
