"""Helpers that several operators share: reliable cuts of the lineage, a join
that survives hot keys, and connected components."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import checkpoint_dir, scratch_path, swept

#: A key is hot above this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
#: Below so many rows a key is never hot.
HOT_ROWS = 1_000
#: A table of up to so many rows of numbers is broadcast to a join: some MB.
FEW_ROWS = 1 << 17
#: Rows of a small table that one task holds.
TASK_ROWS = 1 << 16
#: The most words of 64 bits that a filter broadcasts: 8 MB of bits.
FILTER_WORDS = 1 << 20
#: Words of a filter that one row of its broadcast holds, as a power of two.
BLOCK_BITS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; a lost executor costs
    a re-read, not a re-computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of at most ``rows`` rows, in no more partitions than they need: each partition is a task and two files
    or more, whatever it holds. For cheap steps: a step of long tasks keeps its own, and ``few`` reads its result."""
    return cut(df.coalesce(rows // TASK_ROWS + 1))


def few(df: DataFrame) -> DataFrame:
    """A table read in no more partitions than its rows need."""
    return df.coalesce(df.count() // TASK_ROWS + 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, for what is
    too large for ``cut``, whose files are not compressed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, and what frames out of use have left."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to_path, True)
    swept(spark)


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(rows: DataFrame, key: str, small: DataFrame, how: str = "left",
           counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small`` on ``key``, where ``small`` has a key at
    most once and ``rows`` may hold a third of its rows under one key.

    Keys with over max(HOT_ROWS, HOT_SHARE of the rows) rows are at most
    1 / HOT_SHARE in number; their entries are broadcast and their rows never
    shuffle. All other rows are joined by an ordinary shuffle join. ``rows`` is
    read several times: pass a table or the result of ``cut``, for ``small`` as well.
    ``counts``: (key, __n) if the rows of the keys that matter are counted already.
    If ``small`` has FEW_ROWS rows or fewer, all of numbers, it is broadcast and nothing shuffles.
    """
    if not any("string" in kind or "array" in kind for _, kind in small.dtypes) and small.count() <= FEW_ROWS:
        return rows.join(F.broadcast(small), key, how)
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    limit = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = cut(counts.where((F.col("__n") > limit) & F.col(key).isNotNull()).select(key))
    if not hot.take(1):
        return rows.join(small, key, how)
    entries = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi").join(entries, key, how)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(small, key, how)
    return hot_rows.unionByName(rest)


def filter_blocks(wanted: DataFrame, slot: Column, words: int) -> DataFrame:
    """(__block, __masks): the filter's ``words`` words, of which the bits of the ``slot`` of each row are set, in rows
    of BLOCK_WORDS words. Rows of a word each would take the driver five times their bits in a broadcast."""
    own = wanted.select(F.shiftright(slot, 6).alias("__word"), slot.bitwiseAND(63).cast("int").alias("__bit"))
    own = own.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))
    empty = wanted.sparkSession.range(words).select(F.col("id").alias("__word"), F.lit(0).cast("long").alias("__mask"))
    whole = own.unionByName(empty).groupBy("__word").agg(F.bit_or("__mask").alias("__mask"))
    return (whole.groupBy(F.shiftright("__word", BLOCK_BITS).alias("__block"))
            .agg(F.sort_array(F.collect_list(F.struct("__word", "__mask")))["__mask"].alias("__masks")))


def flag_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` plus ``__maybe``: true where ``key`` (long) is in ``wanted``, and
    on a few other rows: a filter of 16 bits a key, broadcast in blocks of words of 64
    bits. It has FILTER_WORDS words at most; a fuller one flags more rows."""
    words = min(FILTER_WORDS, wanted.count() // 4 + 1)
    slot = F.pmod(F.xxhash64(key), F.lit(words * 64))
    bits = filter_blocks(wanted, slot, words)
    at = F.shiftright(slot, 6).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    tested = rows.withColumns({"__block": F.shiftright(slot, 6 + BLOCK_BITS), "__at": at, "__bit": slot.bitwiseAND(63).cast("int")})
    tested = tested.join(F.broadcast(bits), "__block", "left")
    return tested.select(*rows.columns, F.expr("coalesce(shiftright(get(__masks, __at), __bit) & 1 = 1, false)").alias("__maybe"))


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows that ``flag_in`` flags, so that the rest need not shuffle; join
    with ``wanted`` to be exact."""
    return flag_in(rows, key, wanted).where("__maybe").drop("__maybe")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the
    smallest node reachable. Empty edges give an empty result.

    Contraction rounds: every root hooks to its smallest neighbour, chains are
    shortened by pointer jumping, edges are rewritten to roots, duplicates and
    loops go. The number of roots with edges at least halves in each round, all
    state is in checkpointed tables, and joins go through ``lookup``, so a hub
    does not end up in one task. No table has more than two rows an edge, so few edges
    take few tasks.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges = few(cut(edges.distinct()))
    most = 2 * edges.count()
    if not most:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    held = partial(cut_few, rows=most)
    labels = held(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .withColumn("root", F.col("node")))
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = held(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("root"), F.least("a", "m").alias("up")))
        while True:
            nxt = lookup(hook.select(F.col("root").alias("base"), F.col("up").alias("root")), "root", hook)
            nxt = held(nxt.select(F.col("base").alias("root"),
                                  F.coalesce("up", "root").alias("up"),
                                  (F.coalesce("up", "root") != F.col("root")).alias("moved")))
            hook = nxt.select("root", "up")
            if not nxt.where("moved").take(1):
                break
        labels = held(lookup(labels, "root", hook).select("node", F.coalesce("up", "root").alias("root")))
        half = held(lookup(edges.select(F.col("a").alias("root"), "b"), "root", hook)
                    .select(F.coalesce("up", "root").alias("a"), F.col("b").alias("root")))
        edges = held(lookup(half, "root", hook)
                     .select("a", F.coalesce("up", "root").alias("b"))
                     .where("a <> b")
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .distinct())
    return labels


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def row_hash(df: DataFrame) -> Column:
    """A hash of whole rows that takes maps, too, for an order among rows that agree in all else."""
    cols = [F.col(f"`{name}`") for name in df.columns]
    return F.xxhash64(*[c.cast("string") if "map<" in kind or kind == "variant" else c for c, (_, kind) in zip(cols, df.dtypes)])
