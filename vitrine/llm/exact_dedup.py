"""Exact duplicate removal by two passes with a Bloom filter.

Pass 1 sets a few bits per row, all within one 4 KiB block of the filter, and
keeps the bits that two or more rows set. Pass 2 tests each row: a row with a
bit that no other row set is unique and passes straight through; only the rest,
the possibly repeated rows, are shuffled and compared by SHA-256 of the text. A
false positive costs a shuffle of that row and nothing else.

Defined cases: a null text counts as empty; all empty texts are one group. A
null id loses against any other id; a group of null ids only has a null keeper.
Rows that repeat id and text are one group and exactly one of them is kept.
Extra columns, whatever their names, are ignored by ``mark_repeats`` and
returned as they are by ``drop_repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import all_of, cut, lookup, row_hash

BLOCK_BITS = 1 << 15            # one value of bitmap_construct_agg: 4 KiB
BITS_PER_ROW = 16
MAX_BLOCKS = 1 << 14            # 64 MiB: the bound of what is broadcast
HASHES = 3


def _blocks(n_rows: int) -> int:
    """Blocks of the filter: BITS_PER_ROW a row, within MAX_BLOCKS. A fuller
    filter lets more unique rows shuffle; results are the same."""
    wanted = n_rows * BITS_PER_ROW // BLOCK_BITS + 1
    return min(MAX_BLOCKS, wanted)


def _keys(n_blocks: int, text: Column) -> list[Column]:
    """The row's block and its positions there."""
    h = F.xxhash64(text)
    g = F.xxhash64(h, F.lit("positions"))
    spots = [F.shiftright(g, 15 * k).bitwiseAND(BLOCK_BITS - 1) for k in range(HASHES)]
    return [F.pmod(h, F.lit(n_blocks)).alias("block"), F.array(*spots).alias("spots")]


def repeated_bits(keys: DataFrame) -> DataFrame:
    """Pass 1: (block, bits) of the positions that at least two rows set."""
    hits = (keys.select("block", F.explode(F.array_distinct("spots")).alias("spot"))
            .groupBy("block", "spot").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
    return hits.groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits"))


def _is_set(bits: Column, spot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(spot, 3).cast("int") + 1, F.lit(1))), 16, 10)
    masks = F.array(*[F.lit(1 << k).cast("long") for k in range(8)])
    return byte.cast("long").bitwiseAND(masks[spot.bitwiseAND(7).cast("int")]) != 0


def _flagged(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pass 2: ``rows`` plus ``maybe``, true for a possibly repeated row."""
    spot = F.col("spots")
    seen = all_of([_is_set(F.col("bits"), spot[k]) for k in range(HASHES)])
    return (rows.join(F.broadcast(bits), "block", "left")
            .withColumn("maybe", F.coalesce(seen, F.lit(False))).drop("bits", "block", "spots"))


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
                       *_keys(_blocks(n), text))
    rows = cut(rows)
    rows = cut(_flagged(rows, repeated_bits(rows)))
    single = rows.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # equal rows are counted before the group's hot key is met
    counted = cut(rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
    groups = counted.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"),
                                                F.sum("copies").alias("group_size"))
    found = lookup(counted, "text_sha256", groups, "inner")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return single.unionByName(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id has too.

    Unique rows never shuffle. Of the others a partial aggregate keeps one row
    per group already on the map side, so a group of any size sends one row per
    task."""
    columns = docs.columns
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                         F.col(id_col).alias("id"), text.alias("t"), row_hash(docs).alias("tie"))
    keys = docs.select(*_keys(_blocks(n), text))
    bits = cut(repeated_bits(keys))
    rows = packed.select("row", "id", "tie", F.sha2("t", 256).alias("sha"), *_keys(_blocks(n), F.col("t")))
    rows = _flagged(rows, bits)
    order = F.struct(F.col("id").isNotNull(), F.col("id"), F.col("tie"))
    best = rows.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return rows.where(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))
