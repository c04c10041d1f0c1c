"""Sharding by histogram sort: shards of nearly equal bytes.

Every row gets a 64-bit key: 40 bits of the hash of its text, then 24 bits of
the hash of its id and row number, so equal texts lie side by side and a group
of any size can still be cut. The splitters between shards are found without
moving a row: a histogram counts the exact bytes and rows below candidate keys
over all partitions; cells that hold a splitter which is not met yet are probed
at 256 finer candidates in the next round. Then every row is exchanged once, by
the cell it lies in, and numbered there.

A splitter is met at a candidate within ``tolerance`` of a shard's mean size. A
group of equal texts is cut only where its two ends are both further than
``group_slack`` from the wanted place; the default keeps shards within 5 % of
the mean, or the largest row. What the driver holds is a histogram of at most
2^12 cells plus 2^8 for each opened cell, of which there are at most
shards + OPEN_CELLS a round, whatever the input.

Defined cases: a null text has no bytes and equals the empty text; size is at
least 1. Null ids and repeated rows are ordinary rows, each with its own slot.
Extra columns of any name are ignored by ``assign`` unless carried. An empty
table gives an empty result. Where one row is larger than a shard, some shards
stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.shared import written

#: Low key bits that a histogram cell spans, round by round.
SHIFTS = (52, 44, 36, 24, 16, 8, 0)
#: From this shift on a cell lies within one group of equal texts.
GROUP_SHIFT = 24
#: A cell with more rows than 1 / OPEN_CELLS of all is opened too, so that no task numbers a hot cell alone.
OPEN_CELLS = 1024
#: Below so many rows a cell is never hot.
CELL_ROWS = 64


@dataclass
class Cell:
    low: int            # the smallest key
    shift: int          # spans 2^shift keys
    size: int
    rows: int


def _key(text: Column, doc: Column) -> Column:
    low = (1 << GROUP_SHIFT) - 1
    return (F.xxhash64(text).bitwiseAND(F.lit(~low))
            .bitwiseOR(F.xxhash64(doc, F.col("uid")).bitwiseAND(F.lit(low))))


def _floor(key: Column, shift: int) -> Column:
    return F.shiftleft(F.shiftright(key, shift), shift)


def _counted(rows: DataFrame, shift: int) -> list[Cell]:
    found = rows.groupBy(_floor(F.col("key"), shift).alias("low")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    return [Cell(r["low"], shift, r["size"], r["rows"]) for r in found.collect()]


def _nearest(cells: list[Cell], starts: list[int], target: int) -> tuple[int, int, int]:
    """(index of the cell that holds the target, distance of its nearer end,
    number of cells before that end)."""
    lo, hi = 0, len(cells) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if starts[mid] <= target else (lo, mid - 1)
    before, after = target - starts[lo], starts[lo] + cells[lo].size - target
    return (lo, before, lo) if before <= after else (lo, after, lo + 1)


def splitters(rows: DataFrame, shards: int, tolerance: float, group_slack: float) -> tuple[list[Cell], list[int], list]:
    """Histogram rounds over (key, size): the final cells in key order, the
    number of cells before each splitter, and (shift, keys of the cells opened
    there) of each round. Sizes are compared exactly, as integers times ``shards``."""
    cells, opened = sorted(_counted(rows, SHIFTS[0]), key=lambda c: c.low), []
    total, n_rows = sum(c.size for c in cells), sum(c.rows for c in cells)
    hot = max(CELL_ROWS, n_rows // OPEN_CELLS)
    fixed: dict[int, int] = {}                      # splitter -> the first key above it
    for shift, finer in zip(SHIFTS, (*SHIFTS[1:], None)):
        starts, at = [], 0
        for c in cells:
            starts.append(at)
            at += c.size
        todo = {c.low for c in cells if c.shift == shift and c.rows > hot}
        for i in range(1, shards):
            if i in fixed or not cells:
                continue
            holder, off, end = _nearest(cells, starts, total * i // shards)
            slack = max(tolerance, group_slack) if shift == GROUP_SHIFT else tolerance
            if cells[holder].shift < shift or finer is None or off * shards <= slack * total:
                fixed[i] = cells[end].low if end < len(cells) else None
            else:
                todo.add(cells[holder].low)
        if finer is None or not todo:
            break
        new = _counted(rows.where(_floor(F.col("key"), shift).isin(sorted(todo))), finer)
        cells = sorted([c for c in cells if c.low not in todo or c.shift != shift] + new, key=lambda c: c.low)
        opened.append((shift, finer, sorted(todo)))
    bounds = [sum(c.low < fixed[i] for c in cells) if fixed.get(i) is not None else len(cells) for i in range(1, shards)]
    return cells, bounds, opened


def _cell_of(key: Column, opened: list) -> Column:
    out = _floor(key, SHIFTS[0])
    for shift, finer, lows in opened:
        out = F.when(_floor(key, shift).isin(lows), _floor(key, finer)).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, group_slack: float = 0.025,
           id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot; with
    ``carry`` also ``row``, the whole input row, through the one exchange."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"),
                       text.alias("text"), *whole)
    # row numbers are drawn once; every later pass reads this table
    rows = written(rows.withColumn("key", _key(F.col("text"), F.col("doc_id"))).drop("text"), "shards")
    cells, bounds, opened = splitters(rows.select("key", "size"), shards, tolerance, group_slack)
    places, at, last = [], 0, -1
    for i, c in enumerate(cells):
        shard = sum(b <= i for b in bounds)
        at = at if shard == last else 0
        places.append((c.low, shard, at))
        at, last = at + c.rows, shard
    table = spark.createDataFrame(places, "cell long, shard int, first long")
    within = F.row_number().over(Window.partitionBy("cell").orderBy("key", "uid"))
    placed = (rows.withColumn("cell", _cell_of(F.col("key"), opened)).withColumn("nth", within)
              .join(F.broadcast(table), "cell"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"),
                         *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes ``docs`` with their columns as they are, one folder a shard
    (``shard=0`` ...), rows in the order of their slots within each file."""
    rows = assign(docs, shards, carry=True, **options)
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: the folders carry these names")
    (rows.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
