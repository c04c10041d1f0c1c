import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vitrine.llm import sharding
from vitrine.llm.queries import QUERIES
from vitrine.llm.shared import cut

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards=16, slack=0.026):
    """Every law against plain Python: sizes, checksums, slots, balance, groups."""
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(0 <= s < shards for s in by)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    if not rows:
        return
    mean, largest = sum(w[1] for w in want) / shards, max(w[1] for w in want)
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(abs(x - mean) for x in sizes) <= max(largest, 2 * slack * mean)


def test_laws_on_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "x"), (3, "x"), (3, "x"), (None, None), (4, "é" * 5000)]
    docs += [(10 + i, f"text number {i} " * (i % 7 + 1)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("a")).withColumn("key", F.lit(1))
    check(sharding.assign(df.repartition(5)).collect(), docs)
    for n in (1, 2, 5):
        check(sharding.assign(df, shards=n).collect(), docs, n)
    assert sharding.assign(df.limit(0)).count() == 0


def test_hot_group_is_cut_and_small_groups_stay_whole(spark):
    docs = [(i, "the same text over and over") for i in range(3000)] + [(5000, "one row, many times")] * 3000
    docs += [(10_000 + i, f"pair {i // 2} of texts") for i in range(3000)]
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    check(rows, docs)
    text = dict(docs)
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(where["the same text over and over"]) >= 5 and len(where["one row, many times"]) >= 4
    assert all(len(s) == 1 for t, s in where.items() if t.startswith("pair"))


def test_rounds_refine_only_open_cells(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(2000)] + [(i, f"t{i}") for i in range(2000)], "doc_id long, text string")
    rows = cut(docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", sharding._key(F.col("text"), F.col("doc_id")))
            .select("key", F.lit(10).alias("size")))
    cells, bounds, opened = sharding.splitters(rows, 4, 0.001, 0.025)
    assert sum(c.rows for c in cells) == 4000 and bounds == sorted(bounds)
    assert [o[0] for o in opened] == sorted((o[0] for o in opened), reverse=True) and opened[-1][1] < sharding.GROUP_SHIFT
    below = [sum(c.size for c in cells[:b]) for b in bounds]
    assert all(abs(x - 10_000 * i) <= 40 for i, x in enumerate(below, 1))


def test_query_is_native_and_whole(spark):
    df = QUERIES["op11_sharding"](spark, SF)
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(df.select("doc_id", "size", "text_crc32", "shard", "slot").collect(), docs)
    assert {(r["law"], r["grown_shard"]) for r in df.collect()} == {("bytes", None)}
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_written_files_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard", "slot"])
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("slot", F.lit(1)), str(tmp_path / "other"))
