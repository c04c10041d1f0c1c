"""The stored search index (X5): postings in blocks, and what else a query reads.

Tables of an index, each bucketed by its key, so that a join with a batch of
query terms need not shuffle the index:

  blocks    field, term, part, block, top, postings (doc_id, impact, tf, dl[, positions])
  terms     field, term, number, df, cf, parts, top, n_docs, avgdl
  fields    field, n_docs, avgdl
  vectors   doc_id, terms (field, term, impact)
  variants  field, v, d, term        deletion neighbourhoods of the dictionary (X12)
  prefixes  field, prefix, low, high  the numbers of the terms that begin so (X13)
  docs      doc_id and the columns that filters, sorts and answers need

A posting carries its impact, the whole BM25 contribution of the term to the
document (X15), so that a query joins one table and adds. The postings of a
term are sorted by impact and cut into blocks of BLOCK with the largest impact
(``top``) in the row: a query that knows what it needs skips the rest unread. A
term in more than PART_DOCS documents (J9) is dealt over parts by a hash of the
document; only such terms have more than one part, and only for them the query side is
repeated. So no row, group or join key holds more than PART_DOCS postings.

``stored`` keeps an index in the shared folder under a fingerprint of the files
it was made from: a query reads it, the first query after a change builds it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields as members

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.functions import fuzzy as FZ
from vitrine.functions import text as TX
from vitrine.functions.features import keyword, let
from vitrine.operators.broker import assign_offsets
from vitrine.session import checkpoint_dir, scratch_path, ship_package, swept

K1, B = 1.2, 0.75
BLOCK = 256
PART_DOCS = 1 << 14
#: Bucket files of a table hold about so many of its rows, and there are at least as many as cores.
BUCKET_ROWS = 2_000_000
#: Postings that one task groups into the blocks of a bucket file: Spark would count their compressed bytes, which say little of the objects they become.
TASK_POSTINGS = 1 << 20
#: Terms in many documents are broadcast while the index is built, if they are no more than this.
HEAVY_BROADCAST = 100_000
#: Prefixes up to so many letters are in the table; longer ones are looked up by their first letters and compared.
PREFIX_MAX = 20


@dataclass
class Index:
    blocks: DataFrame
    terms: DataFrame
    fields: DataFrame
    vectors: DataFrame
    variants: DataFrame
    prefixes: DataFrame
    docs: DataFrame


KEYS = {"blocks": ["field", "term", "part"], "terms": ["field", "term"], "vectors": ["doc_id"],
        "variants": ["field", "v"], "prefixes": ["field", "prefix"], "docs": ["doc_id"]}
ORDER = {"blocks": ["field", "term", "part", "block"], "variants": ["field", "v"]}


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """BM25 without the idf; a null dl (keyword field) means no length norm."""
    norm = F.coalesce(F.lit(1.0 - B) + F.lit(B) * dl / avgdl, F.lit(1.0))
    return (tf * F.lit(K1 + 1.0)) / (tf + F.lit(K1) * norm)


def _field_tokens(field: str, kind: str) -> Column:
    """array<struct<field, term, pos, dl>> of one field of the current row, and
    one entry without a term that carries the length."""
    c = F.col(field)
    if kind == "text":
        found = TX.analyze_positions(c)
    elif kind == "keyword_array":
        listed = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: keyword(v).isNotNull())
        found = F.transform(listed, lambda v, i: F.struct(i.alias("pos"), v.alias("term")))
    elif kind == "sku":
        t = TX.analyze_sku(c)
        found = F.when(t.isNull(), F.array().cast("array<struct<pos:int,term:string>>")).otherwise(
            F.array(F.struct(F.lit(0).alias("pos"), t.alias("term"))))
    else:
        raise ValueError(kind)
    entry = "array<struct<field:string,term:string,pos:int,dl:int>>"

    def rows(tokens: Column) -> Column:
        length = F.array(F.struct(F.lit(field), F.lit(None).cast("string"), F.lit(None).cast("int"), F.size(tokens)))
        each = F.transform(tokens, lambda t: F.struct(F.lit(field), t["term"], t["pos"], F.size(tokens)))
        return F.when(F.size(tokens) > 0, F.concat(length.cast(entry), each.cast(entry))).otherwise(F.array().cast(entry))

    return let(F.coalesce(found, F.array().cast("array<struct<pos:int,term:string>>")), rows)


def _tokens(D: DataFrame, fields: dict[str, str], key: str, positions: bool) -> DataFrame:
    """(field, term, doc_id, tf, dl[, positions]) of fields of any kind, and a row without a term that carries the length."""
    arrays = [_field_tokens(f, k) for f, k in fields.items()]
    toks = (D.select(F.col(key).alias("doc_id"), F.explode(F.concat(*arrays)).alias("t"))
            .select("doc_id", "t.field", "t.term", "t.pos", "t.dl"))
    each = [F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")]
    if positions:
        each.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    return toks.groupBy("field", "term", "doc_id").agg(*each)


def _word_counts(D: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, term, doc_id, tf, dl) of text fields, as many rows a document as it has terms and one without a term that carries
    the length. Texts are lower-cased and cut into words on the JVM, by the analyzer's own pattern; the
    words of a text are counted where it is, and each word of a task is folded and looked up once."""
    ship_package(D.sparkSession)
    schema = f"field string, term string, doc_id {dict(D.dtypes)[key]}, tf long, dl int"
    words = [F.regexp_replace(F.lower(F.col(f)), TX.NO_TOKEN_PATTERN, " ").alias(f"text_{i}") for i, f in enumerate(fields)]

    def counted(texts: pa.Array, memo: TX.WordTerms) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Rows of the texts, terms, counts and lengths."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        of_word = [memo[w] for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, of_word), np.int64, len(of_word))
        terms = pa.array([t for some in of_word for t in some], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        each = n[codes]                             # a word has the terms of its group, or none
        place = np.repeat((np.cumsum(n) - n)[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        row, term = np.repeat(row, each), terms.indices.to_numpy(zero_copy_only=False)[place].astype(np.int64)
        width = max(1, len(terms.dictionary))
        found, tf = np.unique(row * width + term, return_counts=True)
        length = np.bincount(row, minlength=len(texts))
        full = np.flatnonzero(length)
        row = np.concatenate([found // width, full])
        names = pa.concat_arrays([terms.dictionary.take(pa.array(found % width)), pa.nulls(len(full), pa.string())])
        return row, names, np.concatenate([tf, np.ones(len(full), np.int64)]), length[row]

    def run(batches):
        memo = TX.WordTerms()
        for batch in batches:
            for i, field in enumerate(fields):
                row, terms, tf, dl = counted(batch.column(1 + i), memo)
                yield pa.RecordBatch.from_arrays([pa.array([field]).take(pa.array(np.zeros(len(row), np.int64))), terms, batch.column(0).take(pa.array(row)),
                                                  pa.array(tf), pa.array(dl.astype(np.int32))], ["field", "term", "doc_id", "tf", "dl"])

    return D.select(F.col(key).alias("doc_id"), *words).mapInArrow(run, schema)


def _blocks(dealt: DataFrame, extra: Sequence[str]) -> DataFrame:
    """(field, term, part, block, top, postings) of postings (field, term, part, less, doc_id, tf, dl, df, n_docs, ...), all of a part of a
    term in one partition: sorted by impact, then document, and cut. A task holds its postings in arrays."""
    ship_package(dealt.sparkSession)
    kinds = dict(dealt.dtypes)
    struct = ", ".join([f"doc_id: {kinds['doc_id']}", "impact: double", "tf: int", "dl: int", *[f"{x}: {kinds[x]}" for x in extra]])
    schema = f"field string, term string, part int, block int, top double, postings array<struct<{struct}>>"

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        column = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
        code = lambda name: column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = (code("field") * t.num_rows + code("term"))
        part, less, doc = column("part").to_numpy(zero_copy_only=False), column("less").to_numpy(zero_copy_only=False), column("doc_id")
        place = np.empty(t.num_rows, np.int64)
        place[pc.sort_indices(doc, null_placement="at_start").to_numpy()] = np.arange(t.num_rows)
        order = np.lexsort((place, less, part, group))
        group, part = group[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.append(first, t.num_rows))
        at = np.arange(t.num_rows) - np.repeat(first, size)
        starts = np.flatnonzero(at % BLOCK == 0)
        df, n_docs = pc.fill_null(column("df"), 0).to_numpy()[order], column("n_docs").to_numpy()[order]
        df = np.where(df > 0, df, np.repeat(size, size)).astype(np.float64)
        impact = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * -less[order]
        rows = pa.array(order)
        some = {"doc_id": doc.take(rows), "impact": pa.array(impact), "tf": column("tf").take(rows), "dl": column("dl").take(rows)}
        some |= {x: column(x).take(rows) for x in extra}
        postings = pa.ListArray.from_arrays(pa.array(np.append(starts, t.num_rows).astype(np.int32)), pa.StructArray.from_arrays(list(some.values()), list(some)))
        heads = rows.take(pa.array(starts))
        out = pa.Table.from_arrays([column("field").take(heads), column("term").take(heads), column("part").take(heads),
                                    pa.array((at[starts] // BLOCK).astype(np.int32)), pa.array(impact[starts]), postings],
                                   ["field", "term", "part", "block", "top", "postings"])
        yield from out.to_batches(max_chunksize=1024)

    return dealt.mapInArrow(run, schema)


def _save(df: DataFrame, path: str, name: str, rows: int, dealt: int = 0) -> DataFrame:
    """Write a table of the index, bucketed and sorted by its key. ``dealt``: it is so dealt over so many partitions already."""
    spark = df.sparkSession
    keys = KEYS.get(name)
    if not keys:
        df.coalesce(1).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")
    n = dealt or max(spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS + 1)
    table = _table_name(path, name)
    ((df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*ORDER.get(name, keys)).option("path", f"{path}/{name}")
     .option("compression", "zstd").format("parquet").saveAsTable(table))
    spark.createDataFrame([(n, spark.table(table).schema.json())], "buckets int, schema string").write.parquet(f"{path}/{name}.layout")
    return spark.table(table)


def _delete(spark: SparkSession, path: str) -> None:
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to_path, True)


def _table_name(path: str, name: str) -> str:
    return "vitrine_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1]) + "_" + name


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name not in KEYS:
        return spark.read.parquet(f"{path}/{name}")
    table = _table_name(path, name)
    if not spark.catalog.tableExists(table):

        layout = spark.read.parquet(f"{path}/{name}.layout").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])))
        keys, order = ", ".join(KEYS[name]), ", ".join(ORDER.get(name, KEYS[name]))
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({order}) "
                  f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(table)


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that ``build_index`` wrote to ``path``."""
    return Index(**{m.name: _read(spark, path, m.name) for m in members(Index)})


def build_index(D: DataFrame, fields: dict[str, str], key: str = "id", path: str | None = None, positions: bool = False,
                keep: Sequence[str] = (), fuzzy: Sequence[str] = (), prefix: Sequence[str] = ()) -> Index:
    """Build the index of ``fields`` (name -> kind) at ``path`` (a fresh scratch
    folder by default). ``positions``: keep position lists, for phrases. ``keep``:
    document columns to store. ``fuzzy`` / ``prefix``: fields with those tables.

    The documents are analysed once. Lengths travel with the tokens; the postings
    shuffle once into their term's part and once into document vectors, and before by (field, term, document) where
    documents share an id or positions are kept."""
    spark = D.sparkSession
    path = path or scratch_path(spark, "index")
    key_type = dict(D.dtypes)[key]
    if not positions and set(fields.values()) == {"text"}:
        each = _word_counts(D, key, list(fields))
        if not D.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            each = each.groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    else:
        each = _tokens(D, fields, key, positions)
    each.write.option("compression", "zstd").parquet(f"{path}/postings")
    each = None
    raw = spark.read.parquet(f"{path}/postings")
    stats = _save(raw.where("term is null").groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")),
                  path, "fields", 0)
    raw = raw.where("term is not null")
    n_postings = raw.count()
    dictionary = raw.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    numbered = assign_offsets(dictionary.withColumnRenamed("field", "topic"), ["term"]).withColumnsRenamed({"topic": "field", "offset": "number"})
    parts = F.ceil(F.col("df") / PART_DOCS).cast("int").alias("parts")
    numbered = numbered.select("field", "term", "number", "df", "cf", parts)
    numbered.write.parquet(f"{path}/dictionary")
    numbered = spark.read.parquet(f"{path}/dictionary")

    text = [f for f, k in fields.items() if k == "text"]
    heavy = numbered.where("parts > 1").select("field", "term", "df", "parts")
    if heavy.count() <= HEAVY_BROADCAST:
        heavy = F.broadcast(heavy)
    length = F.when(F.col("field").isin(text), F.col("dl"))
    extra = ["positions"] if positions else []
    dealt = (raw.join(heavy, ["field", "term"], "left").join(F.broadcast(stats), "field")       # one row per field
             .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "parts")).cast("int"))
             .withColumn("less", -saturation(F.col("tf"), length, F.col("avgdl"))))
    tasks = max(spark.sparkContext.defaultParallelism, n_postings // TASK_POSTINGS + 1)
    dealt = dealt.select("field", "term", "part", "less", "doc_id", F.col("tf").cast("int").alias("tf"), "dl", "df", "n_docs", *extra)
    blocks = _save(_blocks(dealt.repartition(tasks, "field", "term", "part"), extra), path, "blocks", n_postings, tasks)
    _delete(spark, f"{path}/postings")              # the blocks hold them now
    raw = dealt = None
    swept(spark)                                    # what the steps so far have shuffled
    tops = blocks.where("block = 0").groupBy("field", "term").agg(F.max("top").alias("top"))
    terms = _save(numbered.join(tops, ["field", "term"]).join(F.broadcast(stats), "field"), path, "terms", numbered.count())
    postings = blocks.select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.doc_id", "p.impact")
    vectors = _save(postings.groupBy("doc_id").agg(F.collect_list(F.struct("field", "term", "impact")).alias("terms")),
                    path, "vectors", n_postings // 64)
    near = terms.where(F.col("field").isin(list(fuzzy))).select("field", "term", F.explode(FZ.deletion_variants(F.col("term"))).alias("x"))
    variants = _save(near.select("field", F.col("x.v").alias("v"), F.col("x.d").alias("d"), "term").distinct(), path, "variants", 0)
    n = F.least(F.length("term"), F.lit(PREFIX_MAX))
    heads = (terms.where(F.col("field").isin(list(prefix)) & (F.length("term") > 0))
             .select("field", "number", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.col("term").substr(F.lit(1), i))).alias("prefix")))
    prefixes = _save(heads.groupBy("field", "prefix").agg(F.min("number").alias("low"), F.max("number").alias("high")), path, "prefixes", 0)
    kept = [F.col(f"`{c}`") for c in keep if c != "doc_id"]
    docs = _save(D.select(F.col(key).cast(key_type).alias("doc_id"), *kept), path, "docs", 0)
    _delete(spark, f"{path}/dictionary")
    swept(spark)
    return Index(blocks, terms, stats, vectors, variants, prefixes, docs)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of the names, sizes and times of the files behind Parquet tables.
    Reads no column; one row comes back."""
    parts = []
    for p in paths:
        files = spark.read.parquet(p).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        parts.append(str(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns)), F.sum("file_size")).first()))
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:16]


def stored(spark: SparkSession, name: str, paths: Sequence[str], build: Callable[[str], Index]) -> Index:
    """The index ``name`` of the tables at ``paths``: read if it is there and its
    files have not changed, else built. A build counts once its marker is written,
    so one that dies is never read, and of two at once the later one stays."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/index/{name}-{fingerprint(spark, paths)}"
    try:
        return read_index(spark, spark.read.parquet(f"{root}-ready").first()["path"])
    except AnalysisException:
        path = f"{root}-{uuid.uuid4().hex[:8]}"
        made = build(path)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{root}-ready")
        return made
