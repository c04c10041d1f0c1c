"""Tables that micro-batches write: whole versions, and parts by key.

No table format is installed, so a table is Parquet folders and a rule which of them count. Both
kinds are written so that a micro-batch that runs again writes the same folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table written as numbered versions: version v is complete once its
    _SUCCESS marker exists. A re-run of a micro-batch rewrites the same
    version, so the sink is idempotent (exactly-once with the checkpoint). The
    last two versions stay: the current one and the one a re-run starts from.
    For tables that each micro-batch needs whole, such as the rows that wait."""

    #: Versions below are a writer's own; versions of a daily job count from here.
    FIRST_RUN = 1_000_000

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def version_path(self, v: int) -> str:
        return f"{self.path}/v={v:012d}"

    def _files(self, spark: SparkSession):
        to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path

    def versions(self, spark: SparkSession) -> list[int]:
        """The complete versions, oldest first."""
        fs, to_path = self._files(spark)
        if not fs.exists(to_path(self.path)):
            return []
        found = [s.getPath() for s in fs.listStatus(to_path(self.path)) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(to_path(p, "_SUCCESS")))

    def latest(self, spark: SparkSession) -> DataFrame | None:
        done = self.versions(spark)
        return spark.read.parquet(self.version_path(done[-1])) if done else None

    def latest_before(self, spark: SparkSession, v: int) -> DataFrame | None:
        """The newest complete version before v (a re-run of v must not read itself)."""
        done = [x for x in self.versions(spark) if x < v]
        return spark.read.parquet(self.version_path(done[-1])) if done else None

    def write(self, df: DataFrame, v: int) -> None:
        """Write version v; versions older than the one before it go."""
        df.write.mode("overwrite").parquet(self.version_path(v))
        spark = df.sparkSession
        fs, to_path = self._files(spark)
        for old in [x for x in self.versions(spark) if x < v][:-1]:
            fs.delete(to_path(self.version_path(old)), True)


class KeyedTable:
    """A table dealt over ``parts`` folders by a hash of its key, of which a
    micro-batch rewrites the parts it touches and no others.

    Batch b writes ``v=b/part=p`` for each touched part p, an empty folder where
    nothing is left of it, and then the marker that completes b. A part's current rows are
    those of its last complete version. A re-run of b reads what was there before b and
    writes the same folders. Of each part the last two versions stay."""

    def __init__(self, path: str, key: str, parts: int = 16):
        self.path, self.key, self.parts = path.rstrip("/"), key, parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that rows with the key lie in: at most ``parts`` numbers."""
        return sorted(r["part"] for r in rows.where(F.col(self.key).isNotNull()).select(self.part().alias("part")).distinct().collect())

    def _files(self, spark: SparkSession):
        to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path

    def versions(self, spark: SparkSession) -> dict[int, list[int]]:
        """part -> its complete versions, oldest first."""
        fs, to_path = self._files(spark)
        found: dict[int, list[int]] = {}
        if not fs.exists(to_path(self.path)):
            return found
        for v in sorted(s.getPath().getName() for s in fs.listStatus(to_path(self.path))):
            folder = to_path(f"{self.path}/{v}")
            if v.startswith("v=") and fs.exists(to_path(folder, "_DONE")):
                for s in fs.listStatus(folder):
                    if s.getPath().getName().startswith("part="):
                        found.setdefault(int(s.getPath().getName()[5:]), []).append(int(v[2:]))
        return found

    def read(self, spark: SparkSession, parts: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The current rows, of ``parts`` only, as they were before version ``before``; None if there are none."""
        fs, to_path = self._files(spark)
        folders = []
        for p, versions in self.versions(spark).items():
            done = [v for v in versions if before is None or v < before]
            if done and (parts is None or p in parts):
                folders.append(f"{self.path}/v={done[-1]:012d}/part={p}")
        folders = [f for f in folders if len(fs.listStatus(to_path(f)))]
        return spark.read.option("basePath", self.path).parquet(*folders).drop("v", "part") if folders else None

    def latest(self, spark: SparkSession) -> DataFrame | None:
        return self.read(spark)

    def write(self, df: DataFrame, v: int, touched: Sequence[int]) -> None:
        """Version v of the touched parts; ``df`` holds all their rows. One file a part."""
        spark, folder = df.sparkSession, f"{self.path}/v={v:012d}"
        (df.withColumn("part", self.part()).repartition(max(1, len(touched)), "part")
         .write.mode("overwrite").partitionBy("part").parquet(folder))
        fs, to_path = self._files(spark)
        for p in touched:
            fs.mkdirs(to_path(f"{folder}/part={p}"))
        fs.create(to_path(f"{folder}/_DONE"), True).close()
        for p, versions in self.versions(spark).items():
            for old in [x for x in versions if x < v][:-1]:
                fs.delete(to_path(f"{self.path}/v={old:012d}/part={p}"), True)
