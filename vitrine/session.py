"""Session helpers.

On a cluster the session comes from the platform; these helpers only fill in
settings that are unset, so a cluster's own choices always win.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults for a local session (tests, bench). On a cluster size
# spark.sql.shuffle.partitions to ~ input bytes / 128 MB and let AQE coalesce.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "vitrine", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the context already uses, else the
    one the cluster names in ``spark.checkpoint.dir``.

    Where neither is set, a ``local[...]`` session (tests) gets a fresh scratch
    folder; any other master raises, because a folder of one machine would be
    invisible to the executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and "
                               "all executors share")
        d = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the checkpoints and shuffle files of frames that are out of use: it does so when the
    driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that Spark sends to a Python worker at a time, unless the session says
#: otherwise: whole documents are long, and a worker holds a batch twice or more.
BATCH_ROWS = 1_000
BATCH_BYTES = "16m"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Prepare a session for Python stages: send this package to the workers
    (once per context), so that they run from any working folder and on any
    executor, and keep batches small where the session has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="vitrine-pkg-"), "vitrine.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED["app"] = sc.applicationId


_SHIPPED: dict[str, str] = {}
