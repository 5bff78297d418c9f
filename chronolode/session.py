"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chronolode", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings that every plan here assumes: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset in a local session, as in tests, a temporary folder is made, used and removed at exit; on a cluster,
    whose executors could not reach such a folder, that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="chronolode-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for what a query leaves there; it goes when the session's JVM ends."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/data"


def cut_lineage(df: DataFrame, rows: int | None = None, rows_each: int = 100_000) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor.

    ``rows``: about how many rows there are, where that is known; small tables are then written as few files.
    """
    shared_root(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_each)))
    return df.checkpoint()
