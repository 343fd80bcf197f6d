"""Session and checkpoint settings."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every query here is written for."""
    builder = (
        SparkSession.builder.master(master)
        .appName("veldspar")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only on one
    machine, as in tests, a temporary one is made where that is unset; on a
    cluster executors would write to disks of their own, so this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veldspar-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again.

    This cuts its lineage, survives lost executors, and gives the columns new
    identities, so the result can be joined with itself. The table is deleted
    when the application ends, or by :func:`released`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldspar_step = path
    steps = spark.sparkContext.__dict__.setdefault("_veldspar_steps", set())
    if not steps:
        atexit.register(_sweep, spark, steps)
    steps.add(path)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables from :func:`checkpointed` that no later step reads."""
    for df in tables:
        path = getattr(df, "_veldspar_step", None)
        if path is not None:
            _delete(df.sparkSession, path)
            df.sparkSession.sparkContext.__dict__.get("_veldspar_steps", set()).discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep(spark: SparkSession, steps: set[str]) -> None:
    for path in list(steps):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)
    steps.clear()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_veldspar_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='veldspar-ship-')}/veldspar.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._veldspar_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has far fewer parts than there are.

    For costly work per row on a small input, such as a single file. An input
    of any size worth a cluster has parts enough and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
