"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only needed where it is not installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="kinspark-"), "kinspark")
        shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(f"{archive}.zip")
        _shipped.add(context.applicationId)


def local_session(app: str = "kinspark", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, benches and trying things out.

    On a cluster the caller brings its own session; nothing in the library depends on
    these settings beyond Spark's defaults (adaptive execution on).
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is set only
    where the session has none, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            named = tempfile.mkdtemp(prefix="kinspark-")
        spark.sparkContext.setCheckpointDir(named)
        current = named
    return (named or current).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/kinspark/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this application, at its end; whether there were any.

    Results that were returned but not yet written still read from them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_is_missing(error: Exception) -> bool:
    """Whether a read failed only because there is nothing at its path."""
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def through_table(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of executors, and lets several
    consumers read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_table(df, name: str) -> tuple:
    """``through_table``, and the number of rows, which Spark observes while it writes them."""
    seen = Observation()
    return through_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), name), seen.get["n_rows"]
