"""Sessions, and this package on executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "16g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    scratch = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{scratch}",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of a batch that a Python worker holds, where the session has Spark's default: rows may be whole documents.
BATCH_ROWS = 1000


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors' Python workers, once a session, and keeps their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not getattr(spark.sparkContext, "_loomspan_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        spark.sparkContext._loomspan_shipped = True
    return spark


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; a temporary one in local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_loomspan_scratch", None)
        if root is None:
            root = spark._loomspan_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root}/loomspan/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder's path under scratch_root."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df written once and read again, so that values which depend on the plan (row numbers) stay what they are."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a lookup table (names, patterns, regions of a caller) up to which it is broadcast.
FEW = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count proves it small; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
