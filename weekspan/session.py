"""Session defaults for local runs, and durable storage of intermediate tables."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks; a cluster job brings its own and has this package on its workers' path."""
    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weekspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LOCAL_SCRATCH = "file:///tmp/checkpoints/weekspan"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a test, gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = LOCAL_SCRATCH
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one written table; the application's folder is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and continue from the written copy.

    Used before anything that reads a table several times (model fitting, fitted statistics): losing an executor
    then costs a re-read, not a recomputation, and each reader scans only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table returned by ``durable``; only for one that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)
