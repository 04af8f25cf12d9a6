"""A session with the settings that the queries were tried with, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliospark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one given to setCheckpointDir().

    Where neither is set, and only if all tasks run in the driver's own process, a temporary folder that is deleted at exit. On a cluster
    that would be a folder of one machine, so there it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        context.setCheckpointDir(f"file://{root}")
    if ":/" not in root:
        return f"file://{root}"
    return re.sub(r"^file:/+", "file:///", root)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read again: it survives lost executors, cuts the lineage, and what made it runs once."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(path: str) -> None:
    """Delete a folder of our own that nothing reads any more."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        files.delete_dir(root)


def spread(df: DataFrame) -> DataFrame:
    """A table over at least as many partitions as the cluster has cores: for work on rows that costs far more than to deal them out.
    Tables of as many files or more, as large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
