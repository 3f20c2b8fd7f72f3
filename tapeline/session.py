"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "16g", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("tapeline")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.driver.memory", memory)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            # as many partitions as cores already: merging small ones would idle cores
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one that the cluster names. Only a session of one machine may
    leave it unset (as in tests); its temporary folder is then shared by all there is."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tapeline-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none where there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor costs one read and not a replay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
