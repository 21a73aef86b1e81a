"""Reading tables, cutting lineage and spreading narrow work over the cores of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marginalia import __version__

#: Setting that names the folder shared by all executors.
CHECKPOINT_KEY = "spark.checkpoint.dir"

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary one."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set(CHECKPOINT_KEY, folder)
        _staged.append((spark, folder.removeprefix("file://")))
    return folder


def health(spark: SparkSession) -> DataFrame:
    """One row: status, service and version."""
    return spark.sql("SELECT :s AS status, :n AS service, :v AS version", {"s": "healthy", "n": "marginalia", "v": __version__})


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as a parquet table in the shared folder and read back.

    Cuts the lineage with files that outlive any executor. The table is removed by ``release`` or when
    the driver's Python ends, as the frame returned to a caller may still be read lazily until then.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed as ``stage``'s tables are."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def release() -> None:
    """Delete the tables that ``stage`` wrote in this process.

    Local ones go even if their session has been stopped; elsewhere call this before stopping it.
    """
    while _staged:
        spark, path = _staged.pop()
        local = path.removeprefix("file://")
        if local.startswith("/") and os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
            continue
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; nothing can be deleted through it any more
            pass


atexit.register(release)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores.

    A table of few small files would give costly narrow work (Python, regular expressions) to few cores.
    A table of many splits, as at scale, is returned as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
