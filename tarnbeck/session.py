"""Session helpers: where intermediate tables go, and how large a broadcast may be."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def _clear(path: str) -> None:
    """At the end of the program: nothing reads the scratch folder any more."""
    local = path.removeprefix("file://")
    if "://" not in local:
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        jvm = SparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # the JVM is gone; the folder is named after the application and can be removed by hand
        pass


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder within the one all executors share, ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is made.
    Either is removed when the program ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        named = spark.conf.get("spark.checkpoint.dir", None)
        _SCRATCH[app] = f"{named.rstrip('/')}/tarnbeck-{app}" if named else "file://" + tempfile.mkdtemp(prefix="tarnbeck-")
        atexit.register(_clear, _SCRATCH[app])
    return _SCRATCH[app]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Write ``df`` to a new folder in the shared folder, or in ``folder``; returns the path."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files outlive any executor, so a lost executor costs only its tasks.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_out(df, name, folder))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later read needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with work for every core: a few large or small files are dealt out, many are left as they are.

    For operators that do much for each row without a shuffle; the scan must not hold
    an exchange, because its partitions are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
