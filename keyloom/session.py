"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"

# The settings the operators rely on.
REQUIRED_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",  # last value of a repeated key wins
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings that the operators rely on, and return the session."""
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a session in one process (``local`` or ``local[n]``) without the setting gets a temporary
    folder; on a cluster a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get(SHARED_DIR_KEY, None) or spark.sparkContext.getConf().get(SHARED_DIR_KEY)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set(SHARED_DIR_KEY, folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all tables that this application has written with :func:`materialize`.

    For the end of a job: results that were not written elsewhere still read them.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    Cuts lineage without tying the data to executors, so that a result used by
    several later plans costs one pass over the input and survives lost executors.
    All tables of an application lie in one folder; :func:`release` removes it.
    """
    spark = df.sparkSession
    target = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def discard(table: DataFrame) -> None:
    """Remove a table written with :func:`materialize` that nothing will read any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_prepared: dict[tuple, tuple[SparkContext, Column]] = {}


def prepared(key: Hashable, build: Callable[[], Column]) -> Column:
    """A column expression built once per Spark context.

    The walks over nested values are deep expressions of thousands of calls into the JVM; they name
    their input column, so one instance serves every DataFrame that has it.
    """
    context = SparkContext._active_spark_context
    known = _prepared.get((key,))
    if known is None or known[0] is not context:
        known = (context, build())
        _prepared[(key,)] = known
    return known[1]
