"""Tables and files in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a session whose executors are this machine (tests) gets a temporary one; others raise."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables or folders that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM notice plans that are gone, so that their shuffle files are deleted now and not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on between stages, beside the JVM of their executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What workers keep between tasks, see kept().
_caches: list[dict] = []


def kept(cache: dict) -> dict:
    """The dictionary, whose entries a worker keeps between tasks of one step, until another step that needs the memory calls forget()."""
    _caches.append(cache)
    return cache


def forget() -> None:
    """Drop what former steps left in this worker."""
    for cache in _caches:
        cache.clear()
    trimmed()


#: Rows of an Arrow batch in steps that are written here: texts may be long, and a worker holds a batch beside its results.
BATCH_ROWS = 500


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path. It cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path, conf = new_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(df.schema).parquet(path), path
