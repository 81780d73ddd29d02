"""Tables written once: a value that several later steps need is computed one time, and a lost executor costs a reread."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, the warehouse, or for a local master a folder of its own."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        _local = _local or tempfile.mkdtemp(prefix="twinleaf-")
        return _local
    return spark.conf.get("spark.sql.warehouse.dir")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/twinleaf-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and values computed once are the same in every later use.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_at = path
    return out
