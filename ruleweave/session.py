"""Session helpers: where intermediate tables go, and how small is small enough."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast by hint only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is used
    only for a local master, where there is no other machine.
    """
    sc = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir")
        or sc.getCheckpointDir()
    )
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="ruleweave-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _goes_with_driver(spark: SparkSession, path: str) -> None:
    """Have the folder's file system delete it when the driver ends."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in parts per value of ``by``, and read it back.

    Later plans start from this table, so their lineage stays one scan deep and a lost
    executor costs a re-read, not a recomputation. The table belongs to the driver: as
    results are read lazily from it, it stays until the driver ends, and then goes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ruleweave-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _goes_with_driver(spark, path)
    return spark.read.schema(df.schema).parquet(path)
