"""Session helpers: shared storage for cut lineage, and table access.

Operators that need an intermediate result twice write it as a Parquet table
below ``spark.checkpoint.dir`` (a folder that every executor shares), so that a
lost executor never loses it.  Only on a local master, where driver and
executors are one process, may that setting be absent: a private folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the session's, or on a local master our own if it has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="bomloom-"))
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bomloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Delete every table that ``materialize`` wrote; returns how many.

    Results that are still lazy read these tables, so call it once they are
    consumed.  Runs by itself when the driver exits.
    """
    count = 0
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            count += bool(fs.delete(target, True))
        except Exception:  # the session is gone: its folder goes with the cluster
            continue
    return count


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the rank of ``key`` (distinct values, no nulls), from 1, as ``name``.

    Range-partitioned and ranked in every partition, moved by the sizes of the
    partitions before it: no task sees more than a partition.
    """
    parted = materialize(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a partition
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parted.withColumn("_inside", inside).join(before, "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
