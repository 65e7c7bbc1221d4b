"""Directory watching with Structured Streaming: new files, changed files, removed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.model import Tables, content_hash


def watch(spark: SparkSession, folder: str, state_dir: str, checkpoint: str, parse: Callable[[DataFrame], Tables], alert: Callable[[DataFrame], None], pattern: str = "*.json"):
    """Start a query that handles all files there are and stops (``availableNow``); call it again to go on.

    Each batch keeps the last version of every path, parses it, compares its
    components with the path's last good state, hands the changes to ``alert``
    (``sbom_id, kind, id``) and stores the new state.  A file that doesn't parse
    leaves the old state.  Rerunning a batch overwrites the same state, so a
    restart changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def state() -> DataFrame:
        if not _stored(spark, state_dir):
            return spark.createDataFrame([], "sbom_id string, id string, content bigint, batch bigint")
        rows = spark.read.parquet(state_dir)
        w = Window.partitionBy("sbom_id").orderBy(F.desc("batch"))
        return rows.withColumn("age", F.dense_rank().over(w)).where("age = 1").drop("age")

    def handle(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("path").orderBy(F.desc("modificationTime"))
        docs = batch.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("path").alias("sbom_id"), F.decode("content", "UTF-8").alias("text"))
        new = parse(docs).components.select("sbom_id", "id", content_hash().alias("content")).distinct().persist()
        old = state().where(F.col("batch") < number).join(new.select("sbom_id").distinct(), "sbom_id", "left_semi")
        both = old.select("sbom_id", "id", F.col("content").alias("was")).join(new.withColumnRenamed("content", "now"), ["sbom_id", "id"], "full_outer")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
        alert(both.select("sbom_id", kind.alias("kind"), "id").where("kind is not null"))
        new.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{state_dir}/part={number}")
        new.unpersist()

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there; one that can't be read is an error, not an empty state."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def removed_files(spark: SparkSession, state_dir: str, listing: DataFrame) -> DataFrame:
    """Watched paths that the current listing (``sbom_id``) lacks: a file source can't see a deletion."""
    return spark.read.parquet(state_dir).select("sbom_id").distinct().join(listing, "sbom_id", "left_anti")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than ``late`` are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("starts"), key, "n", "total")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and read the result back."""
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
