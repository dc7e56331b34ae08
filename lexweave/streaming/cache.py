"""Micro-batches over a content-addressed cache: only requests that the cache doesn't know are worked out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import curation


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def with_cache(batch: DataFrame, cache_path: str, key: str, work: Callable[[DataFrame], DataFrame], epoch: int) -> DataFrame:
    """Answers for the batch's distinct keys. New ones are worked out and written under cache_path/epoch=N; a repeated epoch
    overwrites its own folder, so that a retried batch leaves no second copy."""
    spark = batch.sparkSession
    ask = batch.dropDuplicates([key])
    if _exists(spark, cache_path):
        known = spark.read.parquet(cache_path).where(F.col("epoch") < epoch).drop("epoch").withColumn("status", F.lit("SUCCESS"))
        new = curation.cached(ask.select(*batch.columns), known.select(key, "status"), key).where("status = 'NEW'").drop("status")
    else:
        new = ask
    work(new).write.mode("overwrite").parquet(f"{cache_path}/epoch={epoch}")
    return spark.read.parquet(cache_path).where(F.col("epoch") <= epoch).drop("epoch").join(ask.select(key), key, "left_semi")


def run(stream: DataFrame, cache_path: str, key: str, work: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, once: bool = True):
    """Starts the query: every micro-batch's answers go to out_path/epoch=N."""

    def each(batch: DataFrame, epoch: int) -> None:
        with_cache(batch, cache_path, key, work, epoch).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def event_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than `late` are dropped by the watermark."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
