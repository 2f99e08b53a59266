"""Streams (an extension beyond the batch operators): latest row per key, deduplication and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read_event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than it is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """`start, …by, n` per tumbling window; rows later than the watermark are not counted."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *by, "n")


BUCKETS = 32


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def keep_latest(events: DataFrame, key: str, order: str, target: str, checkpoint: str):
    """Keeps the latest row per key in Parquet at `target`, micro-batch by micro-batch.

    Keys are hashed into BUCKETS; a batch reads and writes only the buckets it touches, merged by one aggregation, as `v=<batch>/b=<bucket>`;
    `latest_table` reads the newest version of each bucket. A batch that is run again writes the same folders again. Null keys are left out.
    """
    rest = [c for c in events.columns if c != key]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.where(F.col(key).isNotNull()).select(_bucket(key)).distinct().collect()}  # at most BUCKETS
        old = latest_table(spark, target, number, touched)
        both = batch if old is None else old.unionByName(batch)
        new = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("r")).select(key, "r.*")
        new.withColumn("b", _bucket(key)).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{target}/v={number:010d}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_table(spark: SparkSession, target: str, below: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket at `target` (of batches before `below`, of `buckets` only); None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True)
    found: dict[int, str] = {}
    for v in versions:
        if v.startswith("v=") and (below is None or int(v[2:]) < below):
            for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{v}")):
                name = s.getPath().getName()
                if name.startswith("b=") and (buckets is None or int(name[2:]) in buckets):
                    found.setdefault(int(name[2:]), f"{target}/{v}/{name}")
    return spark.read.parquet(*sorted(found.values())) if found else None


def run_once(query, spark: SparkSession) -> None:
    """Processes what is there and stops."""
    ensure_checkpoint_dir(spark)
    query.trigger(availableNow=True).start().awaitTermination()
