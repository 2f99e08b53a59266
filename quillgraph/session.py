"""Session helpers: reading the tables of a directory and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory, read lazily so that Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set an own one only where none is named (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillgraph-checkpoints"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint: written to the shared folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A narrow lookup side of at most `most` rows marked for broadcast, so that the other side stays where it is; a larger one as it is."""
    return F.broadcast(df) if df.count() <= most else df


def tasks(spark: SparkSession) -> int:
    """Tasks over which Python-heavy work is dealt out: the shuffle partitions of the session, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """A scan or checkpoint of fewer partitions than there are cores, dealt out evenly; anything larger as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
