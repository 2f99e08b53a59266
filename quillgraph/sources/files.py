"""Sinks and resumable logs: gated Parquet writes, CSV reports, JSON lines appended by what is not yet done, guarded output folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """A write that must not happen."""


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Every table as Parquet below `folder`."""
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "snappy").parquet(f"{folder}/{name}")


def write_checked(tables: dict[str, DataFrame], checks: DataFrame, folder: str, mode: str = "errorifexists") -> list[tuple]:
    """Writes the tables only if no check FAILs; the failing checks (a row each) are raised otherwise. Warnings are returned."""
    rows = checks.where("status <> 'PASS'").collect()  # one row per check
    failed = [tuple(r) for r in rows if r["status"] == "FAIL"]
    if failed:
        raise Refused(f"checks failed: {failed}")
    write_tables(tables, folder, mode)
    return [tuple(r) for r in rows]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resume(todo: DataFrame, log: str, key: str, work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Does `work` for the rows of `todo` whose key is not in the JSON-lines log yet and appends the outcome; returns the whole log."""
    spark = todo.sparkSession
    if exists(spark, log):
        todo = todo.join(read_json_lines(spark, log, schema).select(key).distinct(), key, "left_anti")
    work(todo).write.mode("append").json(log)
    return read_json_lines(spark, log, schema)


def output_target(spark: SparkSession, folder: str, partial: bool, force: bool = False) -> str:
    """Where a run may write: a partial run never into the main folder, a full one not over an existing one unless forced."""
    target = f"{folder.rstrip('/')}-partial" if partial else folder
    if not partial and not force and exists(spark, target):
        raise Refused(f"{target} exists")
    return target


def last_writer(frames: list[DataFrame], key: str) -> DataFrame:
    """One row per key over several files, the last file's; null keys are left out."""
    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("__file", F.lit(i))
        both = f if both is None else both.unionByName(f, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "__file")]
    g = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__file", F.hash(*rest))).alias("r"))
    return g.select(key, "r.*")


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: what a cached copy is checked by."""
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols)), 256)
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.sha256(f"{cols}|{n}|{total}".encode()).hexdigest()


def write_cache(df: DataFrame, path: str) -> str:
    """A table as JSON lines with its hash beside it."""
    digest = content_hash(df)
    df.write.mode("overwrite").json(f"{path}/rows")
    df.sparkSession.createDataFrame([(digest,)], "sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return digest


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cached table; Refused if its rows are not those that were written."""
    df = read_json_lines(spark, f"{path}/rows", schema)
    if content_hash(df) != spark.read.json(f"{path}/meta").first()["sha256"]:
        raise Refused(f"{path} does not hold what was written")
    return df
