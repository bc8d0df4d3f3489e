"""Writing tables: append what is new, replace by key, rebuild, clear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.papers import unseen
from ..session import bounded, cut_lineage


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table has not; the table itself is the record of what is done."""
    spark = df.sparkSession
    rows = df.dropDuplicates([key])
    (unseen(spark.read.parquet(path), rows, key) if exists(spark, path) else rows).write.mode("append").parquet(path)


def upsert_report(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: upserted, skipped, failed. Rows without an embedding fail, stored ids are skipped."""
    have = stored.select("chunk_id").distinct().withColumn("known", F.lit(True))
    j = chunks.join(have, "chunk_id", "left").withColumn("bad", F.coalesce(F.size("embedding"), F.lit(0)) < 1)
    return j.agg(
        F.count_if(F.col("known").isNull() & ~F.col("bad")).alias("upserted"),
        F.count_if(F.col("known").isNotNull()).alias("skipped"),
        F.count_if(F.col("known").isNull() & F.col("bad")).alias("failed"),
    )


def failed_ids(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, paper_id, error): new rows that can't be stored as they have no embedding."""
    new = chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    return new.where(F.coalesce(F.size("embedding"), F.lit(0)) < 1).select("chunk_id", "paper_id", F.lit("no embedding").alias("error"))


def upsert_vectors(chunks: DataFrame, path: str, failures: str | None = None) -> DataFrame:
    """Appends the chunks that the table at `path` has not, once each, and records those without an embedding at `failures`; the report's
    row. What is stored already is skipped."""
    spark = chunks.sparkSession
    one = chunks.dropDuplicates(["chunk_id"])
    stored = cut_lineage(spark.read.parquet(path).select("chunk_id")) if exists(spark, path) else spark.createDataFrame([], "chunk_id string")
    report = bounded(upsert_report(one, stored), 1)
    if failures:
        append_failures(failed_ids(one, stored).select("paper_id", "error"), failures)
    append_new(one.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0), path, "chunk_id")
    return report


def append_failures(rows: DataFrame, path: str) -> None:
    """rows(paper_id, error), stamped with the time of the run."""
    rows.select("paper_id", "error", F.current_timestamp().alias("failed_at")).write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the finished table at `new` in the place of `path`."""
    clear(spark, path)
    jvm = spark.sparkContext._jvm
    p, q = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q):
        raise OSError(f"{new} could not be moved to {path}")


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
