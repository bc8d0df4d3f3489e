"""The index as written tables: built once at ingest, read by every search.

entries are clustered by category and year, so that the filters of a search skip row groups, with Bloom filters on chunk_id and paper_id for
lookups of a few ids; postings and terms are sorted by term. A search shuffles neither vectors nor texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.sinks import clear, exists
from .retrieval import Index, index_of, tables_of

LAYOUT = 1  # of the tables; another one is another folder


def write_index(chunks: DataFrame, path: str) -> Index:
    """Writes the index of chunks to `path`, which must not exist, and reads it back."""
    spark = chunks.sparkSession
    sort = [c for c in ("primary_category", "year", "paper_id") if c in chunks.columns]
    entries = index_of(chunks).entries.repartitionByRange(*sort, "chunk_id").sortWithinPartitions(*sort, "chunk_id")
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("chunk_id", "paper_id")}
    entries.write.options(**blooms).parquet(f"{path}/entries")
    t = tables_of(spark.read.parquet(f"{path}/entries"))
    t.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/postings")
    t.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    t.stats.coalesce(1).write.parquet(f"{path}/stats")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("entries", "postings", "terms", "stats")))


def stored_index(spark: SparkSession, chunks_path: str) -> Index:
    """The index of a table of chunks, kept in the shared folder under the table's path, size and time; built where it isn't there yet."""
    path = f"{shared_dir(spark)}/index-{LAYOUT}-{_state(spark, chunks_path)}"
    if not exists(spark, f"{path}/stats/_SUCCESS"):
        draft = f"{path}-{spark.sparkContext.applicationId}"
        clear(spark, draft)
        write_index(spark.read.parquet(chunks_path), draft)
        jvm = spark.sparkContext._jvm
        src, dst = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
        fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if exists(spark, path) or not fs.rename(src, dst):  # another application was faster
            clear(spark, draft)
    return read_index(spark, path)


def _state(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p)]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def index_stats(index: Index) -> DataFrame:
    """One row: vectors, papers and words of the index, and the share of entries with a usable vector."""
    e = index.entries.agg(F.count("*").alias("entries"), F.count_if(F.col("dim") > 0).alias("vectors"), F.count_distinct("paper_id").alias("papers"), F.sum("dl").alias("words"))
    return e.withColumn("fullness", F.round(F.col("vectors") / F.greatest("entries", F.lit(1)), 6))


def storage_bytes(index: Index) -> DataFrame:
    """One row: estimate of the stored bytes, four for each number of a vector and one for each character of a text."""
    return index.entries.agg(F.sum(4 * F.col("dim").cast("bigint") + F.coalesce(F.length("chunk_text"), F.lit(0))).alias("bytes"))
