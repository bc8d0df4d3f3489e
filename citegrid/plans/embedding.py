"""Vectors for texts through a provider, each text once: what a keyed cache has is not asked for again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fetch import retrying
from ..sources.sinks import append_new, exists
from .providers import Provider

CACHE = "chunk_id string, embedding array<float>"


def embed_texts(texts: DataFrame, provider: Provider, batch: int = 100, attempts: int = 2) -> DataFrame:
    """texts(id, text) -> (id, embedding), `batch` texts a call. A batch that fails is asked for text by text; a text that fails then has a
    null vector, as have null and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = retrying(lambda t: provider.embed(t), attempts, 0.0)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out: list[list[float] | None] = [None] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and t.strip()]
            for a in range(0, len(todo), batch):
                part = todo[a : a + batch]
                try:
                    got = many(provider)([texts[i] for i in part])
                except Exception:  # the provider's own errors
                    got = [alone(one, texts[i]) for i in part]
                for i, v in zip(part, got):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


def many(provider: Provider) -> Callable[[list[str]], list[list[float]]]:
    return getattr(provider, "embed_batch", None) or (lambda texts: [provider.embed(t) for t in texts])


def alone(one: Callable[[str], list[float]], text: str) -> list[float] | None:
    try:
        return one(text)
    except Exception:
        return None


def embed_cached(chunks: DataFrame, path: str, provider: Provider, batch: int = 100) -> DataFrame:
    """chunks(chunk_id, chunk_text, ...) with `embedding` and `cached` (was it known before): asks for the vectors that the table at `path`
    has not, appends those that came, and joins. Failed ones are null and are asked for again next time."""
    spark = chunks.sparkSession
    known = spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
    before = cut_ids(known)
    todo = chunks.select(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text")).where(F.col("id").isNotNull()).dropDuplicates(["id"])
    new = embed_texts(todo.join(before.withColumnRenamed("chunk_id", "id"), "id", "left_anti"), provider, batch)
    append_new(new.where(F.col("embedding").isNotNull()).withColumnRenamed("id", "chunk_id"), path, "chunk_id")
    have = spark.read.schema(CACHE).parquet(path)
    out = chunks.drop("embedding").join(have, "chunk_id", "left")
    return out.join(before.withColumn("cached", F.lit(True)), "chunk_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def cut_ids(known: DataFrame) -> DataFrame:
    from ..session import cut_lineage

    return cut_lineage(known.select("chunk_id").distinct())
