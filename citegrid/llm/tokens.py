"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's makers published for splitting text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file: of the copy that `offer` sent to this executor, or of the path itself."""
    import tiktoken

    sent = SparkFiles.get(os.path.basename(vocabulary))
    with open(sent if os.path.exists(sent) else vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def offer(spark: SparkSession, vocabulary: str = VOCABULARY) -> None:
    """Sends the vocabulary file, which only the driver must have, to the executors."""
    spark.sparkContext.addFile(vocabulary)


def sizes(texts: pa.Array, vocabulary: str = VOCABULARY) -> pa.Array:
    """Tokens of each text, none of which is null."""
    enc = encoder(vocabulary)
    return pa.array(np.fromiter((len(enc.encode_ordinary(t)) for t in texts.to_pylist()), np.int64, len(texts)))


def sized(df: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, size, *keep): tokens of each text. Null texts are left out, empty texts have size 0. The text itself goes no further."""
    offer(df.sparkSession, vocabulary)
    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kinds = [f"`{c}` {t}" for c, t in rows.dtypes if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names[:-1] + ["size"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), sizes(b.column(b.num_columns - 1), vocabulary)], names=names)

    return rows.mapInArrow(count, ", ".join([*kinds, "size bigint"]))
