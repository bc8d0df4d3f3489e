"""References to records that do not exist: missing, deleted, or arrived only later.

Parent keys are cut into ranges at quantiles of a bounded sample. In a range the parents form one sorted array, and the
references of that range are probed against it by binary search, a whole batch at once (`locate`). Ranges that many references fall into
(a paper that everyone cites) are dealt out to several tasks, each with its own copy of the array; the copies are sized by a
count per range, so that no task gets more than about `refs_per_task` references.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MISSING, DELETED, LATE = "missing", "deleted", "late"
OUT = pa.schema([("owner", pa.string()), ("field", pa.string()), ("key", pa.string()), ("as_of", pa.timestamp("us", "UTC")), ("reason", pa.string())])


def bare_id(c: Column) -> Column:
    """Lower case, without outer blanks, one leading `arxiv:` or `abs/` with blanks after it, and a final version."""
    x = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(x, r"^(arxiv:|abs/)\s*", ""), r"v[0-9]+$", "")


def _micros(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(col.is_null())
    return np.asarray(col.cast(pa.int64()).fill_null(0)), null


#: Keys of more bytes than this are kept out of the sorted arrays, whose elements are as wide as the longest.
WIDTH = 48


def _array(keys: list[bytes]) -> np.ndarray:
    """Keys as a fixed-width array; a last byte of 1 keeps final zero bytes apart."""
    return np.array([k + b"\x01" for k in keys], dtype="S") if keys else np.empty(0, "S1")


def _parted(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and array of the short keys, positions of the long ones."""
    size = np.asarray(pc.binary_length(col))
    short, long = np.flatnonzero(size <= WIDTH), np.flatnonzero(size > WIDTH)
    return short, _array([x.encode() for x in col.take(pa.array(short)).to_pylist()]), long


def locate(parents: pa.ChunkedArray, wanted: pa.ChunkedArray) -> np.ndarray:
    """Position in parents (different keys) of each wanted key, -1 for none: binary search in the sorted array, a whole batch at once. The
    few keys that are too long for it are looked up by their hash."""
    at = np.full(len(wanted), -1, np.int64)
    where, keys, long_parents = _parted(parents)
    here, probes, long_wanted = _parted(wanted)
    if len(keys) and len(probes):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        found = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
        at[here] = np.where(keys[found] == probes, where[order[found]], -1)
    if len(long_parents) and len(long_wanted):
        got = pc.index_in(wanted.take(pa.array(long_wanted)), value_set=parents.take(pa.array(long_parents)))
        got = np.asarray(got.fill_null(-1))
        at[long_wanted] = np.where(got >= 0, long_parents[got], -1)
    return at


def probe(parents: pa.Table, refs: pa.Table) -> pa.Table:
    """The references of one range that miss, with the reason. parents: (key, arrived, deleted), one row per key."""
    if not refs.num_rows:
        return OUT.empty_table()
    reason = np.ones(refs.num_rows, np.int8)  # 0: fine, 1: missing
    if parents.num_rows:
        at = locate(parents.column("key"), refs.column("key"))
        arrived, absent = _micros(parents.column("arrived"))
        deleted = np.asarray(parents.column("deleted")).astype(bool)
        as_of, open_end = _micros(refs.column("as_of"))
        there = (at >= 0) & ~absent[at]
        reason[there] = 0
        reason[there & ~open_end & (arrived[at] > as_of)] = 3
        reason[there & deleted[at]] = 2
    miss = pa.array(np.flatnonzero(reason))
    names = pa.array([MISSING, DELETED, LATE])
    got = refs.select(["owner", "field", "key", "as_of"]).take(miss)
    got = got.append_column("reason", names.take(pa.array(reason[reason > 0].astype(np.int64) - 1)))
    return got.cast(OUT)


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    deleted: DataFrame,
    range_rows: int = 20_000,
    refs_per_task: int = 200_000,
    sample_rows: int = 20_000,
) -> DataFrame:
    """(owner, field, key, as_of, reason) for each row of `refs` whose key has no live parent at `as_of`.

    refs: owner string, field string, key string, as_of timestamp; parents: key, arrived timestamp (any number of rows per key, the
    first arrival counts); deleted: key. Reason, the first that holds: `missing` (no row in parents), `deleted` (a row in
    `deleted`), `late` (first arrival after as_of). Null keys on any side take no part; empty keys are keys like any other. A null
    as_of is never `late`; a parent with only null arrivals counts as missing. Repeated references come out as often as they went
    in. Without parents every reference is missing; without references there are no rows. Further columns are not read.
    """
    known = parents.select("key", F.col("arrived").cast("timestamp").alias("arrived"), F.lit(False).alias("deleted")).unionByName(
        deleted.select("key", F.lit(None).cast("timestamp").alias("arrived"), F.lit(True).alias("deleted"))
    )
    known = known.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("arrived").alias("arrived"), F.max("deleted").alias("deleted"))
    refs = refs.select("owner", "field", "key", F.col("as_of").cast("timestamp").alias("as_of")).where(F.col("key").isNotNull())
    # both are read for a sample first and then whole: made once
    known, refs = cut_lineage(known), cut_lineage(refs)

    total = known.count()
    ranges = max(1, math.ceil(total / range_rows))
    bounds = np.empty(0, "S1")
    if ranges > 1:
        rate = min(1.0, sample_rows / total)
        picked = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(rate * 1_000_000)).select(F.substring("key", 1, WIDTH).alias("key")).toArrow()
        keys = np.sort(_array([k.encode() for k in picked.column("key").to_pylist()]))
        if len(keys):
            bounds = np.unique(keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1]])

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _array([k[:WIDTH].encode() for k in key]), side="right").astype(np.int32))

    known = known.withColumn("rg", range_of("key"))
    refs = refs.withColumn("rg", range_of("key"))
    # how many tasks share a range: counted on a sample of the owners, at a known rate
    part = min(1.0, 10 * sample_rows / max(1, total))
    seen = refs if part == 1.0 else refs.where(F.pmod(F.xxhash64("owner"), F.lit(1_000_000)) < int(part * 1_000_000))
    tasks = [1] * (len(bounds) + 1)
    for r in seen.groupBy("rg").count().collect():  # one row per range
        tasks[r["rg"]] = max(1, math.ceil(r["count"] / part / refs_per_task))
    salts = F.element_at(F.lit(tasks), F.col("rg") + 1)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("owner", "field"), salts).cast("int"))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return probe(left, right)

    return (
        known.groupBy("rg", "salt")
        .cogroup(refs.groupBy("rg", "salt"))
        .applyInArrow(task, "owner string, field string, key string, as_of timestamp, reason string")
    )


def paper_references(papers: DataFrame) -> DataFrame:
    """References of papers in both fields: each bare id once per row and field; null and blank elements are left out."""
    fields = []
    for f in ("references", "cited_by"):
        ids = F.array_distinct(F.filter(F.transform(F.filter(F.col(f), lambda x: x.rlike(r"\S")), bare_id), lambda x: x.isNotNull()))
        fields.append(F.struct(F.lit(f).alias("field"), ids.alias("ids")))
    both = papers.select(F.col("id").alias("owner"), F.col("enriched_at").alias("as_of"), F.inline(F.array(*fields)))
    return both.select("owner", "field", "as_of", F.explode("ids").alias("key"))


def paper_orphans(papers: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Elements of references and cited_by that name no paper, a deleted one, or one that came later."""
    parents = papers.select(bare_id(F.col("id")).alias("key"), F.col("ingested_at").alias("arrived"))
    gone = withdrawals.where(F.col("restored_at").isNull()).select(bare_id(F.col("paper_id")).alias("key")).distinct()
    return find_orphans(paper_references(papers), parents, gone)
