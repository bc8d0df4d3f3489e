"""Admission limits over a log of requests, in batch and as a stream, and resumable ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.papers import unseen

HOUR, DAY = 3600, 86400


def admit(times: list[float], accepted: list[float], per_hour: int, per_day: int) -> list[bool]:
    """Sliding windows over accepted requests only; `accepted` is the state and is changed. A request exactly an hour old no longer counts."""
    out = []
    for t in times:
        accepted[:] = [x for x in accepted if t - x < DAY]
        ok = sum(t - x < HOUR for x in accepted) < per_hour and len(accepted) < per_day
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def day_cap(requests: DataFrame, per_day: int = 200) -> DataFrame:
    """Global cap by day of UTC: the first `per_day` requests of a day pass. Ranks only what a day's heads can hold, cut before the shuffle."""
    day = F.floor(F.unix_micros("ts") / (DAY * 1_000_000))
    w = W.partitionBy("day").orderBy("ts", "request_id")
    return requests.withColumn("day", day).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_day).drop("_r", "day")


def ip_limit(requests: DataFrame, per_hour: int = 20, per_day: int = 50) -> DataFrame:
    """requests with `accepted`: whether it passed depends on what passed before, so each ip is folded in order of time. The rows come sorted
    and in batches; of an ip only its accepted requests of the last day are held. Requests without a time are left out."""
    ordered = requests.where(F.col("ts").isNotNull()).select("request_id", "ip", "ts").repartition("ip").sortWithinPartitions("ip", "ts", "request_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, accepted = None, []
        for pdf in batches:
            seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
            passed = []
            for ip, t in zip(pdf["ip"], seconds):
                if ip != at:
                    at, accepted = ip, []
                passed += admit([t], accepted, per_hour, per_day)
            yield pdf.assign(accepted=passed)

    return ordered.mapInPandas(fold, "request_id bigint, ip string, ts timestamp, accepted boolean")


def admission(requests: DataFrame, keys: list[str] | None = None, per_hour: int = 20, per_day: int = 50, global_per_day: int = 200) -> DataFrame:
    """Key, then global cap, then ip: what the ip limit turns away has been charged to the global cap."""
    passed = requests if keys is None else requests.where(F.col("api_key").isin(*keys))
    return ip_limit(day_cap(passed, global_per_day), per_hour, per_day)


def stream_ip_limit(requests: DataFrame, per_hour: int = 20, per_day: int = 50) -> DataFrame:
    """The same limit on a stream: state per ip, dropped after a day without requests by the log's own time. Rows over an hour late are left out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        rows["accepted"] = admit([x.timestamp() for x in rows["ts"]], accepted, per_hour, per_day)
        state.update((accepted,))
        last = int(rows["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + DAY * 1000)
        yield rows[["request_id", "ip", "ts", "accepted"]]

    return requests.withWatermark("ts", "1 hour").groupBy("ip").applyInPandasWithState(
        step, "request_id bigint, ip string, ts timestamp, accepted boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def ingest_stream(source: DataFrame, target: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Appends rows with keys that the target has not, once; starts where the last run ended. Returns the finished query."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = prepare(df).dropDuplicates([key])
        try:
            new = unseen(spark.read.parquet(target), new, key)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    q = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def breaker(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """outcomes(worker, seq, ok) -> runs of failures of one worker of at least `limit`: (worker, first, last, failures)."""
    w = W.partitionBy("worker").orderBy("seq")
    runs = outcomes.withColumn("run", F.sum(F.col("ok").cast("int")).over(w)).where(~F.col("ok"))
    return runs.groupBy("worker", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("failures")).where(F.col("failures") >= limit).drop("run")
