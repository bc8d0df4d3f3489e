"""Calls of outside services: pacing, retries, a breaker, and citation look-ups in batches with a cache that also knows what was not found."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .records import CITATION, citation_record
from .sinks import append_new, exists

CACHED = "arxiv_id string, found boolean, payload string"


def paced(call: Callable, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, never sooner than `gap` seconds after the last one began."""
    last = [-float("inf")]

    def run(*args: Any) -> Any:
        wait = last[0] + gap - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return call(*args)

    return run


def retrying(call: Callable, attempts: int = 3, first_wait: float = 1.0, factor: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, tried up to `attempts` times with growing waits; the last error goes on."""

    def run(*args: Any) -> Any:
        wait = first_wait
        for n in range(attempts):
            try:
                return call(*args)
            except Exception:
                if n == attempts - 1:
                    raise
                if wait:
                    sleep(min(wait, most))
                wait *= factor

    return run


class Stopped(Exception):
    """The service did not come back."""


class Breaker:
    """Counts failures in a row. From `limit` on it asks `healthy` every `step` seconds for up to `patience` seconds before it lets the next
    call through, and raises Stopped if the service does not come back: what was done until then stays."""

    def __init__(self, healthy: Callable[[], bool], limit: int = 3, patience: float = 120.0, step: float = 5.0, sleep: Callable[[float], None] = time.sleep):
        self.healthy, self.limit, self.patience, self.step, self.sleep, self.failed = healthy, limit, patience, step, sleep, 0

    def __call__(self, call: Callable, *args: Any) -> Any:
        try:
            got = call(*args)
        except Exception:
            self.failed += 1
            if self.failed >= self.limit:
                self._wait()
            raise
        self.failed = 0
        return got

    def _wait(self) -> None:
        waited = 0.0
        while not self.healthy():
            if waited >= self.patience:
                raise Stopped(f"{self.failed} failures in a row")
            self.sleep(self.step)
            waited += self.step
        self.failed = 0


def citation_lookup(ids: DataFrame, path: str, fetch: Callable[[list[str]], list[dict | None]], batch: int = 500, gap: float = 0.0, attempts: int = 3) -> DataFrame:
    """Citation records (sources.records.citation_record) of the ids(arxiv_id), asked for in batches of at most `batch` through
    `fetch(ids) -> one response or None each`. Answers are kept in the table at `path`, also that an id is not known, and are not asked for again."""
    spark = ids.sparkSession
    todo = ids.select(strip(F.col("arxiv_id")).alias("arxiv_id")).where(F.col("arxiv_id") != "").distinct()
    if exists(spark, path):
        todo = todo.join(spark.read.schema(CACHED).parquet(path), "arxiv_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retrying(paced(fetch, gap), attempts)
        held: list[str] = []
        for pdf in batches:
            held += pdf["arxiv_id"].tolist()
            while len(held) >= batch:
                yield answers(held[:batch], ask)
                held = held[batch:]
        if held:
            yield answers(held, ask)

    append_new(todo.mapInPandas(run, CACHED), path, "arxiv_id")
    known = spark.read.schema(CACHED).parquet(path).join(ids.select(strip(F.col("arxiv_id")).alias("arxiv_id")).distinct(), "arxiv_id", "left_semi")
    found = known.where("found").select(F.from_json("payload", CITATION).alias("r"), "arxiv_id")
    return citation_record(found.select("r.*", F.col("arxiv_id").alias("_asked")))


def answers(ids: list[str], ask: Callable[[list[str]], list[dict | None]]) -> pd.DataFrame:
    got = ask(ids)
    return pd.DataFrame({"arxiv_id": ids, "found": [g is not None for g in got], "payload": [None if g is None else json.dumps(g) for g in got]})


def lookup_counts(spark, path: str) -> DataFrame:
    """(found, n): what the cache knows and what it knows to be missing."""
    return spark.read.schema(CACHED).parquet(path).groupBy("found").agg(F.count("*").alias("n"))


def read_through(spark, path: str, key: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a scan under its parameters: read if it was made before, else made, written and read."""
    name = "_".join(f"{k}={v}" for k, v in sorted(key.items())).replace("/", "_").replace(":", "_").replace(" ", "_")
    at = f"{path}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
