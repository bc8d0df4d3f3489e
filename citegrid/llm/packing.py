"""Filling containers of a fixed number of tokens, mixing sources in target proportions.

Each source is a queue in the order of a hash. A window of containers is filled by deficit round-robin: each turn adds a source's share to
its deficit, and the source gives items while the deficit pays for them. The window's items are then placed by best fit, largest
first; what finds no room goes back to its queue with its deficit, and room that is left takes the largest item that fits from the source
that is owed most. Deficits carry over from window to window.

They also carry over from partition to partition, exactly. Sources that give at the rates of their shares have given `rate * v` tokens at
time v of the schedule, until they run out; so an item that has `at` tokens of its source before it is due at v = at / rate, and the tokens
that all sources have given at v are a piecewise linear function R(v), with a bend where a listed source runs out. A partition is a slice
of about `part_tokens` tokens of R; it holds what is due in it of every source. What a source is owed where the slice begins is
rate * v less the tokens before its first item of the slice: that is the deficit with which the partition before it ended, at most one
item while supply lasts, whatever the number of partitions. `at` is a prefix sum in two levels: over buckets of a source's
queue, and within a bucket.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, cut_lineage

OUT = "id {kind}, part_no int, parts int, source string, tokens bigint, window string, container string, slot int"
#: Listed sources: their ends are the bends of the schedule, which every task has.
LISTED_MOST = 100_000


class Bins:
    """Open containers by free space."""

    def __init__(self, count: int, capacity: int):
        self.free = [(capacity, i) for i in range(count)]
        self.held: list[list] = [[] for _ in range(count)]

    def place(self, size: int, item) -> bool:
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            return False
        room, i = self.free.pop(at)
        self.held[i].append(item)
        insort(self.free, (room - size, i))
        return True


class Queue:
    """Items of one source in order, also by size."""

    def __init__(self, items: list[tuple]):
        self.items, self.next, self.gone = items, 0, bytearray(len(items))
        self.by_size = sorted((it[0], -i) for i, it in enumerate(items))

    def head(self) -> int | None:
        while self.next < len(self.items) and self.gone[self.next]:
            self.next += 1
        return self.next if self.next < len(self.items) else None

    def take(self, i: int) -> tuple:
        self.gone[i] = 1
        del self.by_size[bisect_left(self.by_size, (self.items[i][0], -i))]
        return self.items[i]

    def give_back(self, i: int) -> None:
        self.gone[i] = 0
        insort(self.by_size, (self.items[i][0], -i))
        self.next = min(self.next, i)

    def fitting(self, room: int) -> int | None:
        """The first of the largest items within the room."""
        at = bisect_right(self.by_size, (room, 0)) - 1
        return -self.by_size[at][1] if at >= 0 else None


def fill(items: list[tuple], rates: dict[str, float], owed: dict[str, float], capacity: int, window: int) -> tuple[list[list[list]], dict[str, float]]:
    """items: (0 < size <= capacity, source, key) in queue order -> windows of containers of items; the deficits at the end. owed: deficits
    at the beginning, where they are not 0."""
    by: dict[str, list[tuple]] = {}
    for it in items:
        by.setdefault(it[1], []).append(it)
    queues = {s: Queue(by[s]) for s in sorted(by)}
    rate = {s: max(rates.get(s, 0.0), 1e-12) for s in queues}
    deficit = {s: owed.get(s, 0.0) for s in queues}
    left = sum(it[0] for it in items)
    out: list[list[list]] = []
    while left:
        bins_n = min(window, math.ceil(left / capacity))
        picked = _round_robin(queues, rate, deficit, bins_n * capacity, capacity)
        bins, back = Bins(bins_n, capacity), []
        for s, i in sorted(picked, key=lambda x: -queues[x[0]].items[x[1]][0]):
            it = queues[s].items[i]
            if not bins.place(it[0], it):
                back.append((s, i))
        for s, i in back:
            queues[s].give_back(i)
            deficit[s] += queues[s].items[i][0]
        _top_up(bins, queues, deficit)
        held = [h for h in bins.held if h]
        left -= sum(it[0] for h in held for it in h)
        out.append(held)
    return out, deficit


def _round_robin(queues: dict[str, Queue], rate: dict[str, float], deficit: dict[str, float], room: int, quantum: int) -> list[tuple[str, int]]:
    picked: list[tuple[str, int]] = []
    heads = {s: i for s, q in queues.items() if (i := q.head()) is not None}
    while room > 0 and heads:
        sizes = {s: queues[s].items[i][0] for s, i in heads.items()}
        if all(deficit[s] < n for s, n in sizes.items()):
            # turns until the first source can pay for its next item
            turns = max(1, math.ceil(min((n - deficit[s]) / (rate[s] * quantum) for s, n in sizes.items())))
            for s in heads:
                deficit[s] += turns * rate[s] * quantum
        for s in list(heads):
            q = queues[s]
            while s in heads and room > 0 and q.items[heads[s]][0] <= deficit[s]:
                it = q.take(heads[s])
                picked.append((s, heads[s]))
                deficit[s] -= it[0]
                room -= it[0]
                i = q.head()
                if i is None:
                    del heads[s]
                else:
                    heads[s] = i
    return picked


def _top_up(bins: Bins, queues: dict[str, Queue], deficit: dict[str, float]) -> None:
    """Gives room that is left to the largest item that fits, of the source that is owed most; its source pays for it."""
    order = sorted((s for s, q in queues.items() if q.by_size), key=lambda s: -deficit[s])
    for room, i in sorted(bins.free, reverse=True):
        while room > 0:
            got = next(((s, n) for s in order if (n := queues[s].fitting(room)) is not None), None)
            if got is None:
                break
            s, n = got
            it = queues[s].take(n)
            bins.held[i].append(it)
            deficit[s] -= it[0]
            room -= it[0]
            order = sorted((s for s in order if queues[s].by_size), key=lambda s: -deficit[s])


class Schedule:
    """R(v): tokens given at time v when sources give at their rates until they run out, and its inverse. ends: (have, rate) of the listed sources and of all others
    together; after them, at rate 1, what has no share."""

    def __init__(self, ends: list[tuple[float, float]]):
        ends = sorted((have / rate, have, rate) for have, rate in ends if rate > 0)
        self.v = np.array([0.0, *(e[0] for e in ends)])
        slope = sum(e[2] for e in ends)
        base, tokens, slopes = 0.0, [0.0], [slope]
        for v, have, rate in ends:
            tokens.append(base + slope * v)
            base, slope = base + have, slope - rate
            slopes.append(max(slope, 0.0))
        slopes[-1] = 1.0
        self.tokens, self.slope = np.maximum.accumulate(np.array(tokens)), np.array(slopes)

    @property
    def end(self) -> float:
        return float(self.v[-1])

    def given(self, v: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.v, v, side="right") - 1
        return self.tokens[i] + self.slope[i] * (v - self.v[i])

    def time(self, tokens: float) -> float:
        i = int(np.searchsorted(self.tokens, tokens, side="right")) - 1
        return float(self.v[i] + (tokens - self.tokens[i]) / max(self.slope[i], 1e-12))


def pack(df: DataFrame, shares: DataFrame | None = None, capacity: int = 2048, window: int = 32, part_tokens: int = 2_000_000) -> DataFrame:
    """(id, part_no, parts, source, tokens, window, container, slot): every item of df(id, size, source) in a container of `capacity` tokens.

    An item within the capacity is never split (parts = 1). A larger one is cut into pieces of `capacity` tokens and a rest, each of which
    is packed like an item. shares(source, share): target proportions, of at most 100,000 sources; unlisted sources, a null source (itself a
    queue, under '') and everything, where there are no shares, weigh as many tokens as they have. Zero, negative and null shares come after
    all others, in proportion to what they have. A source that runs out leaves its share to the others in their proportions. Null and negative sizes are left out,
    size 0 takes a slot without room. Ids should be unique: equal rows are items of their own, but are dealt to one task. No items: no rows.
    """
    kind = dict(df.dtypes)["id"]
    rows = df.select("id", F.coalesce("source", F.lit("")).alias("source"), F.col("size").cast("long").alias("size")).where(F.col("size") >= 0)
    supply = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("have"), F.count("*").alias("n")))
    total = supply.agg(F.sum("have")).first()[0] or 0
    parts_n = max(1, math.ceil(total / part_tokens))

    listed = supply.select("source").limit(0).withColumn("share", F.lit(0.0)) if shares is None else shares.where(F.col("source").isNotNull()).groupBy("source").agg(F.greatest(F.coalesce(F.sum("share"), F.lit(0.0)), F.lit(0.0)).alias("share"))
    aims = supply.join(listed, "source", "left").withColumn("aim", F.coalesce(F.col("share") * float(total), F.col("have").cast("double")))
    last = F.col("share").isNotNull() & (F.col("share") <= 0)
    sums = aims.agg(F.sum("aim").alias("aim"), F.sum(F.when(last, F.col("have"))).alias("rest"), F.sum(F.when(F.col("share").isNull(), F.col("have"))).alias("other")).first()
    aim, rest, other = float(sums["aim"] or 0) or 1.0, float(sums["rest"] or 0) or 1.0, float(sums["other"] or 0)
    named = bounded(aims.where(F.col("share") > 0).select("have", "aim"), LISTED_MOST).collect()
    schedule = Schedule([(float(r["have"]), r["aim"] / aim) for r in named] + [(other, other / aim)])
    rates = aims.select("source", F.greatest(F.when(last, F.col("have") / rest).otherwise(F.col("aim") / aim), F.lit(1e-12)).alias("rate"), F.when(last, schedule.end).otherwise(0.0).alias("begin"))

    large = F.col("size") > capacity
    parts = F.when(large, F.ceil(F.col("size") / capacity)).otherwise(1).cast("int")
    pieces = rows.withColumn("parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = pieces.withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part_no").cast("long") * capacity))
    pieces = pieces.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "size", "part_no"), 1)).drop("size")
    pieces = pieces.withColumn("bucket", F.least(F.lit(parts_n - 1), F.floor(F.col("h") / float(2**63) * parts_n).cast("int")))
    full, empty = pieces.where(F.col("tokens") > 0), pieces.where(F.col("tokens") == 0)

    # tokens before each bucket of a source's queue: a row for each source and bucket
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    held = full.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    offsets = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held").join(rates, "source")
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "part_no").rowsBetween(W.unboundedPreceding, -1)
    due = full.join(offsets, ["source", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))

    @F.pandas_udf("int")
    def slice_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.clip(schedule.given(v.to_numpy()) // part_tokens, 0, parts_n - 1).astype(np.int32))

    cols = ["p", "id", "part_no", "parts", "source", "tokens", "h", "at", "rate", "begin"]
    due = due.withColumn("p", slice_of(F.col("begin") + F.col("at") / F.col("rate"))).select(*cols)
    none = empty.withColumns({"p": F.col("bucket"), "at": F.lit(0).cast("long"), "rate": F.lit(0.0), "begin": F.lit(0.0)}).select(*cols)

    def task(key: tuple, items: pa.Table) -> pa.Table:
        p = key[0].as_py()
        items = items.sort_by([("source", "ascending"), ("at", "ascending"), ("h", "ascending"), ("part_no", "ascending")])
        begins = schedule.time(p * float(part_tokens))
        col = {c: items.column(c).to_pylist() for c in ("id", "part_no", "parts", "source", "tokens", "at", "rate", "begin")}
        rates: dict[str, float] = {}
        owed: dict[str, float] = {}
        todo, slots = [], []
        for i, (s, n) in enumerate(zip(col["source"], col["tokens"])):
            if not n:
                slots.append((0, s, i))
                continue
            if s not in rates:
                rates[s] = col["rate"][i]
                owed[s] = rates[s] * (begins - col["begin"][i]) - col["at"][i]
            todo.append((n, s, i))
        windows, _ = fill(todo, rates, owed, capacity, window)
        places = [(w, held) for w, containers in enumerate(windows) for held in containers]
        if slots and not places:
            places = [(0, [])]
        for k, it in enumerate(slots):
            places[k % len(places)][1].append(it)
        row = [(it[2], it[0], f"{p}-{w}", f"{p}-{n}", slot) for n, (w, held) in enumerate(places) for slot, it in enumerate(held)]
        at = pa.array([r[0] for r in row], pa.int64())
        got = items.select(["id", "part_no", "parts", "source", "tokens"]).take(at)
        for name, k, t in (("window", 2, pa.string()), ("container", 3, pa.string()), ("slot", 4, pa.int32())):
            got = got.append_column(name, pa.array([r[k] for r in row], t))
        return got

    return due.unionByName(none).groupBy("p").applyInArrow(task, OUT.format(kind=kind))


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, containers, tokens, room used as a share."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("items"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("used")
    )


def window_report(packed: DataFrame, shares: DataFrame) -> DataFrame:
    """(window, source, tokens, share, target): what each source has of each window, and its target share, null where none is listed."""
    per = packed.groupBy("window", "source").agg(F.sum("tokens").alias("tokens"))
    whole = per.groupBy("window").agg(F.sum("tokens").alias("whole"))
    targets = shares.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("target"))
    j = per.join(whole, "window").join(targets, "source", "left")
    return j.select("window", "source", "tokens", F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0).alias("share"), "target")
