"""Mixing sources to target shares of a requested number of tokens.

Each source gets its share as a budget. As long as the budget holds all of the source, all of it is taken once more (a complete
epoch, at most `max_repeats`); the rest of the budget is filled by Efraimidis-Spirakis sampling without replacement: every document
draws the key -ln(u) / weight, u from a hash of its id, and the documents with the smallest keys are taken while their running size
stays within the rest. The running size of a large source is not summed in one task. Keys fall into narrow ranges of their logarithm, whatever
the weights are; sizes are summed by range, and the one range that the budget ends in is cut once more, 4,096 times finer. Only
what falls into the fine range that the budget ends in, about a ten-millionth of the source, is sorted and summed row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, small


def budgets(supply: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(source, share, cap, have, budget, epochs, rest) for every listed source; supply: (source, have)."""
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.greatest(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("long").alias("cap"),
    )
    b = listed.join(supply, "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    b = b.withColumn("budget", F.floor(F.col("share") * float(total)).cast("long"))
    fits = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have")).cast("long")).otherwise(F.lit(0).cast("long"))
    b = b.withColumn("epochs", F.least(fits, "cap"))
    rest = F.when(F.col("epochs") < F.col("cap"), F.col("budget") - F.col("epochs") * F.col("have")).otherwise(F.lit(0).cast("long"))
    return b.withColumn("rest", rest)


def _edge(held: DataFrame, bucket: str) -> DataFrame:
    """held(source, bucket, held, rest) -> (source, bucket, room): the first bucket that the rest does not hold as a whole, and what it has left for it."""
    upto = W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    running = held.withColumn("upto", F.sum("held").over(upto)).where(F.col("upto") > F.col("rest"))
    return running.groupBy("source").agg(F.min(bucket).alias(bucket), F.min_by(F.col("rest") - (F.col("upto") - F.col("held")), bucket).alias("room"))


def mix(df: DataFrame, targets: DataFrame, total: int, seed: int = 7, ranges: int = 1024, fine: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(selection, report). df: (id, source, size, weight); targets: (source, target_share, max_repeats); total: tokens asked for.

    selection: (id, source, size, uses), uses > 0. report: (source, target_share, max_repeats, available, budget, selected, share,
    missing), one row per listed source; share is of all selected tokens. A source whose repeats are used up stays below its
    budget by `missing` tokens: the others aren't enlarged for it. Sources that are not listed, and null sources, give nothing.
    Null, zero or negative weights count as the least weight 1e-9, so such documents come last; null sizes are left out; documents
    of size 0 come with their key's turn. Equal rows draw the same key and are documents of their own. Null shares and repeats are 0.
    `ranges` is the number of ranges for each doubling of the key, `fine` that of the cuts of one range; they change the work, not the result.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1e-9))
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    rows = df.select("id", "source", F.col("size").cast("long").alias("size"), weight.alias("w")).where(
        F.col("size").isNotNull() & (F.col("size") >= 0) & F.col("source").isNotNull()
    )
    # the logarithm rises with the key: it stands for it
    rows = rows.withColumn("key", F.log2(-F.log(u) / F.col("w")) * ranges).drop("w")
    coarse = F.floor("key").cast("long")
    rows = rows.withColumn("b1", coarse).withColumn("b2", F.floor((F.col("key") - coarse) * fine).cast("int"))

    held = rows.groupBy("source", "b1").agg(F.sum("size").alias("held"))  # a few tens of thousands of rows for each source
    held = cut_lineage(held)
    supply = held.groupBy("source").agg(F.sum("held").alias("have"))
    plan = cut_lineage(budgets(supply, targets, total))  # one row per listed source
    first = _edge(held.join(plan.select("source", "rest"), "source"), "b1").withColumnsRenamed({"b1": "e1", "room": "rest"})
    inside = rows.join(small(first), "source").where(F.col("b1") == F.col("e1")).groupBy("source", "b2").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    second = _edge(inside, "b2").withColumnsRenamed({"b2": "e2"})
    # a source whose repeats are used up gives nothing beyond its epochs, not even documents of size 0
    rule = plan.select("source", "epochs", "cap").join(first.select("source", "e1"), "source", "left").join(second, "source", "left")
    more = F.col("epochs") < F.col("cap")
    low, high = F.lit(-(2**62)), F.lit(2**62)
    rule = cut_lineage(rule.select("source", "epochs", F.when(more, F.coalesce("e1", high)).otherwise(low).alias("e1"), F.coalesce("e2", F.lit(-1)).alias("e2"), "room"))
    marked = rows.join(small(rule), "source")
    edge = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    before = (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2")))
    sure = marked.where(~edge).select("id", "source", "size", (F.col("epochs") + before.cast("long")).alias("uses"))
    order = W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = marked.where(edge).withColumn("sum", F.sum("size").over(order))
    last = last.select("id", "source", "size", (F.col("epochs") + (F.col("sum") <= F.col("room")).cast("long")).alias("uses"))
    selection = sure.unionByName(last).where(F.col("uses") > 0)

    got = selection.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("selected"))
    report = plan.join(got, "source", "left").withColumn("selected", F.coalesce("selected", F.lit(0).cast("long")))
    report = report.join(report.agg(F.sum("selected").alias("whole")))  # one row
    report = report.select(
        "source",
        F.col("share").alias("target_share"),
        F.col("cap").alias("max_repeats"),
        F.col("have").alias("available"),
        "budget",
        "selected",
        F.when(F.col("whole") > 0, F.col("selected") / F.col("whole")).otherwise(F.lit(0.0)).alias("share"),
        (F.col("budget") - F.col("selected")).alias("missing"),
    )
    return selection, report
