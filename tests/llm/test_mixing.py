import math
import random

from pyspark.sql import functions as F

from citegrid.llm.mixing import mix

DOCS = "id bigint, source string, size bigint, weight double, epochs int, key int"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, total, **kw):
    d = spark.createDataFrame([(*x, 0, 0) for x in docs], DOCS)
    sel, rep = mix(d, spark.createDataFrame(targets, TARGETS), total, **kw)
    return {(r.id, r.source): r.uses for r in sel.collect()}, {r.source: r for r in rep.collect()}


def test_budgets(spark):
    rng = random.Random(0)
    docs = [(i, "big", rng.randrange(1, 50), 1.0) for i in range(2000)] + [(9000 + i, "small", 10, 1.0) for i in range(50)] + [(99999, "other", 5, 1.0), (99998, None, 5, 1.0)]
    sel, rep = run(spark, docs, [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 2)], 4000)
    assert rep["small"].selected == 1200 and all(sel[9000 + i, "small"] in (2, 3) for i in range(50))  # two epochs and a part
    assert 0 <= rep["big"].missing < 50 and rep["tiny"].selected == 0 and rep["tiny"].missing == 800
    assert not any(s in ("other", None) for _, s in sel)
    size = {(i, s): n for i, s, n, _ in docs}
    assert rep["big"].selected == sum(size[k] * u for k, u in sel.items() if k[1] == "big")
    assert abs(sum(r.share for r in rep.values()) - 1) < 1e-9


def test_cap(spark):
    sel, rep = run(spark, [(i, "a", 10, 1.0) for i in range(5)], [("a", 1.0, 2)], 1000)
    assert set(sel.values()) == {2} and rep["a"].missing == 900


def test_the_smallest_keys_come_first_at_any_number_of_ranges(spark):
    docs = [(i, "a", 7, 0.1 + (i % 10)) for i in range(300)]
    picks = [run(spark, docs, [("a", 1.0, 1)], 700, ranges=r, fine=f)[0] for r, f in ((1, 1), (1, 16), (1024, 4096))]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 100


def test_weights(spark):
    docs = [(i, "a", 1, 1.0 if i % 2 else 9.0) for i in range(4000)]
    sel, _ = run(spark, docs, [("a", 1.0, 1)], 800)
    heavy = sum(i % 2 == 0 for i, _ in sel) / len(sel)
    assert 0.84 < heavy < 0.92 and math.isclose(len(sel), 800)


def test_tiny_weights_do_not_meet_in_one_range(spark):
    docs = [(i, "a", 3, 1e-9 if i % 2 else 0.1) for i in range(3000)]
    sel, rep = run(spark, docs, [("a", 1.0, 1)], 6000)
    assert 0 <= rep["a"].missing < 3 and sum(i % 2 == 0 for i, _ in sel) == 1500  # all heavier ones, then light ones
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], DOCS)
    key = F.log2(-F.log((F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 11).cast("double") + 0.5) / float(2**53)) / F.greatest("weight", F.lit(1e-9))) * 1024
    most = df.groupBy(F.floor(key)).count().agg(F.max("count")).first()[0]
    assert most < 20


def test_edges(spark):
    assert run(spark, [], [("a", 1.0, 1)], 10)[1]["a"].selected == 0
    assert run(spark, [(1, "a", 1, 1.0)], [], 10) == ({}, {})
    sel, _ = run(spark, [(1, "a", None, 1.0), (2, "a", 0, None), (3, "a", 3, -1.0), (3, "a", 3, -1.0)], [("a", 1.0, 2), (None, 1.0, 1)], 12)
    assert sel == {(2, "a"): 2, (3, "a"): 2}
    assert run(spark, [(1, "a", 1, 1.0)], [("a", None, None)], 10)[0] == {}
