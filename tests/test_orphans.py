import bisect
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from citegrid.operators.orphans import bare_id, find_orphans, paper_orphans

REFS = "owner string, field string, key string, as_of timestamp"
PARENTS = "key string, arrived timestamp"


def t(n):
    import datetime

    return None if n is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)


def run(spark, refs, parents, gone, **kw):
    r = spark.createDataFrame([(o, f, k, t(a)) for o, f, k, a in refs], REFS)
    p = spark.createDataFrame([(k, t(a)) for k, a in parents], PARENTS)
    g = spark.createDataFrame([(k,) for k in gone], "key string")
    return sorted((x.owner, x.field, x.key, x.reason) for x in find_orphans(r, p, g, **kw).collect())


def brute(refs, parents, gone):
    first = {}
    for k, a in parents:
        if k is not None and a is not None:
            first[k] = min(a, first.get(k, a))
    out = []
    for o, f, k, a in refs:
        if k is None:
            continue
        why = "missing" if k not in first else "deleted" if k in gone else "late" if a is not None and first[k] > a else None
        if why:
            out.append((o, f, k, why))
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, {"range_rows": 10, "refs_per_task": 20, "sample_rows": 40}])
def test_against_brute_force_with_a_hot_key(spark, kw):
    rng = random.Random(3)
    keys = [f"k{i:03d}" for i in range(120)]
    parents = [(k, rng.choice([0, 5, 9, None])) for k in keys[:90] for _ in range(rng.choice([1, 1, 2]))]
    refs = [(f"o{i}", rng.choice(["references", "cited_by"]), "k007" if i % 3 == 0 else rng.choice([*keys, None, ""]), rng.choice([3, 7, None])) for i in range(600)]
    gone = ["k003", "k011", "k999", None]
    assert run(spark, refs, parents, gone, **kw) == brute(refs, parents, gone)


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [("a", "f", "x", 1)], [], []) == [("a", "f", "x", "missing")]
    assert run(spark, [], [("x", 1)], ["x"]) == []


def test_repeated_rows_and_further_columns(spark):
    r = spark.createDataFrame([("a", "f", "x", None, 1, 2)] * 2, REFS + ", rg int, salt int")
    p = spark.createDataFrame([("y", None, "z", True)], PARENTS + ", reason string, deleted boolean")
    g = spark.createDataFrame([], "key string")
    assert [x.reason for x in find_orphans(r, p, g).collect()] == ["missing"] * 2


def test_bare_ids(spark):
    given = [" ARXIV: 2301.1v2 ", "abs/2301.1", "2301.1V3", "arxiv:2301.1", "hep-th/9901001v1", "", None]
    df = spark.createDataFrame([(x,) for x in given], "x string").select(bare_id(F.col("x")).alias("b"))
    assert [r.b for r in df.collect()] == ["2301.1", "2301.1", "2301.1", "2301.1", "hep-th/9901001", "", None]


def test_papers(spark):
    papers = spark.createDataFrame(
        [
            ("arxiv:1", [" arXiv:2v1 ", None, " ", "9"], ["3"], t(5), t(0)),
            ("arxiv:1", [" arXiv:2v1 ", None, " ", "9"], ["3"], t(5), t(1)),
            ("arxiv:2v2", None, [], None, t(0)),
            ("arxiv:3", ["4"], None, None, t(8)),
            (None, ["5"], None, None, None),
        ],
        "id string, references array<string>, cited_by array<string>, enriched_at timestamp, ingested_at timestamp",
    )
    gone = spark.createDataFrame([("2", None), ("3", t(1))], "paper_id string, restored_at timestamp")
    got = paper_orphans(papers, gone).distinct()
    assert rows(got.where("owner is not null"), "owner", "field", "key", "reason") == [
        ("arxiv:1", "cited_by", "3", "late"),
        ("arxiv:1", "references", "2", "deleted"),
        ("arxiv:1", "references", "9", "missing"),
        ("arxiv:3", "references", "4", "missing"),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=3), unique=True), st.lists(st.text("abc", max_size=3)))
def test_probe_is_a_binary_search(keys, wanted):
    import pyarrow as pa

    from citegrid.operators.orphans import probe

    stamp = pa.timestamp("us", "UTC")
    parents = pa.table({"key": pa.array(keys, pa.string()), "arrived": pa.array([1] * len(keys), stamp), "deleted": pa.array([False] * len(keys))})
    n = len(wanted)
    refs = pa.table({"owner": ["o"] * n, "field": ["f"] * n, "key": pa.array(wanted, pa.string()), "as_of": pa.array([2] * n, stamp)}) if n else None
    if refs is None:
        return
    ordered = sorted(keys)
    miss = [w for w in wanted if not (bisect.bisect_left(ordered, w) < len(ordered) and ordered[bisect.bisect_left(ordered, w)] == w)]
    assert probe(parents, refs).column("key").to_pylist() == miss


def test_long_keys_and_final_zero_bytes(spark):
    long = "x" * 100_000
    parents = [(k, 0) for k in ("a", "a\0", "b" * 48, "b" * 49, long, "é" * 30)]
    refs = [("o", "f", k, 1) for k in ("a", "a\0", "a\0\0", "b" * 47, "b" * 48, "b" * 49, "b" * 50, long, long + "y", "é" * 30, "é" * 29)]
    for kw in ({}, {"range_rows": 2, "sample_rows": 100}):
        assert run(spark, refs, parents, ["b" * 49], **kw) == brute(refs, parents, {"b" * 49})
