import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrid.llm.segment import TOKEN, cuts, split_oversized, token_count

PARAMS = (30, 5, 10, 0.5, 0.3)


def check(text, limit=30, overlap=5):
    got = cuts(text, limit, overlap, 10, 0.5, 0.3)
    n = len(TOKEN.findall(text))
    if n <= limit:
        assert got == [(0, len(text), n)]
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, k), (c, d, m) in zip(got, got[1:]):
        assert c < b or overlap == 0 and c == b  # no gap
        assert len(TOKEN.findall(text[c:b])) == overlap
    for a, b, k in got:
        assert k <= limit and len(TOKEN.findall(text[a:b])) == k
    return got


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 400))
def test_pieces(seed, n):
    rng = random.Random(seed)
    text = "".join(rng.choice(["alpha ", "beta ", "gamma. ", "Delta ", "x", "\n\n", "!", " ", "é", "。", "\n"]) for _ in range(n))
    check(text)


def test_cuts_at_topics():
    a = " ".join("The cat sat on the mat with a cat." for _ in range(3))
    b = " ".join("Stock prices fell as markets closed lower." for _ in range(3))
    first = check(f"{a} {b}", 40)[0]
    assert f"{a} {b}"[first[0] : first[1]].strip() == a


def test_no_boundaries():
    assert len(check("x " * 100)) > 3 and len(check("!" * 100)) > 3


def test_operator(spark):
    long = "Word one is here. " * 400
    df = spark.createDataFrame([("a", "short text", 1), ("b", long, 2), ("b", long, 2), (None, "x", 3), ("n", None, 4), ("e", "", 5)], "k string, t string, piece int")
    got = split_oversized(df, "k", "t", 600, 60)
    assert got.where("n_tokens > 600").count() == 0
    assert sorted((r.key or "", r.n_tokens) for r in got.where("pieces = 1").collect()) == [("", 1), ("a", 2), ("e", 0)]
    b = [r for r in got.where("key = 'b'").orderBy("piece", "start").collect()]
    assert len(b) == 2 * b[0].pieces and b[0].text == b[1].text and long.startswith(b[0].text)
    assert split_oversized(df.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "k", "t", 600, 400)


def test_counts_agree(spark):
    texts = ["a_b c-d, 12.5", "né à 中文。 x y", "", "!!", "\t\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [len(TOKEN.findall(t)) for t in texts]
