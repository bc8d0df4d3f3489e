import pytest
from conftest import rows

from citegrid.operators.learning import whys
from citegrid.operators.retrieval import dense_topk
from citegrid.operators.store import read_index
from citegrid.plans.embedding import embed_cached, embed_texts
from citegrid.plans.ingest import ingest_fulltext
from citegrid.plans.providers import Offline
from citegrid.sources import fetch as S


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def failing(times, then="ok"):
    left = [times]

    def call():
        if left[0]:
            left[0] -= 1
            raise OSError("down")
        return then

    return call


def test_pacing_and_retries():
    c = Clock()
    call = S.paced(lambda: c.now, 3.0, c, c.sleep)
    assert [call(), call(), call()] == [0.0, 3.0, 6.0]
    assert S.retrying(failing(2), 3, 1.0, 2.0, 60.0, c.sleep)() == "ok" and c.slept[-2:] == [1.0, 2.0]
    with pytest.raises(OSError):
        S.retrying(failing(3), 3, 0.0)()


def test_breaker_waits_and_stops():
    c = Clock()
    health = iter([False, False, True])
    b = S.Breaker(lambda: next(health), 2, 120.0, 5.0, c.sleep)
    call = failing(2)
    for _ in range(2):
        with pytest.raises(OSError):
            b(call)
    assert c.slept == [5.0, 5.0] and b(call) == "ok" and b.failed == 0
    dead = S.Breaker(lambda: False, 1, 10.0, 5.0, c.sleep)
    with pytest.raises(S.Stopped):
        dead(failing(1))


def odd(dim):
    class Odd(Offline):
        """Fails on batches that hold a text with an x, and on that text."""

        def embed(self, text):
            if "x" in text:
                raise OSError("no")
            return super().embed(text)

    return Odd(dim)


def test_embedding_through_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("a", "one"), ("b", "x"), ("c", None), ("d", " "), ("a", "one")], "chunk_id string, chunk_text string")
    first = embed_cached(df, path, odd(8))
    assert rows(first.selectExpr("chunk_id", "cached", "size(embedding)")) == [("a", False, 8), ("a", False, 8), ("b", False, None), ("c", False, None), ("d", False, None)]
    again = embed_cached(df, path, Offline(8))
    assert rows(again.selectExpr("chunk_id", "cached", "coalesce(size(embedding), 0) > 0")) == [("a", True, True), ("a", True, True), ("b", False, True), ("c", False, False), ("d", False, False)]
    assert spark.read.parquet(path).count() == 2
    assert embed_texts(spark.createDataFrame([], "id int, text string"), Offline(8)).count() == 0


def test_lookup_knows_what_is_not_found(spark, tmp_path):
    path = str(tmp_path / "c")
    give = lambda ids: [{"paperId": f"s{x}", "citationCount": 1} if x != "no" else None for x in ids]
    ids = spark.createDataFrame([("p1",), (" p1",), ("no",), (None,), ("",)], "arxiv_id string")
    assert rows(S.citation_lookup(ids, path, give, 2), "s2_id") == [("sp1",)]
    assert rows(S.lookup_counts(spark, path)) == [(False, 1), (True, 1)]

    def never(asked):
        raise AssertionError(asked)

    assert rows(S.citation_lookup(ids, path, never), "s2_id") == [("sp1",)]
    assert S.answers(["a"] * 3, lambda x: [None] * len(x)).shape == (3, 3)


def test_scan_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.read_through(spark, str(tmp_path), {"category": "cs.AI", "from": "2020/01"}, make).count() == 3
    assert len(made) == 1


def test_ingest_gives_a_searchable_index(spark, sf, tmp_path):
    raw, parsed = spark.read.parquet(f"{sf}/papers.parquet"), spark.read.parquet(f"{sf}/parsed_papers.parquet")
    for fresh in (True, False):
        got = {r.what: r.n for r in ingest_fulltext(raw, parsed, str(tmp_path), 2026, Offline(16), fresh).collect()}
        ix = read_index(spark, str(tmp_path / "index"))
        assert ix.entries.count() == got["chunks"] > 0 and got["cost"] > 0
    hit = ix.entries.where("dim = 16").orderBy("chunk_id").first()
    assert dense_topk(ix, list(hit.embedding), 1).first().score == 1.0


def test_explanations_by_position():
    assert whys(["START: a", "", "Step 3: b"], 3) == ["a", "b", ""] and whys(["GOAL:c", "d", "e"], 2) == ["c", "d"]
