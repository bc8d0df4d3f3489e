import contextlib
import io
import datetime

from conftest import rows
from pyspark.sql import functions as F

from citegrid.operators import retrieval as R
from citegrid.operators.papers import current_papers
from citegrid.operators.store import stored_index, write_index
from citegrid.plans.providers import Offline, unwrap
from citegrid.plans.search import ChatParams, Engine, SearchParams

T0 = datetime.datetime(2020, 1, 1)


def index(spark):
    recs = [
        ("a1", "a", [1.0, 0.0], "graph pooling", 2001, "cs.AI", "method", 1),
        ("a2", "a", [0.0, 1.0], "graph", 2001, "cs.AI", "method", 1),
        ("b1", "b", [0.6, 0.8], "tree search", 2010, "cs.LG", "abstract", 200),
        ("b2", "b", None, "tree", 2010, "cs.LG", "abstract", 200),
        ("c1", "c", [0.0, 0.0], None, None, None, None, None),
        ("c2", "c", [1.0], "pooling pooling", None, None, None, None),
    ]
    return spark.createDataFrame([("t", *r, T0) for r in recs], "title string, chunk_id string, paper_id string, embedding array<float>, chunk_text string, year int, primary_category string, chunk_type string, citation_count int, created_at timestamp")


def test_dense_and_filters(spark):
    ix = R.index_of(index(spark).unionByName(index(spark)))
    assert ix.entries.count() == 6
    assert [r.chunk_id for r in R.dense_topk(ix, [1.0, 0.0], 3).collect()] == ["a1", "b1", "a2"]
    some = R.dense_topk(ix, [1.0, 0.0], 9, R.filters(2005, 2015, ["cs.LG"], "abstract"))
    assert [r.chunk_id for r in some.collect()] == ["b1"]
    assert R.dense_topk(ix, [1.0, 0.0], 9, R.filters()).count() == 4


def test_alpha(spark):
    ix = R.index_of(index(spark))
    q = [1.0, 0.0]
    dense = [r.chunk_id for r in R.dense_topk(ix, q, 4).collect()]
    assert [r.chunk_id for r in R.hybrid_topk(ix, q, "graph", 4, alpha=1.0).collect()] == dense
    assert {r.chunk_id for r in R.hybrid_topk(ix, q, "graph", 2, alpha=0.0).collect()} == {"a1", "a2"}
    assert rows(R.hybrid_topk(ix, q, None, 4)) == rows(R.dense_topk(ix, q, 4))
    assert R.sparse_topk(ix, "?!", 5).count() == 0 and R.sparse_topk(ix, "nowhere", 5).count() == 0


def test_written_index_is_the_index(spark, tmp_path):
    made = R.index_of(index(spark))
    got = write_index(index(spark), str(tmp_path / "index"))
    for t in ("entries", "postings", "terms", "stats"):
        a, b = getattr(made, t).drop("tf"), getattr(got, t).drop("tf")
        assert a.columns == b.columns and rows(a.select(*[F.col(c).cast("string") for c in a.columns])) == rows(b.select(*[F.col(c).cast("string") for c in b.columns]))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        R.hybrid_topk(got, [1.0, 0.0], "graph", 3, where=R.filters(2005, 2015, ["cs.LG"])).explain("formatted")
    pushed = next(line for line in out.getvalue().split("\n") if line.startswith("PushedFilters"))
    assert all(x in pushed for x in ("(primary_category,", "GreaterThanOrEqual(year,2005)", "EqualTo(dim,2)")) and "Exchange" not in out.getvalue()
    path = str(tmp_path / "chunks.parquet")
    index(spark).write.parquet(path)
    first = stored_index(spark, path)
    assert first.entries.inputFiles() == stored_index(spark, path).entries.inputFiles()
    index(spark).write.mode("append").parquet(path)  # another state of the table: another index
    assert first.entries.inputFiles() != stored_index(spark, path).entries.inputFiles()


def test_rerank_keeps_hits_without_a_text(spark):
    hits = spark.createDataFrame([("c1", "c", 0.5), ("a1", "a", 0.4), ("zz", "z", 0.3)], "chunk_id string, paper_id string, score double")
    papers = spark.createDataFrame([("c", "pooling", None), ("z", None, None)], "id string, title string, abstract string")
    got = {r.chunk_id: r.rerank_score for r in R.rerank(hits, R.index_of(index(spark)), "pooling", papers).collect()}
    assert got == {"c1": 1.0, "a1": 1.0, "zz": 0.0}


def test_without_a_graph(spark):
    papers = spark.createDataFrame([("a", "t", None, 2000)], "id string, title string, abstract string, year int")
    e = Engine(R.index_of(index(spark)), papers, Offline(dim=2), use_graph=False)
    assert e.enrichment(papers.select("id")) == {}
    assert [k for _, k, _ in e.chat(ChatParams("graph pooling"))][0] == "sources"
    assert "no citation graph" in " ".join(p for _, _, p in e.chat(ChatParams("which author writes most")))


def test_blend():
    assert R.blend([1.0], [2.0]) == [0.4 + 1.2] and R.blend([1.0], None) == [1.0] and R.interpolate([0.0], [4.0], 0.25) == [1.0]
    assert R.over_fetch(5, True) == 20 and R.over_fetch(50, True) == 80 and R.over_fetch(5, False) == 10


def test_grouping(spark):
    hits = spark.createDataFrame([("a1", "a", 0.8, 0.0, 1), ("b1", "b", 0.1, 0.8, 2), ("a2", "a", 0.3, 0.4, 3)], "chunk_id string, paper_id string, score double, rerank_score double, rank int")
    got = R.group_papers(hits, 5).collect()
    assert [(r.paper_id, r.best_score, r.chunks) for r in got] == [("a", 0.8, "a1,a2"), ("b", 0.8, "b1")]  # 0.0 falls back; ties: first seen


def test_expansion(spark):
    hits = spark.createDataFrame([("a1", "a", 0.8, None, 1)], "chunk_id string, paper_id string, score double, rerank_score double, rank int")
    more = R.expand(R.group_papers(hits, 5), hits, R.index_of(index(spark)), [1.0, 0.0])
    assert rows(more, "chunk_id") == [("a2",)]


def test_engine(spark):
    s = "pdf_url string, id string, title string, abstract string, year int, citation_count int, primary_category string, categories array<string>, authors array<string>, references array<string>, cited_by array<string>, ingested_at timestamp"
    papers = spark.createDataFrame([("u", f"arxiv:{k}", k, "x", 2024, 9, "cs.AI", ["cs.AI"], ["n"], [], [], T0) for k in "abc"], s)
    ix = R.index_of(index(spark).withColumn("paper_id", F.concat(F.lit("arxiv:"), "paper_id")))
    e = Engine(ix, current_papers(papers), Offline(dim=2))
    assert e.search(SearchParams("graph pooling")).count() >= 1
    kinds = [k for _, k, _ in e.chat(ChatParams("graph pooling"))]
    assert kinds[0] == "sources" and kinds[-1] == "done"
    assert "cited 9" in " ".join(p for _, _, p in e.chat(ChatParams("what is trending")))
    assert {k: len(v.columns) for k, v in e.enrichment(papers.select("id")).items()} == {"related": 5, "foundational": 5, "experts": 3, "contexts": 4}


def test_router():
    assert unwrap('```json\n{"type": "gaps", "params": {"category": "cs.AI"}}\n```') == ("GAPS", {"category": "cs.AI"})
    assert unwrap("no json") == ("SEARCH", {}) and unwrap('{"type": "odd"}') == ("SEARCH", {})
    o = Offline()
    assert o.classify("from graphs to trees", [])[0] == "PATH" and o.classify("sparse encoders", [])[0] == "SEARCH"
    try:
        SearchParams("ab")
        raise AssertionError
    except ValueError:
        pass
