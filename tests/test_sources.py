import json

import pytest
from conftest import rows
from oracle import check
from pyspark.sql import functions as F

from citegrid import catalog
from citegrid.plans.ingest import build_graph, ingest_abstracts
from citegrid.sources import records as S
from citegrid.sources import sinks
from citegrid.sources.categories import PRESETS, preset

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title type="main">A  title</title><abstract><p>Short.</p></abstract></teiHeader>
<text><body><div><head>Intro</head><p>We use <ref>this</ref> and more.</p><div><head>Sub</head><p>Inner.</p></div></div><div><head>Empty</head></div></body></text></TEI>"""


def test_json_files(spark, tmp_path):
    for name, recs in {"a": [{"id": "1", "year": 2000}, {"id": "2"}], "b": [{"id": "3"}, {"id": "1"}]}.items():
        (tmp_path / f"arxiv_{name}.json").write_text(json.dumps(recs))
    (tmp_path / "arxiv_c.json").write_text("{broken")
    df = S.read_raw(spark, str(tmp_path / "arxiv_*.json"))
    assert df.count() == 4
    assert S.head_per_file(df, 1, "id").count() == 2


def test_ids_and_failures(spark, tmp_path):
    (tmp_path / "ids").write_text("a\n\n b \na\n")
    assert rows(S.read_ids(spark, str(tmp_path / "ids"))) == [("a",), ("b",)]
    (tmp_path / "log").write_text('{"paper_id": "p", "error": "e"}\n{oops\n')
    assert rows(S.read_failures(spark, str(tmp_path / "log")), "paper_id", "error") == [("p", "e")]


def test_citation_records(spark):
    peer = lambda x: {"paperId": "z", "externalIds": None if x is None else {"ArXiv": x}}
    df = spark.createDataFrame([("s", {"ArXiv": "1"}, 3, 1, [peer("2"), peer(None), None], None), (None, None, None, None, None, None)], S.CITATION)
    r = S.citation_record(df).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].cited_by, r[0].references) == ("1", ["2"], [])


def test_tei(spark):
    got = S.parse_tei(TEI)
    assert got == {"grobid_title": "A title", "abstract_text": "Short.", "sections": [{"heading": "Intro", "text": "We use this and more.\n\nInner."}]}
    df = spark.createDataFrame([("p", TEI), ("q", "<broken"), ("r", None)], "paper_id string, xml string")
    assert rows(S.parsed_papers(df), "paper_id") == [("p",)]


def test_scan(spark):
    df = spark.createDataFrame([("1", "2020-01-01", ["x", "y"]), ("2", "2021-01-01", ["y"]), ("3", "2019-01-01", ["z"])], "id string, published string, categories array<string>")
    assert rows(S.scan(df, ["y", "x"]), "id") == [("1",), ("2",)]
    assert rows(S.scan(df, ["y"], most=1), "id") == [("2",)] and rows(S.scan(df, ["y"], end="2020-06-01"), "id") == [("1",)]
    assert rows(S.recent(df, 200, F.to_date(F.lit("2021-03-01"))), "id") == [("2",)]


def test_feed(spark):
    import datetime

    df = spark.createDataFrame([("http://x/abs/2301.1v2", "t", "a\nb", ["n"], datetime.datetime(2023, 1, 2), ["cs.AI"], "u")], "url string, title string, summary string, authors array<string>, published timestamp, categories array<string>, pdf_url string")
    r = S.feed_record(df).first()
    assert (r.id, r.abstract, r.published, r.year, r.primary_category) == ("arxiv:2301.1", "a b", "2023-01-02", 2023, "cs.AI")


def test_presets():
    assert len(preset("cs-all")) == 38 and len(PRESETS) == 13 and len(preset("comprehensive")) == 38 + 4 + 6 + 4 + 10 + 3 + 3 + 3


def test_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 2000)
    (tmp_path / "b.pdf").write_bytes(b"x" * 10)
    assert S.read_pdfs(spark, str(tmp_path / "*.pdf")).count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    sinks.append_new(df, path, "k")
    sinks.append_new(df, path, "k")
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]
    sinks.clear(spark, path)
    assert not sinks.exists(spark, path)
    chunks = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [])], "chunk_id string, embedding array<float>")
    assert tuple(sinks.upsert_report(chunks, chunks.where("chunk_id = 'a'")).first()) == (0, 1, 2)


def test_live_source(spark):
    def fetch(category, options):
        yield (f"arxiv:{category}", category, None, None, None, None, None, 2000, None, None, None, None, None)

    spark.dataSource.register(S.live_source("fake_live", fetch))
    assert rows(spark.read.format("fake_live").option("categories", "x,y").load(), "arxiv_id") == [("x",), ("y",)]


def test_bounds_reach_the_live_source(spark):
    def fetch(category, options):
        for day in ("2020-01-01", "2021-01-01", "2022-01-01"):
            yield (f"arxiv:{day}", options.get("start"), options.get("end"), None, None, day, None, 2000, None, category, None, None, None)

    spark.dataSource.register(S.live_source("bounded_live", fetch))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("bounded_live").option("categories", "x").load().where("published >= '2021-01-01' and published <= '2021-12-31'")
    assert rows(df, "id", "arxiv_id", "title") == [("arxiv:2021-01-01", "2021-01-01", "2021-12-31")]


def test_live_source_without_pushdown(spark):
    def fetch(category, options):
        for day in ("2020-01-01", "2021-01-01", "2022-01-01"):
            yield (f"arxiv:{day}", options.get("start"), options.get("end"), None, None, day, None, 2000, None, category, None, None, None)

    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        spark.dataSource.register(S.live_source("either_live", fetch))
        read = lambda: spark.read.format("either_live").option("categories", "x").load()
        assert read().count() == 3
        assert rows(read().where("published >= '2021-01-01' and published <= '2021-12-31'"), "id", "arxiv_id", "title") == [("arxiv:2021-01-01", None, None)]
        spark.conf.set(key, "true")
        assert rows(read().where("published >= '2021-01-01' and published <= '2021-12-31'"), "id", "arxiv_id", "title") == [("arxiv:2021-01-01", "2021-01-01", "2021-12-31")]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("pushdown", ["false", "true"])
def test_live_scan_equals_sql_with_either_setting(spark, sf, pushdown):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, pushdown)
        check(spark, sf, catalog.QUERIES["live_scan"], catalog.ORACLES["live_scan"])
    finally:
        spark.conf.set(key, before)


def test_ingest(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/papers.parquet")
    a = {r.what: r.n for r in ingest_abstracts(raw, str(tmp_path), 2026).collect()}
    b = spark.read.parquet(str(tmp_path / "abstracts")).count()
    ingest_abstracts(raw, str(tmp_path), 2026)
    assert a["chunks"] == b == spark.read.parquet(str(tmp_path / "abstracts")).count()
    assert build_graph(raw, str(tmp_path)).count() == 5 and spark.read.parquet(str(tmp_path / "cites")).count() > 0
