from conftest import rows

from citegrid import catalog
from citegrid.operators import papers as P
from citegrid.operators.chunking import chunk_papers, count, pack_paragraphs, pack_sentences

RAW = "id string, title string, abstract string, authors array<string>, year int, published string, categories array<string>, primary_category string, ingested_at int, extra string"
LONG = "word " * 20


def raw(spark, *recs):
    return spark.createDataFrame(list(recs), RAW)


def test_validation(spark):
    df = raw(
        spark,
        ("a", "     title     ", LONG, [" x ", " "], 2000, "2000-01-01", None, None, 0, "kept"),
        ("b", "short", LONG, ["x"], 2000, "p", None, None, 0, None),
        ("c", "long enough", " " * 60, ["x"], 2000, "p", None, None, 0, None),
        ("d", "long enough", LONG, [" ", None], 1980, None, None, None, 0, None),
        (None, None, None, None, None, None, None, None, None, None),
    )
    ok, bad = P.validate(df, 2026)
    got = ok.first()
    assert ok.count() == 1 and (got.title, got.authors, got.categories, got.extra) == ("title", ["x"], [], "kept")
    assert rows(bad.where("paper_id is not null")) == [("b", "title"), ("c", "abstract"), ("d", "authors,year,published")]
    assert bad.where("paper_id is null").first().error == "id,title,abstract,authors,year,published"


def test_dedup(spark):
    recs = [("arxiv:1v1", 0), ("arxiv:1v2", 2), ("arxiv:1v2", 1), ("arxiv:2", 5), ("arxiv:1", 0)]
    df = raw(spark, *[(i, None, None, None, None, None, None, None, t, None) for i, t in recs])
    once = P.dedup_latest(df)
    assert rows(once, "id", "ingested_at") == [("arxiv:1v2", 1), ("arxiv:2", 5)]
    assert rows(P.dedup_latest(once.drop("base_id")), "id") == rows(once, "id")
    assert rows(P.dedup_latest(df, keep_latest=False), "id") == [("arxiv:1",), ("arxiv:2",)]


def test_keywords(spark):
    df = raw(spark, ("a", "Graph pooling", "transformer transformer pooling helps. attention", [], 2000, "p", [], None, 0, None))
    assert P.keywords(df).first().keywords[:3] == ["transformer", "attention", "pooling"]


def test_enriched_text(spark):
    df = raw(spark, ("a", " Graph pooling ", "We propose pooling.", ["x", "y", "z", "w"], 2000, "p", ["cs.AI"], None, 0, None))
    lines = P.enriched_text(df).first().chunk_text.split("\n")
    assert lines[0] == "[Computer Science | 2000] Graph pooling" and lines[1] == "Authors: x, y, z (+1 more)" and lines[-1] == "pooling."


def test_upsert_and_enrichment(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(P.upsert(old, new, "k")) == [(1, "a"), (2, "c"), (3, "d")] == rows(P.upsert(P.upsert(old, new, "k"), new, "k"))
    assert rows(P.unseen(old, new, "k")) == [(3, "d")]
    s = "arxiv_id string, s2_id string, citation_count int, influential_citations int, references array<string>, cited_by array<string>"
    p = spark.createDataFrame([("1", None, 5, None, None, None), (None, None, 1, None, None, None)], s)
    c = spark.createDataFrame([("1", "z", 7, 1, ["2"], [])], s)
    assert {(r.arxiv_id, r.s2_id, r.citation_count) for r in P.enrich_citations(p, c).collect()} == {("1", "z", 7), (None, None, 1)}


def test_sentence_packing():
    text = "One two three. Four five six. Seven eight nine."
    got = list(pack_sentences(text, 9, 1))
    assert got == ["One two three. Four five six.", "Four five six. Seven eight nine."]  # the last sentence is taken over
    assert list(pack_sentences("x" * 100, 0, 1))[0] == ""
    assert list(pack_paragraphs("a b c", 10, 100, 5)) == ["a b c"]  # what fits whole is kept however short
    long = "\n\n".join(f"Word {i} is here. It ends there." for i in range(30))
    parts = list(pack_paragraphs(long, 40, 5, 5))
    assert len(parts) > 3 and all(count(p) <= 50 for p in parts)


def test_chunks(spark):
    papers = raw(spark, ("p", "T", LONG * 10, [], 2001, "p", ["cs.AI"], None, 0, None), ("q", "T", LONG, [], 2001, "p", ["cs.AI"], None, 0, None))
    parsed = spark.createDataFrame(
        [("p", None, [("Method", LONG * 10), ("Related Work", LONG * 10), (None, None), ("Results", "\n\n".join([f"Sentence {i}. " * 50 for i in range(10)])), ("", "tiny")]), ("r", None, [])],
        "paper_id string, abstract_text string, sections array<struct<heading:string,text:string>>",
    )
    got = chunk_papers(papers, parsed)
    ids = [r.chunk_id for r in got.collect()]
    assert "p_abstract" in ids and "p_s0_c0" in ids and not any("_s1_" in i for i in ids) and sum("_s3_" in i for i in ids) > 1
    assert len(set(ids)) == len(ids)
    assert got.where("chunk_id = 'p_s0_c0'").first().chunk_text.startswith("[Computer Science | 2001] T\nSection: Method\nword")


def test_metadata(spark):
    chunks = spark.createDataFrame([("c", "p", "A Survey of x", None, "cs.AI", 3, None, "full", "t" * 900, None, None)], "chunk_id string, paper_id string, title string, year int, primary_category string, citation_count int, published string, chunk_type string, chunk_text string, section_heading string, is_fulltext boolean")
    papers = spark.createDataFrame([("p", "see GitHub", ["a"] * 12, ["cs.AI"], None, None, 120)], "id string, abstract string, authors array<string>, categories array<string>, pdf_url string, source string, citation_count int")
    r = P.metadata(chunks, papers).first()
    assert (r.has_code, r.is_survey, r.citation_tier, r.author_count, len(r.snippet), r.year, r.source) == (True, True, "high", 12, 800, 0, "arxiv")
    assert r.authors == ", ".join(["a"] * 10)


def test_full_texts_under_versions(spark):
    papers = raw(spark, ("arxiv:1", "T", LONG, [], 2001, "p", ["cs.AI"], None, 0, None), ("arxiv:2v3", "T", LONG, [], 2001, "p", ["cs.AI"], None, 0, None))
    texts = [("arxiv:1v2", "old "), ("arxiv:1v10", "new "), ("ARXIV:1", "bare "), ("arxiv:2", "two ")]
    parsed = spark.createDataFrame([(i, None, [("Method", w * 120)]) for i, w in texts], "paper_id string, abstract_text string, sections array<struct<heading:string,text:string>>")
    got = {r.chunk_id: r.chunk_text.split("\n")[-1][:4] for r in chunk_papers(papers, parsed).collect()}
    assert got == {"arxiv:1_s0_c0": "new ", "arxiv:2v3_s0_c0": "two "}  # one text per paper, of the highest version


def test_queries_meet_versions(spark, tmp_path):
    papers = raw(spark, *[(i, "T", LONG, [], 2001, "p", ["cs.AI"], None, 0, None) for i in ("arxiv:1v2", "arxiv:2", "arxiv:3")])
    papers = papers.selectExpr("*", "0 as citation_count", "if(id = 'arxiv:1v2', array('arxiv:2'), array()) as references", "cast(array() as array<string>) as cited_by")
    papers.write.parquet(f"{tmp_path}/papers.parquet")
    parsed = [("arxiv:1v2", None, [("Method", "word " * 120)]), ("arxiv:2v1", None, [("Method", "word " * 120)])]
    spark.createDataFrame(parsed, "paper_id string, abstract_text string, sections array<struct<heading:string,text:string>>").write.parquet(f"{tmp_path}/parsed_papers.parquet")
    vec = lambda x: [float(x), 1.0] + [0.0] * 94
    recs = [("a", "arxiv:1v2", vec(9)), ("b", "arxiv:1", vec(8)), ("z", "arxiv:2v1", vec(-9))]
    chunks = spark.createDataFrame([(*r, "stable gradient", True, 1) for r in recs], "chunk_id string, paper_id string, embedding array<float>, chunk_text string, is_fulltext boolean, citation_count int")
    chunks.selectExpr("*", "timestamp'2020-01-01' as created_at", "2001 as year", "'cs.AI' as primary_category", "'full' as chunk_type").write.parquet(f"{tmp_path}/chunks.parquet")
    run = lambda q: catalog.QUERIES[q](spark, str(tmp_path))
    assert rows(run("unparsed_papers")) == [("arxiv:3",)]
    assert rows(run("chunk_sections"), "paper_id") == [("arxiv:1",), ("arxiv:2",)] and rows(run("chunk_statistics"), "papers") == [(2,)]
    assert rows(run("search_papers"), "paper_id", "n_chunks") == [("arxiv:1", 2), ("arxiv:2", 1)]
    assert rows(run("learning_path"), "paper_id", "has_citation_link") == [("arxiv:1", True), ("arxiv:2", False)]


def test_no_text_is_lost():
    words = [f"w{i}" for i in range(1000)]
    parts = list(pack_sentences(" ".join(words), 90, 50))
    assert " ".join(parts).split() == words and all(count(p) <= 90 for p in parts)
    tail = list(pack_sentences("A b c d. E f g h. I j.", 10, 8))
    assert tail == ["A b c d. E f g h.", "E f g h. I j."]
    assert list(pack_sentences("A b. C d. E f. G h.", 10, 8)) == ["A b. C d. E f.", "C d. E f. G h."]  # a short last piece takes over more
    text = "\n\n".join([" ".join(words[:95]), "the end"])
    assert " ".join(pack_paragraphs(text, 90, 50, 5)).split() == [*words[:95], "the", "end"]
    assert " ".join(pack_sentences(" ".join(words), -3, 50)).split() == words
