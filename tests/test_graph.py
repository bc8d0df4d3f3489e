import datetime
import random

import pytest
from conftest import rows

from citegrid.operators.graph import Graph
from citegrid.operators.papers import current_papers

T0 = datetime.datetime(2020, 1, 1)
SCHEMA = "id string, title string, year int, citation_count int, primary_category string, categories array<string>, authors array<string>, references array<string>, cited_by array<string>, ingested_at timestamp"


def build(spark, cites, known="ABCDXYZ", authors=None):
    refs = {}
    for a, b in cites:
        refs.setdefault(a.lower(), []).append(b)
    recs = [(f"arxiv:{k.lower()}", k, 2000 + i, i + 1, "cs.AI", ["cs.AI"], (authors or {}).get(k, []), refs.get(k.lower()), None, T0) for i, k in enumerate(known)]
    return Graph(current_papers(spark.createDataFrame(recs, SCHEMA)))


def ids(spark, *names):
    return spark.createDataFrame([(f"arxiv:{n}",) for n in names], "id string")


def test_path(spark):
    g = build(spark, ["ab", "bc", "xy"])
    assert g.path("arxiv:a", "arxiv:c") == ["arxiv:a", "arxiv:b", "arxiv:c"]
    assert g.path("arxiv:a", "arxiv:z") == [] and g.path("arxiv:a", "arxiv:a") == []
    assert build(spark, ["ab", "bc", "cd", "dx", "xy"]).path("arxiv:a", "arxiv:y") == []  # five steps


def test_lineage_diamond_and_cycles(spark):
    g = build(spark, ["ab", "bc", "ac"])
    assert rows(g.lineage("arxiv:a"), "id", "depth") == [("arxiv:b", 1), ("arxiv:c", 1), ("arxiv:c", 2)]
    g = build(spark, ["ab", "ba", "aa"])
    assert ("arxiv:a", 3) in rows(g.lineage("arxiv:a"), "id", "depth")
    assert max(r.depth for r in build(spark, ["aa"]).lineage("arxiv:a").collect()) == 1  # no citation twice


def test_reciprocal_citations_count_twice_in_expertise(spark):
    g = build(spark, ["ab", "ba"], authors={"B": ["w"], "A": ["w"]})
    r = g.expertise(ids(spark, "a")).first()
    assert (r.name, r.papers_in_cluster, r.total_citations) == ("w", 2, 1 + 2 * 2)


def test_stubs_and_neighbours(spark):
    g = build(spark, ["an", "ab", "cb", "ax", "cx"])
    assert g.papers.where("id = 'arxiv:n'").first().title is None
    assert rows(g.connected(ids(spark, "a", "c")), "id", "shared") == [("arxiv:b", 2), ("arxiv:x", 2)]
    assert [r.id for r in g.common_ancestors(ids(spark, "a", "c")).collect()] == ["arxiv:x", "arxiv:b"]
    assert [r.id for r in g.reading_list(ids(spark, "a")).collect()] == ["arxiv:a", "arxiv:b", "arxiv:c", "arxiv:x"]


def test_coauthors_and_context(spark):
    g = build(spark, ["ab"], authors={"A": ["u", " v ", "v", ""], "B": ["u", "v"], "C": ["lone"]})
    assert rows(g.coauthored()) == [("u", "v", 2)]
    assert [(r.collaborator, r.papers_together, r.own_papers) for r in g.network("u").collect()] == [("v", 2, 2)]
    assert {r.item for r in g.context("arxiv:c").where("part = 'author'").collect()} == set()  # no other cited paper: the author goes
    assert {r.item for r in g.context("arxiv:a").where("part = 'author'").collect()} == {"u", "v"}
    stats = {r.what: r.n for r in g.stats().collect()}
    assert stats["coauthor_links"] == 2 and stats["citations"] == 1


@pytest.mark.parametrize("field", [None, "Computer Science"])
def test_empty_graph(spark, field):
    g = Graph(current_papers(spark.createDataFrame([], SCHEMA)))
    assert g.trending(field).count() == 0 and g.path("a", "b") == [] and g.lineage("a").count() == 0 and g.gaps("cs.AI").count() == 0


def test_all_authors_on_request(spark):
    names = [f"n{i:02d}" for i in range(25)]
    df = current_papers(spark.createDataFrame([("arxiv:1", names)], "id string, authors array<string>").selectExpr("*", "'t' as title", "2000 as year", "0 as citation_count", "'cs.AI' as primary_category", "transform(authors, x -> concat('c', x)) as categories", "cast(array() as array<string>) as references", "cast(array() as array<string>) as cited_by", "timestamp'2020-01-01' as ingested_at"))
    g, every = Graph(df), Graph(df, authors=None, categories=None)
    assert (g.authored.count(), g.in_category.count(), g.coauthored().count()) == (20, 10, 190)
    assert (every.authored.count(), every.in_category.count(), every.coauthored().count()) == (25, 25, 300)


def test_paths_against_brute_force(spark):
    rng = random.Random(8)
    names = "abcdefghijklmn"
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(17)}
    g = build(spark, [a + b for a, b in edges], known=names.upper())
    near = {n: sorted({b for a, b in edges if a == n} | {a for a, b in edges if b == n}) for n in names}

    def brute(s, t):
        front = [[s]]
        for _ in range(4):
            front = [w + [n] for w in front for n in near[w[-1]] if n not in w]
            hit = sorted(w for w in front if w[-1] == t)
            if hit:
                return hit[0]
        return []

    pairs = [(a, b) for a in "abc" for b in "defgk"]
    got = {p: [x.removeprefix("arxiv:") for x in g.path(f"arxiv:{p[0]}", f"arxiv:{p[1]}")] for p in pairs}
    assert got == {p: brute(*p) for p in pairs} and {len(w) for w in got.values()} >= {0, 3}


def test_lineage_equals_the_ways(spark):
    rng = random.Random(9)
    for n, m in ((3, 7), (4, 9), (6, 14)):
        names = "abcdef"[:n]
        edges = {(rng.choice(names), rng.choice(names)) for _ in range(m)} | {("a", "b"), ("b", "a"), ("a", "a")}
        g = build(spark, [a + b for a, b in edges], known=names.upper())
        e = g.cites.selectExpr("src as from", "dst as to")
        for d in (1, 2, 3):
            ways = [x for level in g._trails(e, "arxiv:a", d) for x in rows(level.distinct())]
            assert sorted(x for level in g._levels(e, "arxiv:a", d) for x in rows(level)) == sorted(ways), (edges, d)
    assert g.lineage("arxiv:a", 4).count() > 0
