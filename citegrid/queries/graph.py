"""Queries of the citation graph. Seeds are the ten papers with the most references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.papers import current_papers
from ..session import table
from .sql import GRAPH

FIELD, CATEGORY, OTHER = "Computer Science", "cs.LG", "cs.AI"


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(current_papers(table(spark, d, "papers")))


def seeds(g: Graph, n: int = 10) -> DataFrame:
    return g.cites.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


def one(g: Graph) -> str:
    row = seeds(g, 1).first()
    return row["id"] if row else ""


def most_cited(g: Graph) -> str:
    row = g.cites.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    return row["dst"] if row else ""


def around(method: str, *args):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = graph(spark, d)
        return getattr(g, method)(seeds(g), *args)

    return run


def plain(method: str, *args):
    return lambda spark, d: getattr(graph(spark, d), method)(*args)


def of_one(method: str, **kw):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = graph(spark, d)
        return getattr(g, method)(one(g), **kw)

    return run


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).papers


def author_network(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    row = g.authored.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").first()
    return g.network(row["name"] if row else "")


def citation_path(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    ends = [r["id"] for r in seeds(g).collect()]  # ten seeds
    way = g.path(ends[0], ends[-1]) if ends else []
    return spark.createDataFrame(list(enumerate(way)), "pos int, id string")


def lineage_text(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.context import lineage_text as text

    g = graph(spark, d)
    return text(g.lineage(one(g)))


def trending_text(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.context import trending_text as text

    return text(graph(spark, d).trending(min_year=2015))


def degree_rank(spark: SparkSession, d: str) -> DataFrame:
    """The most cited known papers of each field by references in the collection."""
    g = graph(spark, d)
    n = g.cites.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("cited"))
    w = W.partitionBy("field").orderBy(F.desc("cited"), "id")
    return n.join(g.known, "id").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 3).select("field", "pos", "id", "cited")


QUERIES = {
    "graph_stats": plain("stats"),
    "graph_vertices": vertices,
    "graph_cites": lambda s, d: graph(s, d).cites,
    "graph_authored": lambda s, d: graph(s, d).authored,
    "graph_in_category": lambda s, d: graph(s, d).in_category,
    "coauthor_pairs": lambda s, d: graph(s, d).coauthored(),
    "connected_papers": around("connected", 10),
    "common_ancestors": around("common_ancestors", 5),
    "author_expertise": around("expertise", 10),
    "reading_list": around("reading_list", 10),
    "paper_context": of_one("context"),
    "paper_citations": of_one("citations"),
    "lineage_ancestors": of_one("lineage"),
    "lineage_descendants": lambda s, d: (lambda g: g.lineage(most_cited(g), forward=False))(graph(s, d)),
    "citation_path": citation_path,
    "author_network": author_network,
    "top_authors": plain("top_authors", FIELD),
    "influential_papers": plain("influential"),
    "influential_in_field": plain("influential", FIELD),
    "trending_papers": plain("trending", None, 2015),
    "trending_in_field": plain("trending", FIELD, 2015),
    "field_bridges": plain("bridges", CATEGORY, OTHER),
    "research_gaps": plain("gaps", CATEGORY, 5, 2018, 2020, 2),
    "degree_rank": degree_rank,
    "lineage_text": lineage_text,
    "trending_text": trending_text,
}

_CITED = "select id, title, year, citation_count, field from known where {0} order by citation_count desc, id limit {1}"


def _walk(a: str, b: str, order: str, begin: str = "seed") -> str:
    return f""",
    w as (select {b} as here, [src || '>' || dst] as used, 1 as depth from cites where {a} = (select id from {begin})
          union all select c.{b}, list_append(used, c.src || '>' || c.dst), depth + 1 from w join cites c on c.{a} = w.here
          where depth < 3 and not list_contains(used, c.src || '>' || c.dst)),
    lin as (select id, title, year, citation_count, depth from (select distinct here, depth from w) x join titled on id = here order by depth, {order} desc nulls last, id limit 15)"""


_ANCESTORS = _walk("src", "dst", "citation_count")
ORACLES = {
    "graph_stats": GRAPH
    + """ select 'papers' as what, count(*) as n from nodes union all select 'authors', count(distinct name) from authored
          union all select 'categories', count(distinct category) from in_cat union all select 'citations', count(*) from cites
          union all select 'coauthor_links', 2 * count(*) from coauthored""",
    "graph_vertices": GRAPH + " select * from nodes",
    "graph_cites": GRAPH + " select src, dst from cites",
    "graph_authored": GRAPH + " select paper, name from authored",
    "graph_in_category": GRAPH + " select paper, category from in_cat",
    "coauthor_pairs": GRAPH + " select a, b, papers from coauthored",
    "connected_papers": GRAPH
    + """ select n.dst as id, any_value(title) as title, any_value(year) as year, any_value(citation_count) as citation_count, count(distinct n.src) as shared
          from near n join titled t on t.id = n.dst where n.src in (from seeds) and n.dst not in (from seeds) and citation_count > 0
          group by n.dst order by shared desc, citation_count desc, id limit 10""",
    "common_ancestors": GRAPH
    + """ select dst as id, any_value(title) as title, any_value(year) as year, any_value(citation_count) as citation_count, count(distinct src) as cited_by_count
          from cites join titled t on t.id = dst where src in (from seeds) group by dst having count(distinct src) >= 2
          order by cited_by_count desc, citation_count desc, id limit 5""",
    "author_expertise": GRAPH
    + """, r as (select id from seeds union all select dst from near where src in (from seeds))
          select name, count(distinct r.id) as papers_in_cluster, coalesce(sum(citation_count), 0)::bigint as total_citations
          from r join authored a on a.paper = r.id join nodes n on n.id = r.id group by name having count(distinct r.id) >= 2
          order by papers_in_cluster desc, total_citations desc, name limit 10""",
    "reading_list": GRAPH
    + """, h1 as (select distinct dst as id from near where src in (from seeds)), h2 as (select distinct dst as id from near where src in (from h1)),
          r as (select id from seeds union select id from h1 union select id from h2)
          select id, title, year, citation_count from titled where id in (from r) order by year nulls last, citation_count desc nulls first, id limit 10""",
    "paper_context": GRAPH
    + """, r as (select dst as item, title as detail from cites join titled on id = dst where src = (from seed) order by 1 limit 5),
          c as (select src as item, title as detail from cites join titled on id = src where dst = (from seed) order by 1 limit 5),
          o as (select a.name, k.id, row_number() over (partition by a.name order by citation_count desc, k.id) as r
                from authored a join known k on k.id = a.paper where citation_count > 0 and a.paper <> (from seed)
                and a.name in (select name from authored where paper = (from seed))),
          w as (select name as item, string_agg(id, ',' order by r) as detail from o where r <= 3 group by name order by 1 limit 5)
          select 'reference' as part, row_number() over (order by item) as pos, item, detail from r
          union all select 'citer', row_number() over (order by item), item, detail from c
          union all select 'author', row_number() over (order by item), item, detail from w""",
    "paper_citations": GRAPH
    + """ select 'reference' as direction, id, title, year from cites join nodes on id = dst where src = (from seed)
          union all select 'citer', id, title, year from cites join nodes on id = src where dst = (from seed)""",
    "lineage_ancestors": GRAPH + _ANCESTORS + " select * from lin",
    "lineage_descendants": GRAPH + _walk("dst", "src", "year", "cited") + " select * from lin",
    "citation_path": GRAPH
    + """, e as (select distinct src, dst from near), goal as (select id from seeds where id = (select src from cites group by src order by count(*) desc, src limit 1 offset (select count(*) - 1 from seeds))),
          w as (select id as here, [id] as way, 0 as d from seed union all
                select e.dst, list_append(way, e.dst), d + 1 from w join e on e.src = w.here where d < 4 and not list_contains(way, e.dst) and w.here <> (from goal)),
          best as (select way from w where here = (from goal) and d > 0 order by d, way limit 1)
          select (i - 1)::int as pos, way[i] as id from (select way, unnest(range(1, len(way) + 1)) as i from best)""",
    "author_network": GRAPH
    + """, me as (select name, count(*) as own from authored group by name order by own desc, name limit 1),
          c as (select a as x, b as y, papers from coauthored union all select b, a, papers from coauthored)
          select x as author, y as collaborator, papers as papers_together, own as own_papers from c join me on x = name
          order by papers desc, y limit 20""",
    "top_authors": GRAPH
    + f""" select name, count(*) as papers, coalesce(sum(citation_count), 0)::bigint as citations from authored join known on id = paper
          where field = '{FIELD}' group by name order by citations desc, papers desc, name limit 20""",
    "influential_papers": GRAPH + _CITED.format("citation_count > 0", 20),
    "influential_in_field": GRAPH + _CITED.format(f"citation_count > 0 and field = '{FIELD}'", 20),
    "trending_papers": GRAPH + _CITED.format("year >= 2015 and citation_count > 5", 10),
    "trending_in_field": GRAPH + _CITED.format(f"year >= 2015 and citation_count > 5 and field = '{FIELD}'", 10),
    "field_bridges": GRAPH
    + f""" select id, title, year, citation_count from titled where id in (select paper from in_cat where category = '{CATEGORY}')
          and id in (select paper from in_cat where category = '{OTHER}') order by citation_count desc nulls last, id limit 10""",
    "research_gaps": GRAPH
    + f""" select k.id, any_value(k.title) as title, any_value(k.year) as year, any_value(k.citation_count) as citation_count, count(s.id) as recent_citations
          from known k join in_cat on paper = k.id and category = '{CATEGORY}' left join cites c on c.dst = k.id left join known s on s.id = c.src and s.year >= 2020
          where k.citation_count >= 5 and k.year <= 2018 group by k.id having count(s.id) <= 2 order by citation_count desc, id limit 10""",
    "degree_rank": GRAPH
    + """ select field, row_number() over (partition by field order by cited desc, id) as pos, id, cited
          from (select dst as id, count(*) as cited from cites group by dst) join known using (id) qualify pos <= 3""",
    "lineage_text": GRAPH
    + _ANCESTORS
    + " select coalesce(string_agg(repeat('  ', depth) || '- ' || coalesce(title, ''), chr(10) order by depth, citation_count desc, id), '') as text from lin",
    "trending_text": GRAPH
    + f""", t as ({_CITED.format("year >= 2015 and citation_count > 5", 10)})
          select coalesce(string_agg('- ' || coalesce(title, '') || ' (' || year || '), cited ' || citation_count, chr(10) order by citation_count desc, id), '') as text from t""",
}
