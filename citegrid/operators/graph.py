"""The citation and co-authorship graph as vertex and edge tables, and the questions asked of it.

Vertices: papers(id, title, year, citation_count, field), stubs have only an id. Edges: cites(src, dst), authored(paper, name),
in_category(paper, category), coauthored(a, b, papers). Neighbourhoods are equi-joins from a small set of seeds outwards; ids are the
last sort key everywhere, so that ties come out alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .orphans import bare_id


class Graph:
    """papers: one row per id (operators.papers.current_papers). Of a paper the first `authors` and `categories` enter the graph, all of
    them with None."""

    def __init__(self, papers: DataFrame, authors: int | None = 20, categories: int | None = 10):
        self.records = papers
        first = lambda f, n: F.col(f) if n is None else F.slice(f, 1, n)
        ref = lambda c: F.concat(F.lit("arxiv:"), bare_id(c))
        named = lambda f: F.explode(F.array_distinct(F.transform(F.filter(F.col(f), lambda x: x.rlike(r"\S")), ref)))
        out = papers.select(F.col("id").alias("src"), named("references").alias("dst"))
        back = papers.select(named("cited_by").alias("src"), F.col("id").alias("dst"))
        self.cites = out.unionByName(back).distinct()
        field = T.field_of(F.coalesce(F.get(F.col("categories"), F.lit(0)), F.col("primary_category")))
        known = papers.select("id", "title", F.col("year").cast("int").alias("year"), F.col("citation_count").cast("int").alias("citation_count"), field.alias("field"))
        ends = self.cites.select(F.col("src").alias("id")).unionByName(self.cites.select(F.col("dst").alias("id"))).distinct()
        self.known = known
        self.papers = ends.join(known, "id", "full")
        names = F.explode(F.array_distinct(F.filter(F.transform(first("authors", authors), T.strip), lambda x: x.isNotNull() & (x != ""))))
        self.authored = papers.select(F.col("id").alias("paper"), names.alias("name"))
        self.in_category = papers.select(F.col("id").alias("paper"), F.explode(F.array_distinct(F.filter(first("categories", categories), lambda x: x.isNotNull()))).alias("category"))

    def coauthored(self) -> DataFrame:
        a, b = self.authored.select("paper", F.col("name").alias("a")), self.authored.select("paper", F.col("name").alias("b"))
        return a.join(b, "paper").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("papers"))

    def near(self) -> DataFrame:
        """Edges in both directions, once for each edge and direction."""
        return self.cites.select("src", "dst").unionByName(self.cites.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def titled(self) -> DataFrame:
        return self.known.where(F.col("title").isNotNull())

    # ------------------------------------------------------------ counts

    def stats(self) -> DataFrame:
        """Counts of vertices and edges; each pair of co-authors counts once from either side."""
        one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        return (
            one(self.papers, "papers")
            .unionByName(one(self.authored.select("name").distinct(), "authors"))
            .unionByName(one(self.in_category.select("category").distinct(), "categories"))
            .unionByName(one(self.cites, "citations"))
            .unionByName(one(self.coauthored(), "coauthor_links").select("what", (F.col("n") * 2).alias("n")))
        )

    # ------------------------------------------------------------ around a set of papers

    def connected(self, ids: DataFrame, most: int = 10) -> DataFrame:
        """Neighbours outside the set that are cited at all, by the number of seeds they touch."""
        hop = self.near().join(ids.select(F.col("id").alias("src")), "src").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        shared = hop.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("shared"))
        got = shared.join(self.titled().where(F.col("citation_count") > 0), "id").select("id", "title", "year", "citation_count", "shared")
        return got.orderBy(F.desc("shared"), F.desc("citation_count"), "id").limit(most)

    def common_ancestors(self, ids: DataFrame, most: int = 5) -> DataFrame:
        """Papers that at least two of the set cite."""
        cited = self.cites.join(ids.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("cited_by_count"))
        got = cited.where(F.col("cited_by_count") >= 2).join(self.titled(), "id").select("id", "title", "year", "citation_count", "cited_by_count")
        return got.orderBy(F.desc("cited_by_count"), F.desc("citation_count"), "id").limit(most)

    def expertise(self, ids: DataFrame, most: int = 10) -> DataFrame:
        """Authors of the set and its neighbours. Citations sum over paths, so a paper reached twice counts twice; papers count once."""
        seeds = ids.select("id")
        paths = seeds.unionByName(self.near().join(seeds.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")))
        rows = paths.groupBy("id").agg(F.count("*").alias("paths")).join(self.papers.select("id", "citation_count"), "id")
        by = self.authored.join(rows, F.col("paper") == F.col("id")).groupBy("name")
        got = by.agg(F.count("*").alias("papers_in_cluster"), F.coalesce(F.sum(F.col("paths") * F.col("citation_count")), F.lit(0)).alias("total_citations"))
        return got.where(F.col("papers_in_cluster") >= 2).orderBy(F.desc("papers_in_cluster"), F.desc("total_citations"), "name").limit(most)

    def reading_list(self, ids: DataFrame, most: int = 10) -> DataFrame:
        """The set and what is one or two steps from it, oldest first."""
        e = self.near().distinct()
        seeds = ids.select("id")
        one = e.join(seeds.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        e2 = e.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
        two = e2.join(one.withColumnRenamed("id", "s2"), "s2").select(F.col("d2").alias("id")).distinct()
        every = seeds.unionByName(one).unionByName(two).distinct().join(self.titled(), "id")
        return every.select("id", "title", "year", "citation_count").orderBy(F.col("year").asc_nulls_last(), F.col("citation_count").desc_nulls_first(), "id").limit(most)

    # ------------------------------------------------------------ around one paper

    def context(self, paper: str, most: int = 5) -> DataFrame:
        """(part, pos, item, detail): references, citers, and authors with others of their cited papers."""
        one = F.lit(paper)
        titles = self.titled().select("id", "title")

        def first(df: DataFrame, part: str, n: int) -> DataFrame:
            return df.orderBy("item").limit(n).withColumn("pos", F.row_number().over(W.partitionBy().orderBy("item"))).select(F.lit(part).alias("part"), "pos", "item", "detail")

        refs = self.cites.where(F.col("src") == one).join(titles, F.col("dst") == F.col("id")).select(F.col("id").alias("item"), F.col("title").alias("detail"))
        citers = self.cites.where(F.col("dst") == one).join(titles, F.col("src") == F.col("id")).select(F.col("id").alias("item"), F.col("title").alias("detail"))
        own = self.authored.where(F.col("paper") == one).select("name")
        other = self.authored.join(own, "name").where(F.col("paper") != one).join(self.known.where(F.col("citation_count") > 0), F.col("paper") == F.col("id"))
        w = W.partitionBy("name").orderBy(F.desc("citation_count"), "id")
        top = other.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3)
        works = top.groupBy(F.col("name").alias("item")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("detail"))
        return first(refs, "reference", most).unionByName(first(citers, "citer", most)).unionByName(first(works, "author", most))

    def contexts(self, ids: DataFrame, refs: int = 3, citers: int = 3, authors: int = 2, works: int = 2, width: int = 50) -> DataFrame:
        """(id, part, pos, text) for each of a few ids: titles of references and citers, and of each author's other cited papers."""
        titles = self.titled().select(F.col("id").alias("other"), "title", "citation_count")
        a = ids.select(F.col("id").alias("src"))
        out = self.cites.join(a, "src").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("reference").alias("part"))
        back = self.cites.join(a.withColumnRenamed("src", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("citer").alias("part"))
        pos = F.row_number().over(W.partitionBy("id", "part").orderBy("other"))
        most = F.when(F.col("part") == "reference", refs).otherwise(citers)
        linked = out.unionByName(back).join(titles, "other").withColumn("pos", pos).where(F.col("pos") <= most).select("id", "part", "pos", F.col("title").alias("text"))
        own = self.authored.join(ids.select(F.col("id").alias("paper")), "paper").select(F.col("paper").alias("id"), "name")
        other = own.join(self.authored, "name").where(F.col("paper") != F.col("id")).withColumnRenamed("paper", "other").join(titles.where(F.col("citation_count") > 0), "other")
        best = W.partitionBy("id", "name").orderBy(F.desc("citation_count"), "other")
        top = other.withColumn("r", F.row_number().over(best)).where(F.col("r") <= works)
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: T.clip(x["title"], width)), ", ")
        named = top.groupBy("id", "name").agg(said.alias("said"))
        rank = F.row_number().over(W.partitionBy("id").orderBy("name"))
        people = named.withColumn("pos", rank).where(F.col("pos") <= authors).select("id", F.lit("author").alias("part"), "pos", F.concat("name", F.lit(": "), "said").alias("text"))
        return linked.unionByName(people)

    def citations(self, paper: str, most: int | None = None) -> DataFrame:
        """(direction, id, title, year): references and citers that are known, all or the first `most` of each direction by id."""
        one = F.lit(paper)
        out = self.cites.where(F.col("src") == one).select(F.lit("reference").alias("direction"), F.col("dst").alias("id"))
        back = self.cites.where(F.col("dst") == one).select(F.lit("citer").alias("direction"), F.col("src").alias("id"))
        both = [x.join(self.papers.select("id", "title", "year"), "id").select("direction", "id", "title", "year") for x in (out, back)]
        if most is not None:
            both = [x.orderBy("id").limit(most) for x in both]
        return both[0].unionByName(both[1])

    def lineage(self, paper: str, depth: int = 3, most: int = 15, forward: bool = True) -> DataFrame:
        """(id, title, year, citation_count, depth): what is reached along 1 to `depth` citations, no citation used twice. A paper may come at
        several depths."""
        a, b = ("src", "dst") if forward else ("dst", "src")
        edges = self.cites.select(F.col(a).alias("from"), F.col(b).alias("to"))
        levels = self._levels(edges, paper, depth) if depth <= 3 else self._trails(edges, paper, depth)
        every = levels[0]
        for x in levels[1:]:
            every = every.unionByName(x)
        got = every.distinct().join(self.titled(), "id").select("id", "title", "year", "citation_count", "depth")
        second = F.desc("citation_count") if forward else F.desc("year")
        return got.orderBy("depth", second, "id").limit(most)

    def _levels(self, edges: DataFrame, paper: str, depth: int) -> list[DataFrame]:
        """(id, depth) for up to three steps, from papers reached and not from ways to them. Of the steps paper > a > b > c the second can only repeat the
        first if both are a paper's citation of itself, and the third can repeat one of the others only if a is c: so two different a for each
        b tell whether there is a way."""
        p = F.lit(paper)
        one = edges.where(F.col("from") == p).select(F.col("to").alias("a")).distinct()
        at = lambda df, c, d: df.select(F.col(c).alias("id"), F.lit(d).alias("depth"))
        levels = [at(one, "a", 1)]
        two = edges.join(one, F.col("from") == F.col("a")).where(~((F.col("a") == p) & (F.col("to") == p))).groupBy(F.col("to").alias("b"))
        two = two.agg(F.min("a").alias("low"), F.max("a").alias("high"))
        if depth >= 2:
            levels.append(at(two, "b", 2))
        if depth >= 3:
            c = F.col("to")
            alone = (F.col("low") == c) & (F.col("high") == c) & ((F.col("b") == p) | (F.col("b") == c))
            levels.append(at(edges.join(two, F.col("from") == F.col("b")).where(~alone).select("to").distinct(), "to", 3))
        return levels[:depth]

    def _trails(self, edges: DataFrame, paper: str, depth: int) -> list[DataFrame]:
        """(id, depth) for more steps, from all ways of different citations: as many rows as there are ways."""
        walk = edges.where(F.col("from") == F.lit(paper)).select(F.col("to").alias("at"), F.array(F.struct("from", "to")).alias("used"))
        levels = [walk.select(F.col("at").alias("id"), F.lit(1).alias("depth"))]
        for d in range(2, depth + 1):
            e = edges.select(F.col("from").alias(f"f{d}"), F.col("to").alias(f"t{d}"))
            step = F.struct(F.col(f"f{d}").alias("from"), F.col(f"t{d}").alias("to"))
            walk = walk.join(e, F.col("at") == F.col(f"f{d}")).where(~F.array_contains("used", step))
            walk = walk.select(F.col(f"t{d}").alias("at"), F.concat("used", F.array(step)).alias("used"))
            levels.append(walk.select(F.col("at").alias("id"), F.lit(d).alias("depth")))
        return levels

    def path(self, start: str, goal: str, most: int = 4) -> list[str]:
        """Shortest undirected path, the smallest in order of ids; [] if there is none within `most` steps or start is goal.

        The two ends are widened in turn, the smaller front first, and only ids are kept, until the fronts meet. Then the levels between are cut down
        to what lies on a shortest path, and the path is read off from the start, a row a step.
        """
        if start == goal:
            return []
        e = cut_lineage(self.near().distinct())
        ends = self.papers.where(F.col("id").isin(start, goal)).select("id").distinct().collect()
        if len(ends) < 2:
            return []
        one = lambda x: cut_lineage(self.papers.where(F.col("id") == F.lit(x)).select("id").limit(1))
        levels, size = {True: [one(start)], False: [one(goal)]}, {True: 1, False: 1}
        while True:
            near, far = levels[True][-1], levels[False][-1]
            middle = near.join(far, "id", "left_semi")
            if not middle.isEmpty():
                break
            side = size[True] <= size[False]
            if len(levels[True]) + len(levels[False]) - 2 == most or not size[side]:
                return []
            mine = levels[side]
            nxt = e.join(mine[-1].withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            for old in mine[-2:]:  # a neighbour of a level is in it, in the one before or in the next
                nxt = nxt.join(old, "id", "left_anti")
            nxt = cut_lineage(nxt)
            mine.append(nxt)
            size[side] = nxt.count()
        # what can follow on each step: levels beyond the middle are the other end's, backwards
        steps = [*levels[True][1:-1], middle, *reversed(levels[False][:-1])]
        if len(levels[True]) == 1:
            steps = list(reversed(levels[False][:-1]))
        ways = [steps[-1]]
        for level in reversed(steps[:-1]):
            back = e.join(ways[0].withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
            ways.insert(0, cut_lineage(level.join(back, "id", "left_semi")))
        way = [start]
        for level in ways:
            on = e.where(F.col("src") == F.lit(way[-1])).select(F.col("dst").alias("id"))
            way.append(level.join(on, "id", "left_semi").orderBy("id").first()["id"])
        return way

    # ------------------------------------------------------------ fields and authors

    def network(self, author: str, most: int = 20) -> DataFrame:
        """Those who wrote with the author, by the number of papers."""
        c = self.coauthored()
        both = c.select(F.col("a").alias("x"), F.col("b").alias("y"), "papers").unionByName(c.select(F.col("b").alias("x"), F.col("a").alias("y"), "papers"))
        own = self.authored.where(F.col("name") == F.lit(author)).agg(F.count("*").alias("own_papers"))
        got = both.where(F.col("x") == F.lit(author)).select(F.col("x").alias("author"), F.col("y").alias("collaborator"), F.col("papers").alias("papers_together"))
        count = own.first()["own_papers"]
        return got.withColumn("own_papers", F.lit(count).cast("bigint")).orderBy(F.desc("papers_together"), "collaborator").limit(most)

    def top_authors(self, field: str, most: int = 20) -> DataFrame:
        rows = self.authored.join(self.known.where(F.col("field") == field), F.col("paper") == F.col("id"))
        got = rows.groupBy("name").agg(F.count("*").alias("papers"), F.coalesce(F.sum("citation_count"), F.lit(0)).alias("citations"))
        return got.orderBy(F.desc("citations"), F.desc("papers"), "name").limit(most)

    def influential(self, field: str | None = None, most: int = 20) -> DataFrame:
        return self._cited(F.col("citation_count") > 0, field, most)

    def trending(self, field: str | None = None, min_year: int = 2024, most: int = 10) -> DataFrame:
        return self._cited((F.col("year") >= min_year) & (F.col("citation_count") > 5), field, most)

    def _cited(self, cond: Column, field: str | None, most: int) -> DataFrame:
        rows = self.known.where(cond if field is None else cond & (F.col("field") == field))
        return rows.select("id", "title", "year", "citation_count", "field").orderBy(F.desc("citation_count"), "id").limit(most)

    def bridges(self, one: str, other: str, most: int = 10) -> DataFrame:
        """Papers in both categories."""
        hit = self.in_category.where(F.col("category").isin(one, other)).groupBy(F.col("paper").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") == 2)
        return hit.join(self.titled(), "id").select("id", "title", "year", "citation_count").orderBy(F.desc("citation_count"), "id").limit(most)

    def gaps(self, category: str, min_citations: int = 20, until: int = 2023, since: int = 2025, fewest: int = 2, most: int = 10) -> DataFrame:
        """Much cited papers up to `until` that hardly any paper from `since` on cites."""
        old = self.in_category.where(F.col("category") == category).select(F.col("paper").alias("id")).join(self.known, "id")
        old = old.where((F.col("citation_count") >= min_citations) & (F.col("year") <= until))
        recent = self.known.where(F.col("year") >= since).select(F.col("id").alias("src"))
        citing = self.cites.join(recent, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("recent"))
        got = old.join(citing, "id", "left").select("id", "title", "year", "citation_count", F.coalesce("recent", F.lit(0)).alias("recent_citations"))
        return got.where(F.col("recent_citations") <= fewest).orderBy(F.desc("citation_count"), "id").limit(most)
