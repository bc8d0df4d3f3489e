"""Text contexts out of ranked tables: ordered aggregation over top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clip
from ..operators.graph import Graph
from ..operators.retrieval import Index, texts_of
from ..session import bounded


def lines(df: DataFrame, order: Column, line: Column) -> DataFrame:
    """One row `text`: the lines of a bounded report in order."""
    rows = df.select(order.alias("o"), line.alias("l"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n").alias("text"))


def first_papers(papers: DataFrame, hits: DataFrame, index: Index, records: DataFrame, top: int = 5, snippets: int = 3, width: int = 400) -> DataFrame:
    """(pos, id, title, year, body) of the first papers; the body is up to three snippets, else the abstract."""
    pos = F.row_number().over(W.partitionBy().orderBy(F.desc("best_score"), "first_rank"))
    first = bounded(papers.orderBy(F.desc("best_score"), "first_rank").limit(top).withColumn("pos", pos), top)
    text = hits.join(texts_of(index, hits).select("chunk_id", "chunk_text"), "chunk_id").where(F.coalesce("chunk_text", F.lit("")) != "")
    per = text.groupBy("paper_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), 1, snippets).alias("s"))
    few = [r["paper_id"] for r in first.collect()]
    own = records.where(F.col("id").isin(*few)).select(F.col("id").alias("paper_id"), "title", "year", "abstract")
    j = first.select("pos", "paper_id").join(per, "paper_id", "left").join(own, "paper_id", "left")
    body = F.array_join(F.transform("s", lambda x: clip(x["chunk_text"], width)), "\n")
    return j.select("pos", F.col("paper_id").alias("id"), "title", "year", F.when(F.col("s").isNotNull(), body).otherwise(clip(F.col("abstract"), width)).alias("body"))


def basic_context(papers: DataFrame, hits: DataFrame, index: Index, records: DataFrame, top: int = 5, snippets: int = 3, width: int = 400) -> DataFrame:
    """(pos, text) for the first papers: title and year, then the body."""
    j = first_papers(papers, hits, index, records, top, snippets, width)
    head = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(")"))
    return j.select("pos", F.concat_ws("\n", head, "body").alias("text"))


def trending_text(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("year").cast("string"), F.lit("), cited "), F.col("citation_count").cast("string"))
    return lines(df, F.struct(-F.col("citation_count"), F.col("id")), line)


def lineage_text(df: DataFrame) -> DataFrame:
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.coalesce("title", F.lit("")))
    return lines(df, F.struct("depth", -F.col("citation_count"), F.col("id")), line)


def gaps_text(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("), cited "), F.col("citation_count").cast("string"), F.lit(", recently "), F.col("recent_citations").cast("string"))
    return lines(df, F.struct(-F.col("citation_count"), F.col("id")), line)


def bridges_text(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(")"))
    return lines(df, F.struct(-F.coalesce("citation_count", F.lit(-1)), F.col("id")), line)


def enriched_context(firsts: DataFrame, ids: DataFrame, graph: Graph, body: int = 350) -> DataFrame:
    """(part, pos, text). firsts(id, pos, title, year, body): the first papers of a result, each with its references, citers and authors'
    other works; ids(id): all papers of it, around which related, common and expert entries follow, one line each."""
    near = graph.contexts(firsts.select("id"), 3, 3, 2, 2)
    joined = lambda part, label, width: F.when(F.col(part).isNotNull(), F.concat(F.lit(label), F.array_join(F.transform(part, lambda x: clip(x["t"], width)), "; ")))
    per = near.groupBy("id").pivot("part", ["reference", "citer", "author"]).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("text").alias("t")))))
    for c in ("reference", "citer", "author"):
        per = per.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
    j = firsts.join(per, "id", "left")
    head = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(")"))
    text = F.concat_ws("\n", head, clip(F.col("body"), body), joined("reference", "Cites: ", 60), joined("citer", "Cited by: ", 60), joined("author", "Authors: ", 200))
    papers = j.select(F.lit("paper").alias("part"), F.col("pos").cast("int").alias("pos"), text.alias("text"))

    def listed(df: DataFrame, part: str, order: list, line: Column) -> DataFrame:
        pos = F.row_number().over(W.partitionBy().orderBy(*order))  # a report of a few rows
        return df.select(F.lit(part).alias("part"), pos.alias("pos"), line.alias("text"))

    title = clip(F.coalesce("title", F.lit("")), 70)
    related = listed(graph.connected(ids, 5), "related", [F.desc("shared"), F.desc("citation_count"), "id"], title)
    common = listed(graph.common_ancestors(ids, 3), "foundational", [F.desc("cited_by_count"), F.desc("citation_count"), "id"], title)
    experts = listed(graph.expertise(ids, 5), "expert", [F.desc("papers_in_cluster"), F.desc("total_citations"), "name"], F.concat("name", F.lit(" ("), F.col("papers_in_cluster").cast("string"), F.lit(" papers)")))
    return papers.unionByName(related).unionByName(common).unionByName(experts)
