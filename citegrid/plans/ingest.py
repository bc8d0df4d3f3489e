"""Batch ingest as one plan: validate, latest versions, chunks, index, graph tables, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cost, token_count
from ..operators import papers as P
from ..operators.chunking import chunk_papers
from ..operators.graph import Graph
from ..operators.store import write_index
from ..sources.sinks import append_failures, append_new, clear, rebuild, replace, upsert_vectors
from .embedding import embed_cached
from .providers import Offline, Provider


def prepare(raw: DataFrame, latest_year: int) -> tuple[DataFrame, DataFrame]:
    """(papers, rejects): valid records, latest versions."""
    valid, rejects = P.validate(raw, latest_year)
    return P.dedup_latest(valid).drop("base_id"), rejects


def ingest_fulltext(raw: DataFrame, parsed: DataFrame, path: str, latest_year: int, provider: Provider | None = None, fresh: bool = False) -> DataFrame:
    """Valid latest papers, their chunks, vectors through the cache, and the stored index: a search can read `path`/index afterwards."""
    papers, rejects = prepare(raw, latest_year)
    about = papers.select(F.col("id").alias("paper_id"), "title", F.col("year").cast("int").alias("year"), "primary_category", "citation_count", "published")
    chunks = chunk_papers(papers, parsed).join(about, "paper_id")
    chunks = chunks.withColumn("is_fulltext", F.col("section_index") >= 0).withColumn("created_at", F.current_timestamp())
    chunks = embed_cached(chunks, f"{path}/embeddings", provider or Offline()).drop("cached")
    if fresh:
        clear(chunks.sparkSession, f"{path}/chunks")
    upsert_vectors(chunks, f"{path}/chunks", f"{path}/failures")
    append_failures(rejects, f"{path}/failures")
    # the index follows the stored chunks; an older one is replaced only after the new one is whole
    clear(chunks.sparkSession, f"{path}/index-new")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    write_index(stored, f"{path}/index-new")
    replace(chunks.sparkSession, f"{path}/index-new", f"{path}/index")
    return report(raw, papers, stored)


def ingest_abstracts(raw: DataFrame, path: str, latest_year: int, fresh: bool = False) -> DataFrame:
    papers, _ = prepare(raw, latest_year)
    chunks = P.enriched_text(papers)
    rebuild(chunks, f"{path}/abstracts") if fresh else append_new(chunks, f"{path}/abstracts", "chunk_id")
    return report(raw, papers, chunks)


def build_graph(raw: DataFrame, path: str, coauthors: bool = True) -> DataFrame:
    """Vertex and edge tables, written whole, each vertex and edge once and clustered by what they are looked up by; citations from either end."""
    g = Graph(P.current_papers(raw))
    tables = {
        "papers": (g.papers.dropDuplicates(["id"]), ["id"]),
        "cites": (g.cites, ["src", "dst"]),
        "cited": (g.cites, ["dst", "src"]),
        "authored": (g.authored, ["name", "paper"]),
        "in_category": (g.in_category, ["category", "paper"]),
    }
    if coauthors:
        tables["coauthored"] = (g.coauthored(), ["a", "b"])
    for name, (df, keys) in tables.items():
        rebuild(df.repartitionByRange(*keys).sortWithinPartitions(*keys), f"{path}/{name}")
    return g.stats()


def report(raw: DataFrame, papers: DataFrame, chunks: DataFrame, seconds: float | None = None) -> DataFrame:
    """(what, n): records read, papers kept, chunks made, their tokens; chunks a paper, price of the vectors and, with `seconds`, papers a second."""
    counts = raw.agg(F.count("*").alias("records")).join(papers.agg(F.count("*").alias("papers")))  # one row each
    counts = counts.join(chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(token_count(F.coalesce("chunk_text", F.lit("")))), F.lit(0)).alias("tokens")))
    per = F.round(F.col("chunks") / F.greatest("papers", F.lit(1)), 4)
    whats = {
        "records": F.col("records").cast("double"),
        "papers": F.col("papers").cast("double"),
        "chunks": F.col("chunks").cast("double"),
        "tokens": F.col("tokens").cast("double"),
        "chunks_per_paper": per,
        "cost": F.round(cost(F.col("tokens")), 6),
    }
    if seconds is not None:
        whats["papers_per_second"] = F.col("papers") / F.lit(max(seconds, 1e-9))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("n")) for k, v in whats.items()])))


def progress(papers: DataFrame, parsed: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: papers, parsed, indexed, failed and not parsed since, and what is still to do."""
    key = lambda df: df.select(P.paper_key(F.col("paper_id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    marks = papers.select("id").join(key(parsed).withColumn("parsed", F.lit(True)), "id", "left")
    marks = marks.join(key(chunks).withColumn("indexed", F.lit(True)), "id", "left").join(key(failures).withColumn("failed", F.lit(True)), "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    done, tried = yes("parsed"), yes("failed")
    return marks.agg(
        F.count("*").alias("papers"),
        F.count_if(done).alias("parsed"),
        F.count_if(yes("indexed")).alias("indexed"),
        F.count_if(tried & ~done).alias("failed"),
        F.count_if(~done & ~tried).alias("to_do"),
    )
