"""Learning paths between two topics: anchors, waypoints between them, a greedy choice along citations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_of, interior
from ..session import bounded
from .graph import Graph
from .retrieval import Index, dense_topk, hybrid_topk, interpolate, texts_of

STEP = (
    "step int, paper_id string, title string, year int, abstract string, citations int, authors array<string>, field string, pdf_url string, "
    "similarity double, position double, has_citation_link boolean, why_read string"
)


def _cited(index: Index, hits: DataFrame) -> DataFrame:
    return hits.join(texts_of(index, hits).select("chunk_id", "citation_count"), "chunk_id")


def anchor(index: Index, vector: list[float], text: str, k: int = 10) -> dict | None:
    """The hit with the best mix of similarity and citations, first in rank of equal ones."""
    hits = _cited(index, bounded(hybrid_topk(index, vector, text, k), k))
    best = hits.withColumn("worth", 0.6 * F.col("score") + 0.4 * F.least(F.coalesce("citation_count", F.lit(0)) / 100.0, F.lit(1.0)))
    row = best.orderBy(F.desc("worth"), F.desc("score"), "chunk_id").first()
    return row.asDict() if row else None


def _records(graph: Graph, ids: list[str]) -> dict[str, dict]:
    """Records of at most a few dozen papers."""
    cols = ["id", "title", "year", "abstract", "citation_count", "authors", "primary_category", "pdf_url"]
    have = [c for c in cols if c in graph.records.columns]
    rows = graph.records.where(F.col("id").isin(*ids)).select(*have, field_of(F.coalesce(F.get(F.col("categories"), F.lit(0)), F.col("primary_category"))).alias("field")).collect()
    return {r["id"]: r.asDict() for r in rows}


def learning_path(index: Index, graph: Graph, start: tuple[list[float], str], goal: tuple[list[float], str], steps: int = 4, explain: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Steps from start to goal, with their records and, from `explain` (titles -> one line each), why to read them. Waypoints are taken in turn, as what earlier ones have seen is no candidate later: at most ten rows of a
    top-k report come to the driver for each of at most six waypoints."""
    spark = index.entries.sparkSession
    a, b = anchor(index, *start), anchor(index, *goal)
    if a is None or b is None:
        return spark.createDataFrame([], STEP)
    seen = {a["paper_id"], b["paper_id"]}
    layers: list[list[dict]] = []
    for t in interior(steps):
        hits = _cited(index, bounded(dense_topk(index, interpolate(start[0], goal[0], t), 20), 20))
        rows = [r.asDict() for r in hits.orderBy(F.desc("score"), "chunk_id").collect() if r["paper_id"] not in seen][:10]
        layers.append(rows)
        seen |= {r["paper_id"] for r in rows}
    among = sorted(seen)  # at most 62 papers
    inner = graph.near().where(F.col("src").isin(*among) & F.col("dst").isin(*among))
    links = {(r["src"], r["dst"]) for r in inner.distinct().collect()}
    chosen, at = [(a["paper_id"], 0.0, a["score"])], a["paper_id"]
    for t, rows in zip(interior(steps), layers):
        if not rows:
            continue
        worth = lambda r, at=at: 0.4 * r["score"] + 0.3 * min((r["citation_count"] or 0) / 50, 1) + 0.3 * ((at, r["paper_id"]) in links) + 0.01
        pick = max(rows, key=worth)
        chosen.append((pick["paper_id"], t, pick["score"]))
        at = pick["paper_id"]
    chosen.append((b["paper_id"], 1.0, b["score"]))
    nxt = [c[0] for c in chosen[1:]] + [None]
    known = _records(graph, [c[0] for c in chosen])
    titles = [known.get(p, {}).get("title") or p for p, _, _ in chosen]
    why = whys(explain(titles) if explain else [], len(chosen))
    rows = []
    for i, ((p, t, sim), n, w) in enumerate(zip(chosen, nxt, why)):
        k = known.get(p, {})
        year, cited = k.get("year"), k.get("citation_count")
        rows.append((i, p, k.get("title"), None if year is None else int(year), k.get("abstract"), None if cited is None else int(cited), k.get("authors"), k.get("field"), k.get("pdf_url"), sim, round(t, 2), (p, n) in links, w))
    return spark.createDataFrame(rows, STEP)


def whys(lines: list[str], n: int) -> list[str]:
    """Explanations by position, without their labels; '' where there are fewer."""
    bare = [re.sub(r"^(START:|GOAL:|Step 1?\d:)", "", x.strip()).strip() for x in lines if x.strip()]
    return (bare + [""] * n)[:n]


def coverage(path: DataFrame) -> DataFrame:
    """Share of consecutive steps that a citation links."""
    return path.agg(F.bround(F.sum(F.col("has_citation_link").cast("int")) / F.greatest(F.count("*") - 1, F.lit(1)), 2).alias("coverage"), F.count("*").alias("steps"))
