"""The staged search: expansion, hybrid top-k, rerank, grouping, sibling chunks, graph, context; and the router of chats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.graph import Graph
from ..operators.learning import learning_path
from ..session import bounded, few, local
from . import context as C
from .providers import Offline, Provider


@dataclass
class SearchParams:
    query: str
    top_k: int = 5
    use_hyde: bool = True
    use_rerank: bool = True
    alpha: float = 0.7
    year_min: int | None = None
    year_max: int | None = None
    categories: list[str] | None = None
    chunk_type: str | None = None

    def __post_init__(self) -> None:
        if not 3 <= len(self.query) <= 500 or not 1 <= self.top_k <= 50 or not 0 <= self.alpha <= 1:
            raise ValueError("query of 3 to 500 characters, top_k 1 to 50, alpha 0 to 1")


@dataclass
class ChatParams:
    message: str
    history: list[dict] = field(default_factory=list)
    top_k: int = 5
    use_hyde: bool = True
    use_rerank: bool = True
    alpha: float = 0.7
    year_min: int | None = None
    year_max: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.message) <= 1000 or not 1 <= self.top_k <= 20:
            raise ValueError("message of 1 to 1000 characters, top_k 1 to 20")


class Engine:
    """index: what a search reads; papers: one row per id (operators.papers.current_papers). Without a graph, enrichment is left out."""

    def __init__(self, index: R.Index, papers: DataFrame, provider: Provider | None = None, graph: Graph | None = None, use_graph: bool = True):
        self.index, self.papers, self.provider = index, papers, provider or Offline()
        self.graph = (graph or Graph(papers)) if use_graph else None

    def vector(self, query: str, use_hyde: bool) -> list[float]:
        text = self.provider.expand(query) if use_hyde else None
        return R.blend(self.provider.embed(query), self.provider.embed(text) if text else None)

    def hits(self, vector: list[float], p: SearchParams, most: int = 80) -> DataFrame:
        """At most `most` hits with their rank, as a local table: what follows reads them several times."""
        cond = R.filters(p.year_min, p.year_max, p.categories, p.chunk_type)
        n = R.over_fetch(p.top_k, p.use_rerank, most)
        spark = self.papers.sparkSession
        best = few(R.hybrid_topk(self.index, vector, p.query, n, p.alpha, cond), n)  # in order
        schema = "chunk_id string, paper_id string, score double, rank int"
        top = local(spark, [(r["chunk_id"], r["paper_id"], r["score"], i) for i, r in enumerate(best, 1)], schema)
        if not p.use_rerank:
            return top.withColumn("rerank_score", F.lit(None).cast("double"))
        again = few(R.rerank(top, self.index, p.query, self.papers), n)
        order = sorted(again, key=lambda r: (-r["rerank_score"], r["rank"]))
        return local(spark, [(r["chunk_id"], r["paper_id"], r["score"], i, r["rerank_score"]) for i, r in enumerate(order, 1)], schema + ", rerank_score double")

    def search(self, p: SearchParams, vector: list[float] | None = None, most: int = 80) -> DataFrame:
        """Papers, best first: scores, their chunks and how many siblings were added, and the record: of the first chunk's entry or of the
        paper's own row."""
        vector = vector or self.vector(p.query, p.use_hyde)
        hits = self.hits(vector, p, most)
        papers = bounded(R.group_papers(hits, p.top_k), p.top_k)
        more = R.expand(papers, hits, self.index, vector).groupBy("paper_id").agg(F.count("*").alias("expanded"))
        got = R.with_metadata(papers, self.index).join(more, "paper_id", "left").withColumn("expanded", F.coalesce("expanded", F.lit(0)))
        return self._recorded(got, [r["paper_id"] for r in papers.collect()]).orderBy(F.desc("best_score"), "first_rank")

    def _recorded(self, got: DataFrame, ids: list[str]) -> DataFrame:
        own = self.papers.where(F.col("id").isin(*ids)).select(F.col("id").alias("paper_id"), *[F.col(c).alias(f"_{c}") for c in ("title", "year", "abstract", "authors", "categories", "pdf_url", "citation_count") if c in self.papers.columns])
        j = got.join(own, "paper_id", "left")
        for c in ("abstract", "authors", "categories", "pdf_url", "citation_count"):
            if f"_{c}" not in j.columns:
                j = j.withColumn(f"_{c}", F.lit(None).cast("array<string>" if c in ("authors", "categories") else "int" if c == "citation_count" else "string"))
        cited = F.coalesce("_citation_count", "citation_count", F.lit(0))
        title = F.coalesce("title", "_title", F.lit(""))
        return j.select(
            *("paper_id", "best_score", "rerank_score", "first_rank", "chunks", "n_chunks", "expanded"),
            title.alias("title"),
            F.coalesce("year", "_year").cast("int").alias("year"),
            F.substring(F.coalesce("_abstract", F.lit("")), 1, 1000).alias("abstract"),
            F.concat_ws(", ", F.slice("_authors", 1, 10)).alias("authors"),
            F.concat_ws(",", F.slice("_categories", 1, 10)).alias("categories"),
            F.coalesce("_pdf_url", F.lit("")).alias("pdf_url"),
            T.field_of(F.col("primary_category")).alias("field"),
            T.citation_tier(cited).alias("citation_tier"),
            F.coalesce(T.has_code(F.col("_abstract")), F.lit(False)).alias("has_code"),
            T.is_survey(title).alias("is_survey"),
        )

    def enrichment(self, ids: DataFrame) -> dict[str, DataFrame]:
        """Related papers, common ancestors, experts and single contexts around the result; nothing without a graph."""
        if self.graph is None:
            return {}
        return {"related": self.graph.connected(ids, 10), "foundational": self.graph.common_ancestors(ids, 5), "experts": self.graph.expertise(ids, 10), "contexts": self.graph.contexts(ids)}

    def context(self, papers: DataFrame, hits: DataFrame) -> str:
        """Text for the answer: the first five papers, with the graph around them where there is one."""
        basic = C.basic_context(papers, hits, self.index, self.papers)
        if self.graph is None:
            return "\n\n".join(r["text"] for r in basic.orderBy("pos").collect())  # five rows
        found = [(r["paper_id"],) for r in papers.select("paper_id").collect()]  # top_k rows
        if not found:
            return ""
        ids = local(papers.sparkSession, found, "id string")
        firsts = C.first_papers(papers, hits, self.index, self.papers)
        rows = C.enriched_context(firsts, ids, self.graph).collect()  # at most 18 rows
        order = ["paper", "related", "foundational", "expert"]
        return "\n\n".join(r["text"] for r in sorted(rows, key=lambda r: (order.index(r["part"]), r["pos"])))

    def chat(self, p: ChatParams) -> Iterator[tuple[int, str, str]]:
        """(seq, type, payload): the sources, then the answer in tokens, then done."""
        kind, params = self.provider.classify(p.message, p.history)
        context, sources = self._agents()[kind](p, params)
        yield 0, "sources", ",".join(sources)
        words = self.provider.answer(p.message, context, p.history[-6:]).split(" ")
        for i, w in enumerate(words):
            yield i + 1, "token", w
        yield len(words) + 1, "done", ""

    def _agents(self):
        text = lambda df: (df.first() or [""])[0] or ""
        titles = lambda df: "\n".join(r["title"] or "" for r in df.collect())  # noqa: E731  top-k reports

        experts = lambda field: "\n".join(f"{r['name']}: {r['citations']}" for r in self.graph.top_authors(field).collect())  # noqa: E731  20 rows
        missing = "There is no citation graph."

        def search(p: ChatParams, params: dict):
            query = self.provider.rewrite(p.message, p.history) if p.history else p.message
            s = SearchParams(query, p.top_k, p.use_hyde, p.use_rerank, p.alpha, p.year_min, p.year_max)
            vector = self.vector(query, p.use_hyde)
            hits = self.hits(vector, s, 100)
            papers = bounded(R.group_papers(hits, p.top_k), p.top_k)
            return self.context(papers, hits), [r["paper_id"] for r in papers.orderBy(F.desc("best_score"), "first_rank").collect()]

        def graph(p: ChatParams, params: dict):
            if self.graph is None:
                return missing, []
            if params.get("author"):
                got = "\n".join(f"{r['collaborator']}: {r['papers_together']}" for r in self.graph.network(params["author"]).collect())
            elif params.get("field"):
                got = experts(params["field"])
            elif params.get("paper"):
                got = titles(self.graph.citations(params["paper"], 10))
            else:
                got = ""
            return got or experts("Computer Science"), []

        def path(p: ChatParams, params: dict):
            if not params.get("start") or not params.get("end"):
                return "Both topics are needed.", []
            a, b = params["start"], params["end"]
            if self.graph is None:
                return missing, []
            steps = learning_path(self.index, self.graph, (self.provider.embed(a), a), (self.provider.embed(b), b), 4, self.provider.explain)
            rows = steps.orderBy("step").collect()
            return "\n".join(f"{r['step'] + 1}. {r['title'] or r['paper_id']} ({r['year'] or ''}): {r['why_read']}" for r in rows), [r["paper_id"] for r in rows]

        def recent(p: ChatParams, params: dict):
            return "\n".join(m["content"][:500] for m in p.history[-4:]), []

        return {
            "SEARCH": search,
            "GRAPH": graph,
            "TRENDING": lambda p, q: ((text(C.trending_text(self.graph.trending())) if self.graph else "") or "No trends were found.", []),
            "GAPS": lambda p, q: ((text(C.gaps_text(self.graph.gaps(q.get("category") or "cs.AI"))) if self.graph else "") or "No gaps were found.", []),
            "PATH": path,
            "FOLLOWUP": recent,
            "COMPARE": recent,
            "DIRECT": lambda p, q: ("", []),
        }
