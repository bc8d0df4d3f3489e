"""Queries of retrieval. The query vector is the first usable embedding by chunk_id, the expansion's the second, the path's goal the last."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.learning import coverage, learning_path
from ..operators.papers import current_papers, paper_key
from ..operators.store import index_stats as stats_of
from ..operators.store import storage_bytes, stored_index
from ..plans.providers import Offline
from ..session import bounded, table
from . import graph as G
from .sql import CURRENT, GRAPH, INDEX, bare, field, strip

TEXT = "stable gradient for entity linking with sparse encoders"
DIM = 96


def index(spark: SparkSession, d: str) -> R.Index:
    """The stored index of the chunks, written by the first search in the shared folder."""
    return stored_index(spark, f"{d}/chunks.parquet")


def keyed_index(spark: SparkSession, d: str) -> R.Index:
    """The index with papers named as in current_papers and the graph."""
    ix = index(spark, d)
    return replace(ix, entries=ix.entries.withColumn("paper_id", paper_key(F.col("paper_id"))))


def vectors(spark: SparkSession, d: str, n: int, last: bool = False) -> list[list[float]]:
    """The first n usable vectors of sections by chunk_id."""
    c = index(spark, d).entries.where((F.col("dim") == DIM) & F.col("is_fulltext"))
    order = F.desc("chunk_id") if last else F.asc("chunk_id")
    return [list(r["embedding"]) for r in c.select("chunk_id", "embedding").orderBy(order).limit(n).collect()]


def dense_topk(spark, d):
    return R.dense_topk(index(spark, d), vectors(spark, d, 1)[0], 20)


def dense_topk_filtered(spark, d):
    cond = R.filters(2012, 2022, ["cs.LG", "cs.CL", "cs.AI"], None)
    return R.dense_topk(index(spark, d), vectors(spark, d, 1)[0], 20, cond)


def hyde_blend_topk(spark, d):
    q, h = vectors(spark, d, 2)
    return R.dense_topk(index(spark, d), R.blend(q, h), 20)


def waypoint_topk(spark, d):
    q, h = vectors(spark, d, 2)
    return R.dense_topk(index(spark, d), R.interpolate(q, h, 0.4), 20)


def sparse_stats(spark, d):
    return index(spark, d).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def document_frequencies(spark, d):
    return index(spark, d).terms


def sparse_topk(spark, d):
    return R.sparse_topk(index(spark, d), TEXT, 20)


def _hybrid(spark, d, k=20):
    return R.hybrid_topk(index(spark, d), vectors(spark, d, 1)[0], TEXT, k)


def _hits(spark, d):
    return bounded(R.ranked(_hybrid(spark, d)).withColumn("rerank_score", F.lit(None).cast("double")), 20)


def group_papers(spark, d):
    return R.group_papers(_hits(spark, d), 5).select("paper_id", "best_score", "first_rank", "chunks", "n_chunks")


def rerank_topk(spark, d):
    return R.rerank(bounded(_hybrid(spark, d), 20), index(spark, d), TEXT)


def expand_chunks(spark, d):
    hits = _hits(spark, d)
    got = R.expand(R.group_papers(hits, 5), hits, index(spark, d), vectors(spark, d, 1)[0])
    return got.select("chunk_id", "paper_id", "score")


def search_papers(spark, d):
    from ..plans.search import Engine, SearchParams

    engine = Engine(keyed_index(spark, d), current_papers(table(spark, d, "papers")))
    return engine.search(SearchParams(TEXT, top_k=5, use_hyde=False), vectors(spark, d, 1)[0])


def index_stats(spark, d):
    """Entries, vectors, papers and words of the stored index, and its size."""
    ix = index(spark, d)
    return stats_of(ix).join(storage_bytes(ix))  # one row each


def chunk_metadata(spark, d):
    """Papers of a hybrid search with the metadata of their first chunk."""
    ix = index(spark, d)
    return R.with_metadata(bounded(R.group_papers(_hits(spark, d), 5), 5), ix).select("paper_id", "first_chunk", "title", "year", "chunk_type")


def search_chunks(spark, d):
    """The chunks behind a hybrid search."""
    return R.matched_chunks(_hits(spark, d), index(spark, d)).drop("rerank_score")


def best_chunks(spark, d):
    """The six best chunks of every paper against one query, in one pass."""
    rows = index(spark, d).entries.where(F.col("dim") == DIM)
    rows = rows.select("chunk_id", "paper_id", F.round(R.dot(F.col("embedding"), vectors(spark, d, 1)[0]), 6).alias("score"))
    w = R.W.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("pos", F.row_number().over(w)).where("pos <= 6")


def path_steps(spark, d):
    """A learning path of four waypoints between two vectors, with the record and the reason of each step."""
    return _path(spark, d).withColumn("authors", F.concat_ws(", ", "authors"))


def _path(spark, d):
    a, b = vectors(spark, d, 1)[0], vectors(spark, d, 1, last=True)[0]
    return learning_path(keyed_index(spark, d), G.graph(spark, d), (a, "stable gradient"), (b, "sparse encoder"), 4, Offline().explain)


def path_coverage(spark, d):
    return coverage(_path(spark, d))


class Fixed(Offline):
    """A provider whose vector for every text is the same."""

    def __init__(self, vector: list[float]):
        super().__init__(len(vector))
        self.vector = vector

    def embed(self, text: str) -> list[float]:
        return self.vector

    def expand(self, query: str) -> str | None:
        return None


def chat_events(spark, d):
    """Sources, answer in tokens and end of a chat."""
    from ..plans.search import ChatParams, Engine

    engine = Engine(keyed_index(spark, d), current_papers(table(spark, d, "papers")), Fixed(vectors(spark, d, 1)[0]))
    return spark.createDataFrame(list(engine.chat(ChatParams(TEXT))), "seq int, type string, payload string")


QUERIES = {
    "dense_topk": dense_topk,
    "dense_topk_filtered": dense_topk_filtered,
    "hyde_blend_topk": hyde_blend_topk,
    "waypoint_topk": waypoint_topk,
    "sparse_stats": sparse_stats,
    "document_frequencies": document_frequencies,
    "sparse_topk": sparse_topk,
    "hybrid_topk": _hybrid,
    "group_papers": group_papers,
    "rerank_topk": rerank_topk,
    "expand_chunks": expand_chunks,
    "best_chunks": best_chunks,
    "index_stats": index_stats,
    "chunk_metadata": chunk_metadata,
    "search_chunks": search_chunks,
    "search_papers": search_papers,
    "learning_path": path_steps,
    "path_coverage": path_coverage,
    "chat_events": chat_events,
}

_TERMS = ", ".join(f"'{t}'" for t in sorted(set(TEXT.split())))
_DENSE = f"with {INDEX}, d as (select chunk_id, paper_id, year, primary_category, list_dot_product(embedding::double[], (select v from q)) as dense from vec)"
_SPARSE = f""",
    w as (select chunk_id, paper_id, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') as w from idx),
    st as (select count(*) as n, avg(len(coalesce(w, []))) as avgdl from w),
    tf as (select chunk_id, paper_id, dl, term, count(*) as tf from (select chunk_id, paper_id, len(w) as dl, unnest(w) as term from w)
           where term in ({_TERMS}) group by all),
    idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, st group by term, n),
    sp as (select chunk_id, paper_id, sum(tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * idf / (select sum(idf) from idf)) as sparse
           from tf join idf using (term), st group by all)"""
HYBRID = f"""{_DENSE}{_SPARSE},
    hy as (select chunk_id, d.paper_id, round(0.7 * dense + 0.3 * coalesce(sparse, 0), 6) as score from d left join sp using (chunk_id) order by score desc, chunk_id limit 20),
    rk as (select *, row_number() over (order by score desc, chunk_id) as rank from hy),
    gp as (select paper_id, max(score) as best_score, min(rank)::int as first_rank, string_agg(chunk_id, ',' order by rank) as chunks, count(*) as n_chunks
           from rk group by paper_id order by best_score desc, first_rank limit 5)"""
_TOP = " order by score desc, chunk_id limit 20"


def _mixed(expr: str) -> str:
    return f"""with {INDEX}, m as (select list_transform(list_zip((select v from q), (select v from h)), lambda x: {expr}) as v)
        select chunk_id, paper_id, round(list_dot_product(embedding::double[], (select v from m)), 6) as score from vec{_TOP}"""


_KEYED = f"'arxiv:' || {bare('hy.paper_id')}"
#: search_papers: twenty hits under the papers' keys, ranked anew, grouped, siblings counted, records joined.
SEARCH = f"""{HYBRID.replace("with ", "", 1)},
    h0 as (select hy.chunk_id, {_KEYED} as paper_id, hy.score, row_number() over (order by hy.score desc, hy.chunk_id) as r0,
                  round(len(list_intersect(list_distinct(w.w), [{_TERMS}])) / {len(set(TEXT.split()))}, 6) as rr from hy join w using (chunk_id)),
    h1 as (select *, row_number() over (order by rr desc, r0) as rank, case when rr <> 0 then rr else score end as value from h0),
    g1 as (select paper_id, max(value) as best_score, arg_max(rr, (value, -rank)) as rerank_score, min(rank)::int as first_rank,
                  string_agg(chunk_id, ',' order by rank) as chunks, count(*) as n_chunks, arg_min(chunk_id, rank) as first_chunk
           from h1 group by paper_id order by best_score desc, first_rank limit 5),
    o1 as (select d.chunk_id, g1.paper_id, n_chunks, round(dense, 6) as score,
                  row_number() over (partition by g1.paper_id order by round(dense, 6) desc, d.chunk_id) as r
           from d join g1 on g1.paper_id = 'arxiv:' || {bare("d.paper_id")} where n_chunks < 3),
    n1 as (select paper_id, n_chunks, row_number() over (partition by paper_id order by score desc, chunk_id) as p from o1 where r <= 6 and chunk_id not in (select chunk_id from hy)),
    x1 as (select paper_id, count(*) as expanded from n1 where p <= 3 - n_chunks group by 1)"""
_SEARCH = f"""with {CURRENT}, {SEARCH}
    select g1.paper_id, best_score, rerank_score, first_rank, chunks, n_chunks, coalesce(expanded, 0) as expanded, coalesce(i.title, c.title, '') as title,
    coalesce(i.year, c.year)::int as year, coalesce(c.abstract, '')[:1000] as abstract, coalesce(array_to_string(c.authors[1:10], ', '), '') as authors,
    coalesce(array_to_string(c.categories[1:10], ','), '') as categories, coalesce(c.pdf_url, '') as pdf_url, {field("i.primary_category")} as field,
    case when coalesce(c.citation_count, i.citation_count, 0) >= 100 then 'high' when coalesce(c.citation_count, i.citation_count, 0) >= 10 then 'medium' else 'low' end as citation_tier,
    coalesce(contains(lower(c.abstract), 'github'), false) as has_code, regexp_matches(lower(coalesce(i.title, c.title, '')), 'survey|review|overview') as is_survey
    from g1 left join x1 using (paper_id) left join idx i on i.chunk_id = first_chunk left join cur c on c.pid = g1.paper_id"""



def _anchor(n: int, vector: str, text: str) -> str:
    """SQL: an{n}(paper_id, score), the best of ten hybrid hits for a vector and a text."""
    terms = ", ".join(f"'{t}'" for t in sorted(set(text.split())))
    return f""",
    tf{n} as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(w) as dl, unnest(w) as term from w) where term in ({terms}) group by all),
    idf{n} as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf{n}, st group by term, n),
    sp{n} as (select chunk_id, sum(tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * idf / (select sum(idf) from idf{n})) as sparse
              from tf{n} join idf{n} using (term), st group by all),
    hy{n} as (select v.chunk_id, 'arxiv:' || {bare("v.paper_id")} as paper_id, coalesce(citation_count, 0)::double as cc,
                     round(0.7 * list_dot_product(embedding::double[], (select v from {vector})) + 0.3 * coalesce(sparse, 0), 6) as score
              from vec v left join sp{n} using (chunk_id) order by score desc, v.chunk_id limit 10),
    an{n} as (select paper_id, score from hy{n} order by 0.6 * score + 0.4 * least(cc / 100, 1) desc, score desc, chunk_id limit 1)"""


def _waypoint(i: int, steps: int = 4) -> str:
    """SQL: l{i}, candidates at the i-th of `steps` places that no earlier one has seen, and p{i}, at{i}: the one taken, and where the path then is."""
    seen = " union all ".join(f"select paper_id from {x}" for x in ("an1", "an2", *(f"l{j}" for j in range(1, i))))
    t = i / (steps + 1)
    return f""",
    m{i} as (select list_transform(list_zip((select v from q), (select v from vb)), lambda x: (1 - {t}::double) * x[1] + {t}::double * x[2]) as v),
    t{i} as (select chunk_id, 'arxiv:' || {bare("paper_id")} as paper_id, coalesce(citation_count, 0)::double as cc,
                    round(list_dot_product(embedding::double[], (select v from m{i})), 6) as score from vec order by score desc, chunk_id limit 20),
    l{i} as (select * from t{i} where paper_id not in ({seen}) order by score desc, chunk_id limit 10),
    p{i} as (select paper_id, score from l{i} order by 0.4 * score + 0.3 * least(cc / 50, 1)
             + 0.3 * (paper_id in (select dst from near where src = (select here from at{i - 1})))::int + 0.01 desc, score desc, chunk_id limit 1),
    at{i} as (select coalesce((select paper_id from p{i}), (select here from at{i - 1})) as here)"""


_PATH = f"""{GRAPH}, {INDEX}, vb as (select embedding::double[] as v from vec where is_fulltext order by chunk_id desc limit 1),
    w as (select chunk_id, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') as w from idx), st as (select count(*) as n, avg(len(coalesce(w, []))) as avgdl from w)
    {_anchor(1, "q", "stable gradient")}{_anchor(2, "vb", "sparse encoder")}, at0 as (select paper_id as here from an1)
    {"".join(_waypoint(i) for i in range(1, 5))},
    chosen as (select 0 as o, paper_id, 0.0 as position, score from an1 {" ".join(f"union all select {i}, paper_id, {i / 5}, score from p{i}" for i in range(1, 5))}
               union all select 9, paper_id, 1.0, score from an2),
    path as (select (row_number() over (order by o) - 1)::int as step, paper_id, position::double as position, score as similarity, lead(paper_id) over (order by o) as nxt from chosen),
    linked as (select p.*, coalesce(nxt in (select dst from near where src = p.paper_id), false) as has_citation_link from path p)"""

ORACLES = {
    "dense_topk": f"{_DENSE} select chunk_id, paper_id, round(dense, 6) as score from d{_TOP}",
    "dense_topk_filtered": f"""{_DENSE} select chunk_id, paper_id, round(dense, 6) as score from d
        where year between 2012 and 2022 and primary_category in ('cs.LG', 'cs.CL', 'cs.AI'){_TOP}""",
    "hyde_blend_topk": _mixed("0.4 * x[1] + 0.6 * x[2]"),
    "waypoint_topk": _mixed("0.6 * x[1] + 0.4 * x[2]"),
    "sparse_stats": f"with {INDEX} select count(*) as n_docs, round(avg(len(regexp_extract_all(lower(coalesce(chunk_text, '')), '[a-z0-9]+'))), 6) as avgdl from idx",
    "document_frequencies": f"""with {INDEX}, t as (select distinct chunk_id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) as term from idx)
        select term, count(*) as df from t group by term""",
    "sparse_topk": f"{_DENSE}{_SPARSE} select chunk_id, paper_id, round(sparse, 6) as score from sp{_TOP}",
    "hybrid_topk": f"{HYBRID} select chunk_id, paper_id, score from hy",
    "group_papers": f"{HYBRID} select * from gp",
    "rerank_topk": f"""{HYBRID} select hy.*, round(len(list_intersect(list_distinct(w.w), [{_TERMS}])) / {len(set(TEXT.split()))}, 6) as rerank_score
        from hy join w using (chunk_id)""",
    "expand_chunks": f"""{HYBRID},
        o as (select chunk_id, d.paper_id, round(dense, 6) as score, n_chunks, row_number() over (partition by d.paper_id order by round(dense, 6) desc, chunk_id) as r
              from d join gp on gp.paper_id = d.paper_id where n_chunks < 3),
        n as (select *, row_number() over (partition by paper_id order by score desc, chunk_id) as p from o where r <= 6 and chunk_id not in (select chunk_id from hy))
        select chunk_id, paper_id, score from n where p <= 3 - n_chunks""",
    "best_chunks": f"""{_DENSE} select chunk_id, paper_id, round(dense, 6) as score,
        row_number() over (partition by paper_id order by round(dense, 6) desc, chunk_id) as pos from d qualify pos <= 6""",
    "search_papers": _SEARCH,
    "index_stats": f"""with {INDEX}, w as (select *, len(regexp_extract_all(lower(coalesce(chunk_text, '')), '[a-z0-9]+')) as dl,
            case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) then len(embedding) else 0 end as dim from idx)
        select count(*) as entries, count(*) filter (dim > 0) as vectors, count(distinct paper_id) as papers, sum(dl)::bigint as words,
        round(count(*) filter (dim > 0) / greatest(count(*), 1), 6) as fullness, sum(4 * dim + coalesce(length(chunk_text), 0))::bigint as bytes from w""",
    "chunk_metadata": f"""{HYBRID}, f as (select gp.*, string_split(chunks, ',')[1] as first_chunk from gp)
        select f.paper_id, first_chunk, title, year, chunk_type from f join idx on idx.chunk_id = first_chunk""",
    "search_chunks": f"""{HYBRID} select rk.paper_id, rk.chunk_id, chunk_type, section_heading, score, rank, chunk_text[:800] as snippet
        from rk join idx on idx.chunk_id = rk.chunk_id""",
    "learning_path": _PATH
    + f""" select step, paper_id, title, year::int as year, abstract, citation_count::int as citations, coalesce(array_to_string(authors, ', '), '') as authors,
        {field("coalesce(categories[1], primary_category)")} as field, pdf_url, similarity, position, has_citation_link,
        {strip("coalesce(nullif(title, ''), paper_id)")} as why_read from linked left join cur on pid = paper_id""",
    "path_coverage": _PATH + " select round_even(sum(has_citation_link::int) / greatest(count(*) - 1, 1), 2) as coverage, count(*) as steps from linked",
}
