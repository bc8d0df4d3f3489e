"""Dense, sparse and hybrid top-k over chunks; grouping to papers; expansion to sibling chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import few, local

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """What a search reads. entries: one row per chunk_id, the last written, with `dim` (length of a usable vector, else 0), `dl` (words
    of the text) and `tf` (word -> times); postings: (term, chunk_id, paper_id, tf, dl); terms: (term, df); stats: one row (n_docs, avgdl)."""

    entries: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def last_written(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id, the last written."""
    w = W.partitionBy("chunk_id").orderBy(F.desc("created_at"))
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def index_of(chunks: DataFrame) -> Index:
    """The index as plans over chunks. Its only shuffle of whole chunks, by chunk_id, serves the choice of the last written, the counts of
    words and their return to the entry; a search should read a written index (operators.store)."""
    one = last_written(chunks).withColumn("_w", words(F.coalesce("chunk_text", F.lit(""))))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    one = one.withColumn("dim", F.when(finite, F.size("embedding")).otherwise(0)).withColumn("dl", F.size("_w"))
    counted = one.select("chunk_id", F.explode("_w").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("n"))
    per = counted.groupBy("chunk_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "n")))).alias("tf"))
    entries = one.drop("_w").join(per, "chunk_id", "left")
    return tables_of(entries)


def tables_of(entries: DataFrame) -> Index:
    """The tables of words that follow from the entries."""
    postings = entries.select(F.explode("tf").alias("term", "tf"), "chunk_id", "paper_id", "dl").select("term", "chunk_id", "paper_id", "tf", "dl")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = entries.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(entries, postings, terms, stats)


def filters(year_min: int | None = None, year_max: int | None = None, categories: list[str] | None = None, chunk_type: str | None = None) -> Column:
    """Conjunction of what is given; true if nothing is."""
    conds = []
    if year_min is not None:
        conds.append(F.col("year") >= year_min)
    if year_max is not None:
        conds.append(F.col("year") <= year_max)
    if chunk_type is not None:
        conds.append(F.col("chunk_type") == chunk_type)
    if categories:
        conds.append(F.col("primary_category").isin(*categories))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def blend(q: list[float], h: list[float] | None) -> list[float]:
    """Query and expansion in proportion 0.4 to 0.6, not normalised; the query alone without expansion."""
    return list(q) if h is None else [0.4 * a + 0.6 * b for a, b in zip(q, h)]


def interpolate(a: list[float], b: list[float], t: float) -> list[float]:
    return [(1 - t) * x + t * y for x, y in zip(a, b)]


def dot(vec: Column, query: list[float]) -> Column:
    """Inner product with a fixed vector, a whole Arrow batch at once; null for another length or null elements."""
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def product(v: pa.Array) -> pa.Array:
        size = np.asarray(v.value_lengths().fill_null(-1))
        out = np.full(len(v), np.nan)
        at = np.flatnonzero(size == len(q))
        if len(at):
            starts = np.asarray(v.offsets)[: len(v)][at]
            flat = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[at] = flat[(starts[:, None] + np.arange(len(q))).ravel()].reshape(-1, len(q)) @ q
        return pa.array(out, from_pandas=True)

    return product(vec)


def dense_topk(index: Index, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(chunk_id, paper_id, score): the k best. The filter is one on stored columns and reaches the scan."""
    scored = _usable(index, query, where).select("chunk_id", "paper_id", F.round(dot(F.col("embedding"), query), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def _usable(index: Index, query: list[float], where: Column | None) -> DataFrame:
    rows = index.entries.where(F.col("dim") == len(query))
    return rows if where is None else rows.where(where)


# ---------------------------------------------------------------- sparse


def query_terms(query: str) -> list[str]:
    return sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))


def query_weights(index: Index, query: str) -> tuple[dict[str, float], float]:
    """Share of each known term of the query in the whole inverse frequency, and the mean length of a text: a lookup of at most the query's
    terms in the table of terms, and one row of statistics."""
    terms = query_terms(query)
    stats = index.stats.first()
    n, avgdl = stats["n_docs"], stats["avgdl"] or 1.0
    df = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(*terms)).collect()} if terms else {}
    idf = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in sorted(df.items())}
    whole = sum(idf.values()) or 1.0
    return {t: v / whole for t, v in idf.items()}, avgdl


def bm25(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def sparse_topk(index: Index, query: str, k: int) -> DataFrame:
    """(chunk_id, paper_id, score) by the postings of the query's terms alone."""
    share, avgdl = query_weights(index, query)
    of = F.create_map(*[F.lit(x) for t, v in share.items() for x in (t, v)]) if share else F.create_map(F.lit(""), F.lit(0.0))
    hits = index.postings.where(F.col("term").isin(*share))
    scored = hits.groupBy("chunk_id", "paper_id").agg(F.sum(bm25(F.col("tf"), F.col("dl"), avgdl) * of[F.col("term")]).alias("sparse"))
    return scored.select("chunk_id", "paper_id", F.round("sparse", 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def hybrid_topk(index: Index, vector: list[float], query: str | None, k: int, alpha: float = 0.7, where: Column | None = None) -> DataFrame:
    """alpha times dense plus (1 - alpha) times sparse; without a text the dense score, unscaled. Both scores come from the entry's own row: no join."""
    if not query:
        return dense_topk(index, vector, k, where)
    share, avgdl = query_weights(index, query)
    parts = [bm25(F.coalesce(F.try_element_at("tf", F.lit(t)), F.lit(0)), F.col("dl"), avgdl) * v for t, v in share.items()]
    sparse = F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)) if parts else F.lit(0.0)
    score = F.round(alpha * dot(F.col("embedding"), vector) + (1 - alpha) * sparse, 6)
    return _usable(index, vector, where).select("chunk_id", "paper_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def over_fetch(top_k: int, rerank: bool, most: int = 80) -> int:
    return min(top_k * (4 if rerank else 2), most)


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (at most a few dozen rows after a limit) with their rank."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("score"), "chunk_id")))


def texts_of(index: Index, hits: DataFrame, most: int = 200) -> DataFrame:
    """(chunk_id, ...): the entries behind hits, a local report of at most `most` rows. Their ids become a filter of the scan."""
    ids = [r["chunk_id"] for r in few(hits.select("chunk_id"), most)]
    return index.entries.where(F.col("chunk_id").isin(*ids))


def rerank(hits: DataFrame, index: Index, query: str, papers: DataFrame | None = None) -> DataFrame:
    """Deterministic offline reranker: share of the query's words that the text has. The text is the chunk's, or where that is empty the
    paper's title and abstract; no hit is lost. papers(id, title, abstract): one row per id."""
    terms = sorted(set(query.lower().split()))
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    j = hits.join(texts_of(index, hits).select("chunk_id", "chunk_text"), "chunk_id", "left")
    text = F.when(F.coalesce("chunk_text", F.lit("")) != "", F.col("chunk_text"))
    if papers is not None:
        named = papers.where(F.col("id").isin(*{r["paper_id"] for r in few(hits.select("paper_id"), 200)})).select(F.col("id").alias("paper_id"), F.concat_ws(". ", "title", "abstract").alias("record"))
        j = j.join(named, "paper_id", "left")
        text = F.coalesce(text, "record")
    hit = F.size(F.array_intersect(words(F.coalesce(text, F.lit(""))), wanted)) / F.lit(max(1, len(terms)))
    return j.withColumn("rerank_score", F.round(hit, 6)).select(*hits.columns, "rerank_score")


def group_papers(hits: DataFrame, k: int) -> DataFrame:
    """hits: (chunk_id, paper_id, score, rerank_score, rank) -> one row per paper, best first; a rerank score of 0 counts as none."""
    value = F.when(F.col("rerank_score").isNotNull() & (F.col("rerank_score") != 0), F.col("rerank_score")).otherwise(F.col("score"))
    g = hits.withColumn("value", value).groupBy(F.coalesce("paper_id", "chunk_id").alias("paper_id"))
    best = F.max_by(F.struct("score", "rerank_score"), F.struct("value", -F.col("rank")))
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    out = g.agg(F.max("value").alias("best_score"), best.alias("b"), F.min("rank").alias("first_rank"), F.array_join(F.transform(listed, lambda x: x["chunk_id"]), ",").alias("chunks"), F.count("*").alias("n_chunks"))
    out = out.select("paper_id", "best_score", F.col("b.rerank_score").alias("rerank_score"), "first_rank", "chunks", "n_chunks")
    return out.orderBy(F.desc("best_score"), "first_rank").limit(k)


def with_metadata(papers: DataFrame, index: Index) -> DataFrame:
    """Grouped papers with the metadata of their first chunk in rank order; null where the index has no such column."""
    head = papers.withColumn("chunk_id", F.split_part("chunks", F.lit(","), F.lit(1)))
    meta = {"title": "string", "year": "int", "primary_category": "string", "citation_count": "int", "published": "string", "chunk_type": "string", "section_heading": "string"}
    cols = [F.col(c) if c in index.entries.columns else F.lit(None).cast(t).alias(c) for c, t in meta.items()]
    found = texts_of(index, head).select("chunk_id", *cols)
    return head.join(found, "chunk_id", "left").withColumnRenamed("chunk_id", "first_chunk")


def matched_chunks(hits: DataFrame, index: Index, width: int = 800) -> DataFrame:
    """(paper_id, chunk_id, chunk_type, section_heading, score, rerank_score, rank, snippet): the chunks behind the papers of a result."""
    found = texts_of(index, hits).select("chunk_id", "chunk_type", "section_heading", F.substring("chunk_text", 1, width).alias("snippet"))
    return hits.join(found, "chunk_id", "left").select("paper_id", "chunk_id", "chunk_type", "section_heading", "score", "rerank_score", "rank", "snippet")


def expand(papers: DataFrame, hits: DataFrame, index: Index, vector: list[float], top: int = 5, full: int = 3, fetch: int = 6) -> DataFrame:
    """Further chunks of the first `top` papers that have under `full`: one scan filtered by their ids, ranked per paper by the unscaled dense score."""
    first = {r["paper_id"]: r["n_chunks"] for r in few(papers.orderBy(F.desc("best_score"), "first_rank").limit(top).select("paper_id", "n_chunks"), top) if r["n_chunks"] < full}
    firsts = local(hits.sparkSession, list(first.items()), "paper_id string, n_chunks bigint")
    own = _usable(index, vector, F.col("paper_id").isin(*first)).select("chunk_id", "paper_id", F.round(dot(F.col("embedding"), vector), 6).alias("score"))
    w = W.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id")
    best = own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fetch)
    new = best.join(hits.select("chunk_id"), "chunk_id", "left_anti").withColumn("r", F.row_number().over(w)).join(firsts, "paper_id")
    return new.where(F.col("r") <= full - F.col("n_chunks")).select("chunk_id", "paper_id", "score", F.lit(None).cast("double").alias("rerank_score"))
