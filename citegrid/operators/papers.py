"""Validation, versions and metadata of paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import METHOD_TERMS, KEYWORD_STOPWORDS
from .orphans import bare_id


def clean_authors(c: Column) -> Column:
    return F.filter(F.transform(c, T.strip), lambda x: x.isNotNull() & (x != ""))


def reject_reasons(latest_year: int) -> Column:
    """Why a record is not valid; empty for valid ones. The title's length counts before stripping, the abstract's before and after."""
    rules = {
        "id": F.coalesce(F.length("id"), F.lit(0)) < 1,
        "title": ~F.coalesce(F.length("title").between(10, 1000), F.lit(False)),
        "abstract": ~F.coalesce((F.length("abstract") >= 50) & (F.length(T.strip(F.col("abstract"))) >= 50), F.lit(False)),
        "authors": F.coalesce(F.size(clean_authors(F.col("authors"))), F.lit(0)) < 1,
        "year": ~F.coalesce(F.col("year").between(1990, latest_year), F.lit(False)),
        "published": F.col("published").isNull(),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def validate(papers: DataFrame, latest_year: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): valid rows with stripped texts, every other column kept; rejects as (paper_id, error)."""
    marked = papers.withColumn("_why", reject_reasons(latest_year))
    valid = marked.where(F.size("_why") == 0).drop("_why")
    valid = valid.withColumns(
        {
            "title": T.strip(F.col("title")),
            "abstract": T.strip(F.col("abstract")),
            "authors": clean_authors(F.col("authors")),
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
        }
    )
    rejects = marked.where(F.size("_why") > 0).select(F.col("id").alias("paper_id"), F.concat_ws(",", "_why").alias("error"))
    return valid, rejects


def dedup_latest(papers: DataFrame, arrival: str = "ingested_at", keep_latest: bool = True, base: Column | None = None) -> DataFrame:
    """One row per id without version: of the highest version (or of any), the first to arrive."""
    base = T.base_id(F.col("id")) if base is None else base
    order = [F.col(arrival).asc_nulls_last(), F.col("id")]
    if keep_latest:
        order = [T.id_version(F.col("id")).desc(), *order]
    w = W.partitionBy("base_id").orderBy(*order)
    return papers.withColumn("base_id", base).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def metadata(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Flat metadata of index entries; papers has one row per id."""
    p = papers.select(F.col("id").alias("paper_id"), "abstract", "authors", "categories", "pdf_url", "source", F.col("citation_count").alias("cites"))
    j = chunks.join(p, "paper_id", "left")
    zero = F.lit(0)
    return j.select(
        "chunk_id",
        F.coalesce("paper_id", "chunk_id").alias("paper_id"),
        F.substring(F.coalesce("title", F.lit("")), 1, 500).alias("title"),
        F.substring(F.coalesce("abstract", F.lit("")), 1, 1000).alias("abstract"),
        F.substring(F.coalesce(F.concat_ws(", ", F.slice("authors", 1, 10)), F.lit("")), 1, 500).alias("authors"),
        F.coalesce(F.size("authors"), zero).alias("author_count"),
        F.substring(F.coalesce(F.concat_ws(",", F.slice("categories", 1, 10)), F.lit("")), 1, 200).alias("categories"),
        F.coalesce("primary_category", F.lit("")).alias("primary_category"),
        T.field_of(F.col("primary_category")).alias("field"),
        F.coalesce("year", zero).alias("year"),
        F.coalesce("published", F.lit("")).alias("published"),
        F.coalesce("cites", "citation_count", zero).alias("citation_count"),
        T.citation_tier(F.coalesce("cites", "citation_count", zero)).alias("citation_tier"),
        F.coalesce(T.has_code(F.col("abstract")), F.lit(False)).alias("has_code"),
        F.coalesce(T.is_survey(F.col("title")), F.lit(False)).alias("is_survey"),
        "chunk_type",
        F.substring(F.coalesce("section_heading", F.lit("")), 1, 200).alias("section_heading"),
        F.substring(F.coalesce("chunk_text", F.lit("")), 1, 800).alias("snippet"),
        F.coalesce("is_fulltext", F.lit(False)).alias("is_fulltext"),
        F.coalesce("pdf_url", F.lit("")).alias("pdf_url"),
        F.coalesce("source", F.lit("arxiv")).alias("source"),
    )


def keyword_weights(papers: DataFrame) -> DataFrame:
    """(id, word, weight): frequency in title and abstract, tripled for words of the title, plus 5 for terms of method."""
    pattern = F.lit(r"\b[a-z][a-z\-]{2,}\b")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(KEYWORD_STOPWORDS)])
    terms = F.array(*[F.lit(t) for t in METHOD_TERMS])
    # array_except and array_contains hash the constant list once; a text's words are exploded and counted with map-side combine
    words = papers.select("id", F.explode(F.regexp_extract_all(text, pattern, F.lit(0))).alias("word"))
    words = words.where(~F.array_contains(stop, F.col("word"))).groupBy("id", "word").agg(F.count("*").alias("n"))
    heads = papers.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), pattern, F.lit(0)))).alias("word")).withColumn("t", F.lit(True))
    found = papers.select("id", text.alias("x")).select("id", F.explode(terms).alias("term"), "x").where(F.col("x").contains(F.col("term")))
    found = found.select("id", F.replace("term", F.lit(" "), F.lit("-")).alias("word"), F.lit(5).alias("plus"))
    freq = words.join(heads.distinct(), ["id", "word"], "left").withColumn("n", F.when(F.col("t"), F.col("n") * 3).otherwise(F.col("n")))
    both = freq.join(found, ["id", "word"], "full")
    return both.select("id", "word", (F.coalesce("n", F.lit(0)) + F.coalesce("plus", F.lit(0))).alias("weight"))


def keywords(papers: DataFrame, top_k: int = 8) -> DataFrame:
    """(id, keywords): up to four terms of method as listed, then the heaviest words that are no part of those already taken."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    terms = F.array(*[F.lit(t) for t in METHOD_TERMS])
    methods = papers.select("id", F.slice(F.filter(F.transform(terms, lambda t: F.when(F.contains(text, t), t)), lambda t: t.isNotNull()), 1, 4).alias("methods"))
    w = W.partitionBy("id").orderBy(F.desc("weight"), "word")
    top = keyword_weights(papers).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * top_k)
    lists = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("ranked"))
    take = F.aggregate(
        F.transform("ranked", lambda x: x["word"]),
        F.col("methods"),
        lambda acc, word: F.when((F.size(acc) < top_k) & ~F.contains(F.concat_ws(" ", acc), word), F.concat(acc, F.array(word))).otherwise(acc),
    )
    return methods.join(lists, "id", "left").select("id", F.slice(F.coalesce(take, F.col("methods")), 1, top_k).alias("keywords"))


def enriched_text(papers: DataFrame) -> DataFrame:
    """One chunk per paper: where it is from, first authors, keywords, abstract without filler."""
    clean = papers.withColumn("abstract", T.clean_abstract(F.coalesce("abstract", F.lit(""))))
    j = clean.join(keywords(clean), "id", "left")
    first = F.concat_ws(", ", F.slice("authors", 1, 3))
    more = F.when(F.size("authors") > 3, F.concat(F.lit(" (+"), (F.size("authors") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    category = F.coalesce(F.get(F.col("categories"), F.lit(0)), F.col("primary_category"))
    head = F.concat(F.lit("["), T.field_of(category), F.lit(" | "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("] "), T.strip(F.coalesce("title", F.lit(""))))
    body = F.concat_ws(
        "\n",
        head,
        F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, F.concat(F.lit("Authors: "), first, more)),
        F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.concat_ws(", ", "keywords"))),
        "abstract",
    )
    return j.select(F.col("id").alias("chunk_id"), F.lit("full").alias("chunk_type"), body.alias("chunk_text"))


def enrich_citations(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Papers updated from citations(arxiv_id, s2_id, citation_count, influential_citations, references, cited_by); what is not found stays."""
    new = citations.select("arxiv_id", *[F.col(c).alias(f"_{c}") for c in ("s2_id", "citation_count", "influential_citations", "references", "cited_by")])
    j = papers.join(new, "arxiv_id", "left")
    cols = {c: F.coalesce(f"_{c}", c) for c in ("s2_id", "citation_count", "influential_citations", "references", "cited_by")}
    return j.withColumns(cols).select(*papers.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key does not come anew, and the new ones."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unseen(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(stored.select(key), key, "left_anti")


def paper_key(c: Column) -> Column:
    """The bare id with its prefix: the form in which current_papers and the graph name a paper."""
    return F.concat(F.lit("arxiv:"), bare_id(c))


def current_papers(papers: DataFrame) -> DataFrame:
    """The collection that the graph and the index are built on: latest versions, keyed by their bare id with its prefix. The key is made of what
    the versions are grouped by, so a filter on it goes below the choice of the version."""
    latest = dedup_latest(papers, base=bare_id(F.col("id")))
    return latest.withColumn("id", F.concat(F.lit("arxiv:"), "base_id")).drop("base_id")
