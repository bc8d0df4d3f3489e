"""Chunks of full texts: a greedy fold over paragraphs and sentences, one section at a time.

The fold depends on what it has packed before, so it runs in Arrow batches; sections that fit whole, most of them, never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .papers import paper_key

WORD = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def count(s: str) -> int:
    return len(WORD.findall(s))


def sentence_list(s: str) -> list[str]:
    return [x.strip() for x in SENTENCE.split(re.sub(r"\n+", " ", s)) if x.strip()]


def cut_tokens(s: str, budget: int) -> list[str]:
    """The string in pieces of `budget` tokens, the last of at most as many; nothing but white space between them is lost."""
    ends = [m.end() for m in WORD.finditer(s)]
    at = [0, *ends[budget - 1 : -1 : budget], len(s)]
    return [s[a:b].strip() for a, b in zip(at, at[1:])]


def pack_sentences(paragraph: str, budget: int, least: int) -> Iterator[str]:
    """Sentences up to the budget, each piece beginning with the last sentence of the one before; a sentence that begins a piece and is over
    the budget is cut into pieces of it, what is left begins the next; a last piece under `least` tokens takes over more of the one before
    as far as the budget allows. Without a budget an empty piece comes first, then pieces of the least size."""
    held: list[str] = []
    before: list[str] = []
    size = 0
    if budget < 1:
        yield ""
        budget = max(least, 1)
    every = sentence_list(paragraph)
    if not every:
        yield paragraph[: budget * 4]
    for s in every:
        n = count(s)
        if size + n <= budget:
            held.append(s)
            size += n
        elif held:
            yield " ".join(held)
            before, held = held[:-1], [held[-1], s]
            size = count(held[0]) + n
        else:
            *pieces, rest = cut_tokens(s, budget)
            yield from pieces
            before, held, size = [], [rest], count(rest)
    while before and size < least and size + count(before[-1]) <= budget:
        size += count(before[-1])
        held.insert(0, before.pop())
    if held:
        yield " ".join(held)


def pack_paragraphs(text: str, budget: int, least: int, overlap: int) -> Iterator[str]:
    """Paragraphs up to the budget; a new piece takes over the last sentence if that is short; too long ones go by sentences.
    A last piece is kept however short."""
    if count(text) <= budget:
        yield text
        return
    held: list[str] = []
    size = 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        n = count(p)
        if size + n <= budget:
            held.append(p)
            size += n
            continue
        if held:
            yield "\n\n".join(held)
        if n > budget:
            yield from pack_sentences(p, budget, least)
            held, size = [], 0
            continue
        tail = (sentence_list(held[-1]) or [""])[-1] if held else ""
        keep = bool(tail) and count(tail) < 2 * overlap
        held, size = ([tail, p], count(tail) + n) if keep else ([p], n)
    if held:
        yield "\n\n".join(held)


def latest_parsed(parsed: DataFrame) -> DataFrame:
    """One full text per paper, under the paper's key: of the highest version, the first parsed."""
    order = [T.id_version(F.lower(T.strip(F.col("paper_id")))).desc(), *(F.col(c).asc_nulls_last() for c in ("parsed_at",) if c in parsed.columns), F.col("paper_id")]
    keyed = parsed.withColumn("_r", F.row_number().over(W.partitionBy(paper_key(F.col("paper_id"))).orderBy(*order))).where("_r = 1").drop("_r")
    return keyed.withColumn("paper_id", paper_key(F.col("paper_id")))


def sections_of(parsed: DataFrame) -> DataFrame:
    """Sections with their type by heading and position; of sections that begin alike only the first stays."""
    n = F.greatest(F.size("sections"), F.lit(1))
    s = parsed.select("paper_id", n.alias("n"), F.posexplode("sections").alias("section_index", "s"))
    s = s.select("paper_id", "section_index", F.col("s.heading").alias("heading"), F.col("s.text").alias("text"), T.section_type(F.col("s.heading"), F.col("section_index") / F.col("n")).alias("section_type"))
    w = W.partitionBy("paper_id", F.substring("text", 1, 200)).orderBy("section_index")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chunk_papers(papers: DataFrame, parsed: DataFrame, largest: int = 600, least: int = 100, overlap: int = 50) -> DataFrame:
    """(chunk_id, paper_id, chunk_type, section_heading, section_index, chunk_index, chunk_text) of papers that are parsed, under the
    papers' ids. Papers and full texts meet without their versions."""
    p = papers.select(F.col("id").alias("paper_id"), paper_key(F.col("id")).alias("key"), "title", F.coalesce(F.get(F.col("categories"), F.lit(0)), F.col("primary_category")).alias("cat"), "year", "abstract")
    one = latest_parsed(parsed)
    secs = sections_of(one).where(T.kept_section(F.col("section_type")) & (T.token_count(F.coalesce("text", F.lit(""))) >= least)).withColumnRenamed("paper_id", "key").join(p, "key")
    prefix = T.context_prefix(F.col("cat"), F.col("year"), F.col("title"), F.col("heading"))
    secs = secs.withColumn("prefix", prefix).withColumn("budget", F.lit(largest - 5) - T.token_count(prefix))
    fits = T.token_count(F.col("text")) <= F.col("budget")
    cols = ["paper_id", "section_index", "heading", "section_type", "prefix"]
    whole = secs.where(fits).select(*cols, F.lit(0).alias("chunk_index"), F.col("text").alias("body"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, idx, body = [], [], []
            for i, (t, budget) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist())):
                for j, piece in enumerate(pack_paragraphs(t, budget, least, overlap)):
                    row.append(i)
                    idx.append(j)
                    body.append(piece)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(5)), pa.array(idx, pa.int32()), pa.array(body, pa.string())], names=[*cols, "chunk_index", "body"])

    large = secs.where(~fits).select(*cols, "text", "budget")
    split = large.mapInArrow(fold, "paper_id string, section_index int, heading string, section_type string, prefix string, chunk_index int, body string")
    both = whole.unionByName(split)
    chunks = both.select(
        F.concat("paper_id", F.lit("_s"), F.col("section_index").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "paper_id",
        F.col("section_type").alias("chunk_type"),
        F.col("heading").alias("section_heading"),
        "section_index",
        "chunk_index",
        F.concat("prefix", F.lit("\n"), "body").alias("chunk_text"),
    )
    abstract = F.coalesce(F.when(F.col("abstract") != "", F.col("abstract")), F.col("abstract_text"))
    heads = one.select(F.col("paper_id").alias("key"), "abstract_text").join(p, "key").withColumn("a", abstract).where(T.token_count(F.coalesce("a", F.lit(""))) >= least)
    heads = heads.select(
        F.concat("paper_id", F.lit("_abstract")).alias("chunk_id"),
        "paper_id",
        F.lit("abstract").alias("chunk_type"),
        F.lit("Abstract").alias("section_heading"),
        F.lit(-1).alias("section_index"),
        F.lit(0).alias("chunk_index"),
        F.concat(T.context_prefix(F.col("cat"), F.col("year"), F.col("title"), F.lit("Abstract")), F.lit("\n"), "a").alias("chunk_text"),
    )
    return heads.unionByName(chunks)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    per = chunks.select("paper_id", "chunk_type", T.token_count(F.col("chunk_text")).alias("n"))
    return per.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.count_distinct("paper_id").alias("papers"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.bround(F.avg("n"), 2).alias("avg_tokens"))
