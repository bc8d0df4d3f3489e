"""Queries of the operators in this folder, by name; ORACLES holds the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .mixing import mix
from .names import link_names, name_pairs
from .neardup import near_classes, near_pairs
from .neighbors import similar_vectors
from .packing import container_report, pack, window_report
from .quality import FIELDS, columns_of, text_quality
from .segment import split_oversized
from .tokens import offer, sized
from .tokens import sizes as token_sizes

#: Tokens of a container.
CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which at least one is among the 10 most similar of the other."""
    near = similar_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", dim=96, k=10)
    return near.select(F.least("id", "neighbor").alias("chunk_a"), F.greatest("id", "neighbor").alias("chunk_b")).distinct()


def _near_papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return near_classes(table(spark, sf_dir, "papers"), "id", text, size=3, threshold=0.6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of papers with similar title and abstract."""
    return near_pairs(*_near_papers(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper and text: the ids with an equal set of runs, and links to other texts."""
    members, links = _near_papers(spark, sf_dir)
    ends = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class")))
    degree = ends.groupBy("class").agg(F.count("*").alias("links"))
    head = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    got = members.join(head, "class").join(degree, "class", "left")
    return got.select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and chunks as (item, text)."""
    papers, chunks = table(spark, sf_dir, "parsed_papers"), table(spark, sf_dir, "chunks")
    section = papers.select("paper_id", F.posexplode("sections").alias("pos", "s")).select(
        F.struct(F.lit("parsed_papers").alias("t"), F.concat("paper_id", F.lit("#"), F.col("pos").cast("string")).alias("k")).alias("item"),
        F.col("s.text").alias("text"),
    )
    chunk = chunks.select(F.struct(F.lit("chunks").alias("t"), F.col("chunk_id").alias("k")).alias("item"), F.col("chunk_text").alias("text"))
    return section.unionByName(chunk).where(F.col("item.k").isNotNull())


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the texts that were split."""
    got = split_oversized(_texts(spark, sf_dir), "item", "text").where(F.col("pieces") > 1).distinct()
    return got.select(F.col("key.t").alias("table_name"), F.col("key.k").alias("item_key"), "piece", "pieces", "n_tokens", "start", "end", "text")


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the pieces, which have none: over the limit, gaps between neighbours, other characters than the text's, ends left out."""
    texts = _texts(spark, sf_dir)
    got = cut_lineage(split_oversized(texts, "item", "text").where(F.col("pieces") > 1).distinct())
    last = F.max_by("end", "piece")
    per = got.groupBy("key").agg(
        F.count("*").alias("n"),
        F.max("pieces").alias("pieces"),
        F.max("n_tokens").alias("most"),
        F.min("start").alias("first"),
        last.alias("last"),
        F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"),
    )
    gap = F.exists(F.zip_with(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, F.size("p") - 1), lambda b, a: (b["start"] > a["end"]) | (b["start"] <= a["start"])), lambda x: x)
    j = per.join(texts.select(F.col("item").alias("key"), F.col("text").alias("whole")).distinct(), "key")
    other = F.exists("p", lambda x: F.substring(F.col("whole"), x["start"] + 1, x["end"] - x["start"]) != x["text"])
    return j.groupBy(F.col("key.t").alias("table_name")).agg(
        F.count("*").alias("items"),
        F.count_if((F.col("most") > 600) | (F.col("n") != F.col("pieces"))).alias("over_limit"),
        F.count_if(gap).alias("gaps"),
        F.count_if(other).alias("not_the_text"),
        F.count_if((F.col("first") != 0) | (F.col("last") != F.length("whole"))).alias("ends_missing"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that came out of the splitter in more than one piece."""
    got = split_oversized(_texts(spark, sf_dir), "item", "text").where((F.col("pieces") > 1) & (F.col("piece") == 0))
    return got.select(F.col("key.t").alias("table_name"), F.col("key.k").alias("item_key")).distinct()


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = table(spark, sf_dir, "authors")
    rows = authors.select(F.col("author_id").alias("id"), "name", "affiliation", F.col("paper_count").alias("freq"))
    return link_names(rows, table(spark, sf_dir, "given_name_forms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of authors whose names mean one person or organisation."""
    return name_pairs(_linked(spark, sf_dir)).select(F.col("id_a").alias("author_a"), F.col("id_b").alias("author_b"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author with the smallest author_id of its entity."""
    got = _linked(spark, sf_dir)
    head = got.groupBy("entity").agg(F.min("id").alias("entity_id"), F.count_distinct("id").alias("spellings"))
    return got.join(head, "entity").select(F.col("id").alias("author_id"), "entity_id", "spellings")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_targets").select("source", F.col("target_share").alias("share"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of CAPACITY tokens, sources mixed in the wanted proportions."""
    # sizes are read four times: tokenize once
    sizes = cut_lineage(sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return pack(sizes, _shares(spark, sf_dir), CAPACITY).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and how full they are."""
    return container_report(p6_pack(spark, sf_dir), CAPACITY)


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has of each window of containers, beside its target."""
    return window_report(p6_pack(spark, sf_dir), _shares(spark, sf_dir))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the packing, which has none: documents not packed whole, pieces given twice, cut without need, containers over capacity."""
    packed = cut_lineage(p6_pack(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id")
    per = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("part_no").alias("kinds"), F.max("parts").alias("parts"), F.sum("tokens").alias("tokens"))
    j = docs.join(per, "doc_id", "full")
    items = j.agg(
        F.count("*").alias("documents"),
        F.count_if(~F.coalesce(F.col("kinds") == F.col("parts"), F.lit(False))).alias("not_whole"),
        F.count_if(F.col("n") > F.col("parts")).alias("twice"),
        F.count_if((F.col("parts") > 1) & (F.col("tokens") <= CAPACITY)).alias("cut_without_need"),
    )
    over = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("over_capacity"))
    return items.join(over)  # one row each


def _weighed(docs: DataFrame) -> DataFrame:
    """(id, source, size, weight) of documents with a text, in one pass over the texts: tokens, and 0.1 to 1 by the share of prose."""
    offer(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "source", "text")
    share = [f[0] for f in FIELDS].index("prose_share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = pc.add(pc.multiply(columns_of(b.column(2))[share], 0.9), 0.1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), token_sizes(b.column(2)), weight], names=["id", "source", "size", "weight"])

    return rows.mapInArrow(run, "id bigint, source string, size bigint, weight double")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(_weighed(table(spark, sf_dir, "documents")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    return mix(rows, table(spark, sf_dir, "source_targets"), total)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and how often each is used, for as many tokens as the table has; better prose is likelier."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by source."""
    return _mixed(spark, sf_dir)[1]


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the mix, which has none: documents used too often or selected that may not be, sources over budget, and epochs not complete
    before a part of the next begins; beside the number of listed sources."""
    sel, rep = _mixed(spark, sf_dir)
    sel = cut_lineage(sel)
    rule = table(spark, sf_dir, "source_targets").where(F.col("source").isNotNull()).groupBy("source").agg(F.max("max_repeats").alias("most"))
    per = sel.groupBy("source").agg(F.max("uses").alias("high"), F.min("uses").alias("low"), F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).groupBy("source").agg(F.count("*").alias("docs"))
    j = per.join(rule, "source", "left").join(docs, "source", "left")
    # all documents of the source have been used once more than `low` or as often; fewer documents than there are means that some have none
    torn = (F.col("high") - F.when(F.col("n") < F.col("docs"), 0).otherwise(F.col("low"))) > 1
    faults = j.agg(F.count_if(F.col("high") > F.coalesce("most", F.lit(0))).alias("too_often"), F.count_if(F.col("most").isNull()).alias("not_listed"), F.count_if(torn).alias("torn_epochs"))
    return faults.join(rep.agg(F.count("*").alias("sources"), F.count_if(F.col("missing") < 0).alias("over_budget")))  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which more than half, by characters, is no natural prose."""
    got = text_quality(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.where(~F.col("is_prose")).select(F.col("id").alias("doc_id"))


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics and reasons per document."""
    got = text_quality(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    return got.withColumn("reasons", F.array_join("reasons", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p6_pack": p6_pack,
    "p6_report": p6_report,
    "p6_windows": p6_windows,
    "p6_whole": p6_whole,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_whole": p7_whole,
    "p4_whole": p4_whole,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}

#: Token of problem 4 for the SQL engine.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x85]"

#: Word runs of papers in SQL: s(id, run), n(id, n).
_RUNS = """
    with w as (select distinct id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[a-z0-9]+') as w
               from papers where id is not null),
    t as (select id, w, string_agg(x, ' ' order by x) as k, count(*) as n
          from (select distinct id, w, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as x from (select id, w, unnest(range(1, len(w) - 1)) as i from w))
          group by id, w),
    s as (select distinct id, w, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as x from (select id, w, unnest(range(1, len(w) - 1)) as i from w)),
    bo as (select a.id as a, a.w as wa, b.id as b, b.w as wb, count(*) as c from s a join s b on a.x = b.x and (a.id, a.w) < (b.id, b.w)
             group by all),
    sim as (select a, b, ta.k as ka, tb.k as kb, c / (ta.n + tb.n - c) as j from bo
            join t ta on ta.id = a and ta.w = wa join t tb on tb.id = b and tb.w = wb)"""

ORACLES: dict[str, str] = {
    "p2_found": _RUNS + " select distinct a as id_a, b as id_b from sim where j >= 0.6 - 1e-12 and a <> b",
    "p2_classes": _RUNS
    + """, h as (select k, min(id) as class_id, count(*) as class_size from (select distinct id, k from t) group by k),
        e as (select distinct least(ka, kb) as x, greatest(ka, kb) as y from sim where j >= 0.6 - 1e-12 and ka <> kb),
        d as (select k, count(*) as links from (select x as k from e union all select y from e) group by k)
        select m.id, class_id, class_size, coalesce(links, 0) as links from (select distinct id, k from t) m join h using (k) left join d using (k)""",
    "p4_found": rf"""
        with s as (select paper_id, unnest(sections) as s, unnest(range(len(sections))) as pos from parsed_papers),
        t as (
            select 'parsed_papers' as table_name, paper_id || '#' || pos as item_key, s."text" as x from s
            union all select 'chunks', chunk_id, chunk_text from chunks)
        select distinct table_name, item_key from t
        where item_key is not null and length(x) > 600 and len(regexp_extract_all(x, '{_TOKEN}')) > 600""",
    "p6_whole": """select count(*) as documents, 0::bigint as not_whole, 0::bigint as twice, 0::bigint as cut_without_need, 0::bigint as over_capacity
        from documents where text is not null""",
    "p7_whole": """select 0::bigint as too_often, 0::bigint as not_listed, 0::bigint as torn_epochs, count(distinct source) as sources, 0::bigint as over_budget
        from source_targets where source is not null""",
    "p4_whole": rf"""
        with s as (select paper_id, unnest(sections) as s, unnest(range(len(sections))) as pos from parsed_papers),
        t as (select 'parsed_papers' as table_name, paper_id || '#' || pos as item_key, s."text" as x from s
              union all select 'chunks', chunk_id, chunk_text from chunks)
        select table_name, count(distinct item_key) as items, 0::bigint as over_limit, 0::bigint as gaps, 0::bigint as not_the_text, 0::bigint as ends_missing
        from t where item_key is not null and length(x) > 600 and len(regexp_extract_all(x, '{_TOKEN}')) > 600 group by 1""",
}
