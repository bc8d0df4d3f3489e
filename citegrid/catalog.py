"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.orphans import paper_orphans
from .queries import graph, papers, retrieval, sources, support
from .session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of papers that name no paper, a deleted one, or one that came later."""
    got = paper_orphans(table(spark, sf_dir, "papers"), table(spark, sf_dir, "withdrawals"))
    return got.select(F.col("owner").alias("paper_id"), "field", F.col("key").alias("ref_id")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per field, period (year of the enrichment) and reason."""
    got = paper_orphans(table(spark, sf_dir, "papers"), table(spark, sf_dir, "withdrawals")).distinct()
    period = F.year("as_of").alias("period")
    return got.groupBy("field", period, "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("key").alias("n_keys"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_report": p3_report, **graph.QUERIES, **retrieval.QUERIES, **papers.QUERIES, **support.QUERIES, **sources.QUERIES}

#: Orphan references in SQL: papers, withdrawals -> o(paper_id, field, ref_id, as_of, reason).
_BARE = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^(arxiv:|abs/)\s*', ''), 'v[0-9]+$', '')"
_ORPHANS = f"""
    with live as (select {_BARE.format("id")} as k, min(ingested_at) as arrived from papers where id is not null group by 1),
    gone as (select distinct {_BARE.format("paper_id")} as k from withdrawals where restored_at is null),
    e as (select id, enriched_at, 'references' as field, unnest("references") as r from papers
          union all select id, enriched_at, 'cited_by', unnest(cited_by) from papers),
    r as (select distinct id as paper_id, field, {_BARE.format("r")} as ref_id, enriched_at as as_of from e where regexp_matches(r, '\\S')),
    o as (select r.*, case when live.k is null or arrived is null then 'missing' when gone.k is not null then 'deleted'
                           when arrived > as_of then 'late' end as reason
          from r left join live on live.k = r.ref_id left join gone on gone.k = r.ref_id)"""
ORACLES: dict[str, str] = {
    "p3_found": _ORPHANS + " select distinct paper_id, field, ref_id from o where reason is not null",
    "p3_report": _ORPHANS
    + """ select field, year(as_of) as period, reason, count(*) as n_refs, count(distinct ref_id) as n_keys
          from o where reason is not null group by all""",
    **graph.ORACLES,
    **retrieval.ORACLES,
    **papers.ORACLES,
    **support.ORACLES,
    **sources.ORACLES,
}
