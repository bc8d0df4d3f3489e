"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..functions.fixed import FIELDS


def bare(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '^(arxiv:|abs/)\s*', ''), 'v[0-9]+$', '')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def version(c: str) -> str:
    return f"coalesce(try_cast(case when {c} like '%v%' then string_split({c}, 'v')[-1] end as int), 0)"


def field(c: str, table: dict[str, str] = FIELDS) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"case split_part(coalesce({c}, ''), '.', 1) {whens} else 'Other' end"


#: One entry per chunk, vectors of the right length, the first of them and the second.
INDEX = """
    idx as (select * from chunks qualify row_number() over (partition by chunk_id order by created_at desc) = 1),
    vec as (select * from idx where len(embedding) = 96),
    q as (select embedding::double[] as v from vec where is_fulltext order by chunk_id limit 1),
    h as (select embedding::double[] as v from vec where is_fulltext order by chunk_id limit 1 offset 1)"""

#: The latest version of each paper.
CURRENT = f"""
    cur as (select *, 'arxiv:' || {bare("id")} as pid from papers
            qualify row_number() over (partition by {bare("id")} order by {version("id")} desc, ingested_at nulls last, id) = 1)"""

#: The graph's tables.
GRAPH = rf"""
    with recursive {CURRENT},
    known as (select pid as id, title, year::int as year, citation_count::int as citation_count, {field("coalesce(categories[1], primary_category)")} as field from cur),
    cites as (
        select distinct pid as src, 'arxiv:' || {bare("r")} as dst from (select pid, unnest("references") as r from cur) where regexp_matches(r, '\S')
        union select 'arxiv:' || {bare("r")}, pid from (select pid, unnest(cited_by) as r from cur) where regexp_matches(r, '\S')),
    nodes as (select coalesce(e.id, k.id) as id, title, year, citation_count, field
              from (select src as id from cites union select dst from cites) e full join known k on e.id = k.id),
    authored as (select distinct pid as paper, {strip("a")} as name from (select pid, unnest(authors[1:20]) as a from cur) where {strip("a")} <> ''),
    in_cat as (select distinct pid as paper, c as category from (select pid, unnest(categories[1:10]) as c from cur) where c is not null),
    near as (select src, dst from cites union all select dst, src from cites),
    titled as (select * from known where title is not null),
    coauthored as (select x.name as a, y.name as b, count(*) as papers from authored x join authored y on x.paper = y.paper and x.name < y.name group by all),
    seeds as (select src as id from cites group by src order by count(*) desc, src limit 10),
    cited as (select dst as id from cites group by dst order by count(*) desc, dst limit 1),
    seed as (select src as id from cites group by src order by count(*) desc, src limit 1)"""
