"""Queries of what surrounds ingest and search: texts shown, service replies, caches, reports, contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import papers as P
from ..operators.graph import Graph
from ..operators.retrieval import last_written
from ..plans import context as C
from ..plans import ingest as I
from ..plans.embedding import embed_cached
from ..plans.providers import KINDS, Offline
from ..session import cut_lineage, shared_dir, table
from ..sources.fetch import citation_lookup
from ..sources.sinks import failed_ids
from . import graph as G
from .papers import SECTIONS, SECTIONS_OF, section_class
from .retrieval import SEARCH
from .sql import CURRENT, GRAPH, INDEX, bare, field, strip, version

TEMPLATE = "Write a short abstract that answers: {query}"


def current(spark: SparkSession, d: str) -> DataFrame:
    return P.current_papers(table(spark, d, "papers"))


def paper_display(spark, d):
    """What lists of papers show: safe names, context lines, clipped abstracts, first authors, categories, boosts."""
    p = current(spark, d)
    category = F.coalesce(F.get(F.col("categories"), F.lit(0)), F.col("primary_category"))
    typed = F.concat_ws(" , ", F.col("categories"), F.col("categories"))
    return p.select(
        "id",
        T.path_safe(F.col("id")).alias("name"),
        T.context_prefix(category, F.col("year"), F.col("title"), F.lit("Abstract")).alias("prefix"),
        T.clip(F.col("abstract"), 60).alias("short"),
        T.authors_line(F.col("authors")).alias("authors"),
        F.array_join(F.array_sort(T.comma_set(typed)), ",").alias("categories"),
        F.round(T.boost(F.coalesce("citation_count", F.lit(0)), 100), 6).alias("boost"),
        F.to_date("published").alias("day"),
    )


def service_texts(spark, d):
    """Replies and headers as services give them, read: a classifier's type, an explanation without its label, the first forwarded address,
    a prompt with the query in it. They are made from events."""
    n, kind = F.col("event_id"), F.col("event_type")
    reply = F.when(n % 4 == 0, F.concat(F.lit('```json\n{"type": "gaps", "of": "'), kind, F.lit('"}\n```')))
    reply = reply.when(n % 4 == 1, '{"type": "Path"}').when(n % 4 == 2, '{"type": "unheard"}').otherwise(F.concat(F.lit("I think "), kind))
    why = F.when(n % 3 == 0, F.concat(F.lit("START: "), kind)).when(n % 3 == 1, F.concat(F.lit("Step "), (n % 19 + 1).cast("string"), F.lit(":  "), kind)).otherwise(F.concat(F.lit("GOAL:"), kind))
    header = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" , 10.1.1.1"))
    e = table(spark, d, "events")
    return e.select("event_id", T.query_type(reply, KINDS).alias("kind"), T.explanation(why).alias("why"), T.client_ip(header).alias("ip"), T.fill_template(TEMPLATE, kind).alias("prompt"))


def answer_markup(spark, d):
    """Bullets and bold parts of texts."""
    t = table(spark, d, "documents").where("text is not null")
    got = t.select("doc_id", F.size(T.bullet_lines(F.col("text"))).alias("bullets"), F.array_join(T.bold_parts(F.col("text")), "|").alias("bold"))
    return got.where((F.col("bullets") > 0) | (F.col("bold") != ""))


def kept_sections(spark, d):
    """Types of sections, whether chunks are made of them, and how many there are."""
    s = section_class(spark, d)
    return s.groupBy("section_type", T.kept_section(F.col("section_type")).alias("kept")).agg(F.count("*").alias("n"))


def single_chunks(spark, d):
    """Chunks of abstracts and of sections that are one chunk."""
    from .papers import chunk_sections

    c = chunk_sections(spark, d)
    n = F.count("*").over(G.W.partitionBy("paper_id", "section_index"))
    return c.withColumn("n", n).where(F.col("n") == 1).select("chunk_id", "paper_id", "chunk_type", "section_heading", "chunk_text")


def split_sections(spark, d):
    """Sections of several chunks."""
    from .papers import chunk_sections

    per = chunk_sections(spark, d).groupBy("paper_id", "section_index").agg(F.count("*").alias("n"))
    return per.where(F.col("n") > 1).select("paper_id", "section_index")


def token_costs(spark, d):
    """Tokens of the texts by source and what their vectors cost."""
    t = table(spark, d, "documents").groupBy("source").agg(F.coalesce(F.sum(T.token_count(F.col("text"))), F.lit(0)).alias("tokens"))
    return t.select("source", "tokens", F.round(T.cost(F.col("tokens")), 9).alias("cost"))


def waypoint_positions(spark, d):
    return spark.createDataFrame([(n, i, round(x, 9)) for n in range(1, 7) for i, x in enumerate(T.interior(n), 1)], "steps int, pos int, place double")


def upsert_failed(spark, d):
    """New chunks that an upsert can't store, full texts being new."""
    c = last_written(table(spark, d, "chunks"))
    return failed_ids(c, c.where(~F.col("is_fulltext")))


def embed_cached_chunks(spark, d):
    """Chunks after a second run of the embedder whose first run saw the abstracts only."""
    c = last_written(table(spark, d, "chunks")).select("chunk_id", "chunk_text", "is_fulltext")
    path = f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    embed_cached(c.where(~F.col("is_fulltext")), path, Offline(16))
    return embed_cached(c, path, Offline(16)).select("chunk_id", "cached", F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"))


def lookup(ids: list[str]) -> list[dict | None]:
    """A service that knows ids whose last character is an even digit."""
    return [{"paperId": f"s{x}", "externalIds": {"ArXiv": x}, "citationCount": len(x), "citations": [{"externalIds": {"ArXiv": x[:4]}}, None]} if x[-1] in "02468" else None for x in ids]


def citation_fetch(spark, d):
    """Citation records of all papers from a service asked in batches, after a first run that saw part of them."""
    ids = table(spark, d, "papers").select("arxiv_id")
    path = f"{shared_dir(spark)}/citations-{uuid.uuid4().hex}"
    citation_lookup(ids.where(F.col("year") < 2015), path, lookup, 50)
    got = citation_lookup(ids, path, lookup, 50)
    return got.select("arxiv_id", "s2_id", "citation_count", F.array_join("cited_by", ",").alias("cited_by"))


def run_report(spark, d):
    """Counts, rate and price of a run that took a minute."""
    p = table(spark, d, "papers")
    return I.report(p, current(spark, d), last_written(table(spark, d, "chunks")), 60.0)


def ingest_progress(spark, d):
    return I.progress(current(spark, d), table(spark, d, "parsed_papers"), table(spark, d, "chunks"), table(spark, d, "failure_log"))


def gaps_text(spark, d):
    return C.gaps_text(G.graph(spark, d).gaps(G.CATEGORY, 5, 2018, 2020, 2))


def bridges_text(spark, d):
    return C.bridges_text(G.graph(spark, d).bridges(G.CATEGORY, G.OTHER))


def _seeds(g: Graph) -> DataFrame:
    return cut_lineage(G.seeds(g))  # ten rows that several branches read


def paper_contexts(spark, d):
    """References, citers and authors' works of the ten seeds in one pass."""
    g = G.graph(spark, d)
    return g.contexts(_seeds(g))


def enriched_context(spark, d):
    """Context of an answer about the seeds, of which the first five are shown."""
    g = G.graph(spark, d)
    ids = _seeds(g)
    first = ids.orderBy("id").limit(5).join(g.records.select("id", "title", "year", F.col("abstract").alias("body")), "id")
    pos = F.row_number().over(G.W.partitionBy().orderBy("id"))  # five rows
    return C.enriched_context(first.withColumn("pos", pos), ids, g)


QUERIES = {f.__name__: f for f in (
    paper_display, service_texts, answer_markup, kept_sections, single_chunks, split_sections, token_costs, waypoint_positions, upsert_failed, embed_cached_chunks,
    citation_fetch, run_report, ingest_progress, gaps_text, bridges_text, paper_contexts, enriched_context,
)}

_CHUNK_FIELD = field("coalesce(categories[1], primary_category)", {k: v for k, v in {"cs": "Computer Science", "math": "Mathematics", "stat": "Statistics", "physics": "Physics", "eess": "Electrical Engineering"}.items()})
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x85\x1c-\x1f]"


def _clip(c: str, n: int) -> str:
    return f"case when length({c}) > {n} then {c}[:{n}] || '...' else {c} end"


_CONTEXTS = f""",
    refs as (select s.id, 'reference' as part, row_number() over (partition by s.id order by t.id) as pos, t.title as text
             from seeds s join cites c on c.src = s.id join titled t on t.id = c.dst qualify pos <= 3),
    citers as (select s.id, 'citer' as part, row_number() over (partition by s.id order by t.id) as pos, t.title as text
               from seeds s join cites c on c.dst = s.id join titled t on t.id = c.src qualify pos <= 3),
    works as (select s.id, a.name, t.id as other, t.title, row_number() over (partition by s.id, a.name order by t.citation_count desc, t.id) as r
              from seeds s join authored a on a.paper = s.id join authored b on b.name = a.name and b.paper <> s.id
              join titled t on t.id = b.paper and t.citation_count > 0 qualify r <= 2),
    people as (select id, 'author' as part, row_number() over (partition by id order by name) as pos, name || ': ' || string_agg({_clip("title", 50)}, ', ' order by r) as text
               from works group by id, name qualify pos <= 2),
    ctx as (from refs union all from citers union all from people)"""


def _count(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_TOKENS}'))"


#: Sections that chunks are made of, with their first lines: j(pid, pos, heading, section_type, text, prefix, n); and abstracts a(pid, text, prefix).
_CHUNKED = f"""with {CURRENT},
    one as (select *, 'arxiv:' || {bare("paper_id")} as key from parsed_papers
            qualify row_number() over (partition by key order by {version(strip("lower(paper_id)"))} desc, parsed_at nulls last, paper_id) = 1),
    typed as ({SECTIONS_OF.format("one", "key", ', text')}),
    j0 as (select c.pid, section_index, heading, section_type, t.text, '[' || {_CHUNK_FIELD} || ' | ' || coalesce(year::varchar, '') || '] ' || coalesce(title, '') as head
           from typed t join cur c on c.pid = t.key where section_type not in ('skip', 'related_work')),
    j as (select *, head || case when coalesce(heading, '') <> '' then chr(10) || 'Section: ' || heading else '' end as prefix from j0
          where {_count("coalesce(text, '')")} >= 100),
    a as (select c.pid, coalesce(case when abstract <> '' then abstract end, abstract_text) as text,
                 '[' || {_CHUNK_FIELD} || ' | ' || coalesce(year::varchar, '') || '] ' || coalesce(title, '') || chr(10) || 'Section: Abstract' as prefix
          from one join cur c on c.pid = one.key)"""
_FITS = f"{_count('text')} <= 595 - {_count('prefix')}"
_BRIDGES = f"""select id, title, year, citation_count from titled where id in (select paper from in_cat where category = '{G.CATEGORY}')
    and id in (select paper from in_cat where category = '{G.OTHER}') order by citation_count desc nulls last, id limit 10"""

ORACLES = {
    "paper_display": f"""with {CURRENT} select pid as id, replace(replace(replace(pid, 'arxiv:', ''), '/', '_'), ':', '_') as name,
        '[' || {_CHUNK_FIELD} || ' | ' || coalesce(year::varchar, '') || '] ' || coalesce(title, '') || chr(10) || 'Section: Abstract' as prefix,
        {_clip("abstract", 60)} as short,
        array_to_string(authors[1:3], ', ') || case when len(authors) > 3 then ' +' || (len(authors) - 3) || ' more' else '' end as authors,
        coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(categories, lambda c: trim(c)), lambda c: c <> ''))), ','), '') as categories,
        round(least(coalesce(citation_count, 0) / 100.0, 1.0), 6)::double as boost, published::date as day from cur""",
    "service_texts": """select event_id, case event_id % 4 when 0 then 'GAPS' when 1 then 'PATH' else 'SEARCH' end as kind, event_type as why,
        '10.0.0.' || (user_id % 256) as ip, 'Write a short abstract that answers: ' || event_type as prompt from events""",
    "answer_markup": r"""with m as (select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*•]\s+\S')))::int as bullets,
            array_to_string(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1), '|') as bold from documents where text is not null)
        select * from m where bullets > 0 or bold <> ''""",
    "kept_sections": f"select section_type, section_type not in ('skip', 'related_work') as kept, count(*) as n from ({SECTIONS}) group by all",
    "single_chunks": f"""{_CHUNKED}
        select pid || '_s' || section_index || '_c0' as chunk_id, pid as paper_id, section_type as chunk_type, heading as section_heading, prefix || chr(10) || text as chunk_text
        from j where {_FITS}
        union all select pid || '_abstract', pid, 'abstract', 'Abstract', prefix || chr(10) || text from a where {_count("coalesce(text, '')")} >= 100""",
    "split_sections": f"{_CHUNKED} select pid as paper_id, section_index from j where not ({_FITS})",
    "token_costs": rf"""with t as (select source, coalesce(sum(len(regexp_extract_all(text, '{_TOKENS}'))), 0)::bigint as tokens from documents group by source)
        select source, tokens, round(tokens / 1e6 * 0.02, 9)::double as cost from t""",
    "waypoint_positions": "select n::int as steps, i::int as pos, round(i / (n + 1.0), 9)::double as place from range(1, 7) a(n), range(1, 7) b(i) where i <= n",
    "upsert_failed": f"""with {INDEX} select chunk_id, paper_id, 'no embedding' as error from idx where is_fulltext and coalesce(len(embedding), 0) < 1""",
    "embed_cached_chunks": rf"""with {INDEX} select chunk_id, not is_fulltext and regexp_matches(coalesce(chunk_text, ''), '\S') as cached,
        case when regexp_matches(coalesce(chunk_text, ''), '\S') then 16 else 0 end as dim from idx""",
    "citation_fetch": f"""select distinct a as arxiv_id, 's' || a as s2_id, length(a)::int as citation_count, a[:4] as cited_by
        from (select {strip("arxiv_id")} as a from papers) where regexp_matches(a, '[02468]$')""",
    "run_report": rf"""with {CURRENT}, {INDEX},
        n as (select (select count(*) from papers)::double as records, (select count(*) from cur)::double as papers, (select count(*) from idx)::double as chunks,
              (select sum(len(regexp_extract_all(coalesce(chunk_text, ''), '{_TOKENS}'))) from idx)::double as tokens)
        select 'records' as what, records as n from n union all select 'papers', papers from n union all select 'chunks', chunks from n
        union all select 'tokens', tokens from n union all select 'chunks_per_paper', round(chunks / greatest(papers, 1), 4) from n
        union all select 'cost', round(tokens / 1e6 * 0.02, 6) from n union all select 'papers_per_second', papers / 60.0 from n""",
    "ingest_progress": f"""with {CURRENT}, k as (select pid, pid in (select 'arxiv:' || {bare("paper_id")} from parsed_papers where paper_id is not null) as p,
            pid in (select 'arxiv:' || {bare("paper_id")} from chunks where paper_id is not null) as i,
            pid in (select 'arxiv:' || {bare("paper_id")} from failure_log where paper_id is not null) as f from cur)
        select count(*) as papers, count(*) filter (p) as parsed, count(*) filter (i) as indexed, count(*) filter (f and not p) as failed,
        count(*) filter (not p and not f) as to_do from k""",
    "gaps_text": GRAPH
    + f""", g as (select k.id, any_value(k.title) as title, any_value(k.year) as year, any_value(k.citation_count) as c, count(s.id) as recent
            from known k join in_cat on paper = k.id and category = '{G.CATEGORY}' left join cites e on e.dst = k.id left join known s on s.id = e.src and s.year >= 2020
            where k.citation_count >= 5 and k.year <= 2018 group by k.id having count(s.id) <= 2 order by c desc, k.id limit 10)
        select coalesce(string_agg('- ' || coalesce(title, '') || ' (' || year || '), cited ' || c || ', recently ' || recent, chr(10) order by c desc, id), '') as text from g""",
    "bridges_text": GRAPH
    + f""", b as ({_BRIDGES}) select coalesce(string_agg('- ' || coalesce(title, '') || ' (' || coalesce(year::varchar, '') || ')', chr(10) order by citation_count desc nulls last, id), '') as text from b""",
    "paper_contexts": GRAPH + _CONTEXTS + " select id, part, pos, text from ctx",
    "enriched_context": GRAPH
    + _CONTEXTS
    + f""", five as (select c.pid as id, title, year, abstract, row_number() over (order by c.pid) as pos from cur c where c.pid in (select id from seeds order by id limit 5)),
        j as (select id, string_agg({_clip("text", 60)}, '; ' order by pos) filter (part = 'reference') as r, string_agg({_clip("text", 60)}, '; ' order by pos) filter (part = 'citer') as c,
                     string_agg({_clip("text", 200)}, '; ' order by pos) filter (part = 'author') as a from ctx group by id),
        rel as (select n.dst as id, any_value(title) as title, any_value(citation_count) as c, count(distinct n.src) as shared from near n join titled t on t.id = n.dst
                where n.src in (from seeds) and n.dst not in (from seeds) and citation_count > 0 group by n.dst order by shared desc, c desc, n.dst limit 5),
        com as (select dst as id, any_value(title) as title, any_value(citation_count) as c, count(distinct src) as k from cites join titled t on t.id = dst
                where src in (from seeds) group by dst having count(distinct src) >= 2 order by k desc, c desc, dst limit 3),
        rr as (select id from seeds union all select dst from near where src in (from seeds)),
        exp as (select name, count(distinct rr.id) as k, coalesce(sum(citation_count), 0) as c from rr join authored a on a.paper = rr.id join nodes n on n.id = rr.id
                group by name having count(distinct rr.id) >= 2 order by k desc, c desc, name limit 5)
        select 'paper' as part, pos::int as pos, concat_ws(chr(10), '[' || pos || '] ' || coalesce(title, '') || ' (' || coalesce(year::varchar, '') || ')', {_clip("abstract", 350)},
            'Cites: ' || r, 'Cited by: ' || c, 'Authors: ' || a) as text from five left join j using (id)
        union all select 'related', row_number() over (order by shared desc, c desc, id), {_clip("coalesce(title, '')", 70)} from rel
        union all select 'foundational', row_number() over (order by k desc, c desc, id), {_clip("coalesce(title, '')", 70)} from com
        union all select 'expert', row_number() over (order by k desc, c desc, name), name || ' (' || k || ' papers)' from exp""",
    "chat_events": f"""{GRAPH}, {SEARCH}{_CONTEXTS.replace("from seeds s", "from (select paper_id as id from g1) s")},
        sn as (select h1.paper_id, {_clip("chunk_text", 400)} as t, rank, row_number() over (partition by h1.paper_id order by rank) as r
               from h1 join idx using (chunk_id) where coalesce(chunk_text, '') <> ''),
        bd as (select paper_id, string_agg(t, chr(10) order by rank) as body from sn where r <= 3 group by paper_id),
        f1 as (select paper_id from g1 order by best_score desc, first_rank limit 1),
        jj as (select string_agg({_clip("text", 60)}, '; ' order by pos) filter (part = 'reference') as r, string_agg({_clip("text", 60)}, '; ' order by pos) filter (part = 'citer') as c,
                      string_agg({_clip("text", 200)}, '; ' order by pos) filter (part = 'author') as a from ctx where id = (from f1)),
        b0 as (select title, year, coalesce(body, {_clip("abstract", 400)}) as body from f1 left join bd using (paper_id) left join cur on pid = f1.paper_id),
        tx as (select concat_ws(chr(10), '[1] ' || coalesce(title, '') || ' (' || coalesce(year::varchar, '') || ')', {_clip("body", 350)},
                      'Cites: ' || r, 'Cited by: ' || c, 'Authors: ' || a) as text from b0, jj),
        tk as (select string_split(string_split(text, chr(10) || chr(10))[1], ' ') as ws from tx)
        select 0 as seq, 'sources' as type, (select string_agg(paper_id, ',' order by best_score desc, first_rank) from g1) as payload
        union all select i::int, 'token', ws[i] from (select ws, unnest(range(1, len(ws) + 1)) as i from tk)
        union all select len(ws)::int + 1, 'done', '' from tk""",
}
