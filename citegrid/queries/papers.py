"""Queries of ingest: validation, versions, metadata, texts, chunks, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import FILLER_PHRASES, KEYWORD_STOPWORDS, METHOD_TERMS, section_keys
from ..operators import chunking as C
from ..operators import papers as P
from ..operators.retrieval import last_written
from ..session import table
from ..sources import records as S
from ..sources.categories import preset, preset_table
from ..sources.sinks import upsert_report
from ..streaming import limits as L
from .sql import CURRENT, INDEX, bare, field, strip, version

YEAR = 2026


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers")


def current(spark: SparkSession, d: str) -> DataFrame:
    return P.current_papers(papers(spark, d))


def validate_ok(spark, d):
    return P.validate(papers(spark, d), YEAR)[0].select("id", "title", F.length("abstract").alias("abstract_chars"), F.size("authors").alias("authors"), "ingested_at")


def validate_rejects(spark, d):
    return P.validate(papers(spark, d), YEAR)[1]


def reject_summary(spark, d):
    return validate_rejects(spark, d).groupBy("error").agg(F.count("*").alias("n"))


def dedup_latest(spark, d):
    return P.dedup_latest(papers(spark, d)).select("base_id", "id", "ingested_at")


def dedup_first(spark, d):
    return P.dedup_latest(papers(spark, d), keep_latest=False).select("base_id", "id", "ingested_at")


def metadata_projection(spark, d):
    return P.metadata(last_written(table(spark, d, "chunks")), P.first_wins(papers(spark, d), "id", "ingested_at"))


def clean_abstract(spark, d):
    return current(spark, d).select("id", T.clean_abstract(F.col("abstract")).alias("abstract"))


def sentence_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.size(T.paragraphs(F.col("text"))).alias("paragraphs"))


def keyword_weights(spark, d):
    return P.keyword_weights(current(spark, d))


def keywords(spark, d):
    return P.keywords(current(spark, d)).select("id", F.concat_ws(",", "keywords").alias("keywords"))


def enriched_text(spark, d):
    return P.enriched_text(current(spark, d))


def section_class(spark, d):
    return C.sections_of(table(spark, d, "parsed_papers").dropDuplicates(["paper_id"])).select("paper_id", "section_index", "heading", "section_type")


def chunk_sections(spark, d):
    return C.chunk_papers(current(spark, d), table(spark, d, "parsed_papers"))


def chunk_statistics(spark, d):
    return C.chunk_stats(chunk_sections(spark, d))


def unparsed_papers(spark, d):
    return current(spark, d).select("id").join(table(spark, d, "parsed_papers").select(P.paper_key(F.col("paper_id")).alias("id")), "id", "left_anti")


def chunk_type_shares(spark, d):
    n = last_written(table(spark, d, "chunks")).groupBy("chunk_type").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.bround(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))  # one row per type


def upsert_chunks(spark, d):
    c = last_written(table(spark, d, "chunks"))
    return upsert_report(c, c.where(~F.col("is_fulltext")))


def upsert_papers(spark, d):
    """Deliveries after 2020 replace what is stored under their id."""
    p = P.first_wins(papers(spark, d), "id", "ingested_at").select("id", "title", "ingested_at")
    cut = F.lit("2020-01-01").cast("timestamp")
    again = papers(spark, d).where(F.col("ingested_at") >= cut).select("id", "title", "ingested_at")
    return P.upsert(p.where(F.col("ingested_at") < cut), P.first_wins(again, "id", "ingested_at"), "id")


def scan_categories(spark, d):
    p = P.first_wins(papers(spark, d), "id", "ingested_at")
    return S.scan(p, preset("cs-core"), "2012-01-01", "2022-12-31", 50).select("id", "published")


def recent_papers(spark, d):
    p = P.first_wins(papers(spark, d), "id", "ingested_at")
    return S.recent(p, 365, F.to_date(F.lit("2024-06-30"))).select("id", "published")


def category_presets(spark, d):
    return preset_table(spark).groupBy("preset").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category"))), lambda x: x["category"]), ",").alias("categories"))


def citation_enrichment(spark, d):
    """Citation records of enriched papers joined back to the bare deliveries."""
    p = P.first_wins(papers(spark, d), "id", "ingested_at")
    found = p.where(F.col("enriched_at").isNotNull()).select("arxiv_id", "s2_id", "citation_count", "influential_citations", "references", "cited_by")
    plain = p.withColumns({"s2_id": F.lit(None).cast("string"), "citation_count": F.lit(0), "influential_citations": F.lit(None).cast("int"), "references": F.lit(None).cast("array<string>"), "cited_by": F.lit(None).cast("array<string>")})
    got = P.enrich_citations(plain, found)
    return got.select("id", "s2_id", "citation_count", F.size("references").alias("n_refs"), F.size("cited_by").alias("n_cited"))


def citation_coverage(spark, d):
    return current(spark, d).agg(
        F.count("*").alias("papers"),
        F.count_if(F.col("s2_id").isNotNull()).alias("matched"),
        F.count_if(F.size("references") > 0).alias("with_references"),
        F.coalesce(F.sum(F.when(F.size("references") > 0, F.size("references"))), F.lit(0)).alias("n_references"),
    )


def failures_by_paper(spark, d):
    """Failures per paper and what it last failed of; papers that failed and are still not parsed."""
    f = table(spark, d, "failure_log")
    got = f.groupBy("paper_id").agg(F.count("*").alias("failures"), F.max("failed_at").alias("last_failed"))
    return got.join(table(spark, d, "parsed_papers").select("paper_id"), "paper_id", "left_anti")


def requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ip"), F.col("ts").cast("timestamp").alias("ts"))


def rate_limit_global(spark, d):
    return L.day_cap(requests(spark, d), 50).select("request_id", "ip")


def rate_limit_ip(spark, d):
    return L.ip_limit(requests(spark, d), 1, 5).select("request_id", "ip", "accepted")


def admission(spark, d):
    return L.admission(requests(spark, d), None, 1, 5, 200).select("request_id", "ip", "accepted")


def last_messages(spark, d):
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("back", F.row_number().over(w)).where("back <= 4").select("user_id", "event_id", "event_type", "back")


def answer_citations(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat_ws(",", F.transform(T.cited_ranks(F.col("text")), lambda x: x.cast("string"))).alias("ranks")).where(F.col("ranks") != "")


QUERIES = {f.__name__: f for f in (
    validate_ok, validate_rejects, reject_summary, dedup_latest, dedup_first, metadata_projection, clean_abstract, sentence_counts,
    keyword_weights, keywords, enriched_text, section_class, chunk_sections, chunk_statistics, unparsed_papers, chunk_type_shares,
    upsert_chunks, upsert_papers, scan_categories, recent_papers, category_presets, citation_enrichment, citation_coverage,
    failures_by_paper, rate_limit_global, rate_limit_ip, admission, last_messages, answer_citations,
)}

_RULES = [
    ("id", "coalesce(length(id), 0) < 1"),
    ("title", "not coalesce(length(title) between 10 and 1000, false)"),
    ("abstract", f"not coalesce(length(abstract) >= 50 and length({strip('abstract')}) >= 50, false)"),
    ("authors", f"coalesce(len(list_filter(authors, lambda a: {strip('a')} <> '')), 0) < 1"),
    ("year", f"not coalesce(year between 1990 and {YEAR}, false)"),
    ("published", "published is null"),
]
_WHY = "concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in _RULES) + ")"
_FIRST = "p1 as (select * from papers qualify row_number() over (partition by id order by ingested_at) = 1)"
_CLEAN = strip("regexp_replace(regexp_replace(abstract, '(?i)\\b(" + "|".join(FILLER_PHRASES) + ")\\b', '', 'g'), '\\s{2,}', ' ', 'g')")
_KEYS = section_keys()
_EXACT = "case b " + " ".join(f"when '{k}' then '{v}'" for k, v in _KEYS.items()) + " end"
_INSIDE = "case " + " ".join(f"when contains(b, '{k}') then '{v}'" for k, v in _KEYS.items()) + " end"
_PLACE = "case when pos / n < 0.15 then 'introduction' when pos / n < 0.35 then 'method' when pos / n < 0.75 then 'experiment' when pos / n < 0.9 then 'discussion' else 'conclusion' end"
_STOP = ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)
_METHODS = ", ".join(f"'{m}'" for m in METHOD_TERMS)
_W = r"\b[a-z][a-z\-]{2,}\b"


def _weights(abstract: str = "abstract") -> str:
    """SQL: x(id, x, t) and k(id, word, weight)."""
    return rf"""with recursive {CURRENT},
    x as (select pid as id, lower(coalesce(title, '') || ' ' || coalesce({abstract}, '')) as x, lower(title) as t from cur),
    w as (select id, word, count(*) as n from (select id, unnest(regexp_extract_all(x, '{_W}')) as word from x) where word not in ({_STOP}) group by all),
    h as (select distinct id, unnest(regexp_extract_all(t, '{_W}')) as word from x),
    m as (select id, replace(term, ' ', '-') as word, 5 as plus from x, (select unnest([{_METHODS}]) as term) where contains(x, term)),
    f as (select w.id, w.word, n * case when h.word is null then 1 else 3 end as n from w left join h on h.id = w.id and h.word = w.word),
    k as (select coalesce(f.id, m.id) as id, coalesce(f.word, m.word) as word, coalesce(n, 0) + coalesce(plus, 0) as weight
          from f full join m on f.id = m.id and f.word = m.word)"""

def _keywords(abstract: str = "abstract") -> str:
    """SQL: kw(id, keywords), a fold over the heaviest words."""
    return f"""{_weights(abstract)},
    l as (select id, list([word] order by r) as ws from (select id, word, row_number() over (partition by id order by weight desc, word) as r from k) where r <= 16 group by id),
    mt as (select id, list_filter([{_METHODS}], lambda t: contains(x, t))[1:4] as ms from x),
    kw as (select mt.id, list_reduce(coalesce(ws, []), lambda acc, w: case when len(acc) < 8 and not contains(array_to_string(acc, ' '), w[1]) then list_append(acc, w[1]) else acc end, ms)[1:8] as keywords
           from mt left join l using (id))"""


_DAY = "epoch(ts)::bigint // 86400"


#: Sections of {0}, which has one row for each {1}, with their type in SQL; {2}: further columns.
SECTIONS_OF = (
    f"""with s as (select {{1}}, greatest(len(sections), 1)::double as n, unnest(sections) as s, unnest(range(len(sections)))::int as pos from {{0}}),
        f as (select {{1}}, n, pos, s."text" as text, s.heading as heading, trim(regexp_replace({strip('lower(s.heading)')}, '^[0-9.\\s]+', '')) as b from s
              qualify row_number() over (partition by {{1}}, s."text"[:200] order by pos) = 1)
        select {{1}}, pos as section_index, heading{{2}},
        case when heading is null or heading = '' then 'unknown' else coalesce({_EXACT}, {_INSIDE}, {_PLACE}) end as section_type from f"""
)
_ONE = "(select * from parsed_papers qualify row_number() over (partition by paper_id order by parsed_at) = 1)"
SECTIONS = SECTIONS_OF.format(_ONE, "paper_id", "")


def sliding(source: str, hour: int = 1, day: int = 5) -> str:
    """SQL: requests by ip in order of time, each step with the times accepted so far."""
    back = "epoch_us(r.ts) - t"
    ok = f"(len(list_filter(acc, lambda t: {back} < 3600000000)) < {hour} and len(list_filter(acc, lambda t: {back} < 86400000000)) < {day})"
    return f"""with recursive r as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from {source} where ts is not null),
        f as (select event_id, user_id, n, true as accepted, [epoch_us(ts)] as acc from r where n = 1
              union all select r.event_id, r.user_id, r.n, {ok}, case when {ok} then list_append(acc, epoch_us(r.ts)) else acc end
              from f join r on r.user_id = f.user_id and r.n = f.n + 1)
        select event_id as request_id, 'u' || user_id as ip, accepted from f"""


ORACLES = {
    "validate_ok": f"""select id, {strip('title')} as title, length({strip('abstract')}) as abstract_chars,
        len(list_filter(authors, lambda a: {strip('a')} <> '')) as authors, ingested_at from papers where {_WHY} = ''""",
    "validate_rejects": f"select id as paper_id, {_WHY} as error from papers where {_WHY} <> ''",
    "reject_summary": f"select error, count(*) as n from (select {_WHY} as error from papers) where error <> '' group by 1",
    "dedup_latest": rf"""select regexp_replace(id, 'v[0-9]+$', '') as base_id, id, ingested_at from papers
        qualify row_number() over (partition by base_id order by {version('id')} desc, ingested_at nulls last, id) = 1""",
    "dedup_first": r"""select regexp_replace(id, 'v[0-9]+$', '') as base_id, id, ingested_at from papers
        qualify row_number() over (partition by base_id order by ingested_at nulls last, id) = 1""",
    "metadata_projection": f"""with {INDEX}, {_FIRST}
        select chunk_id, coalesce(c.paper_id, chunk_id) as paper_id, coalesce(c.title, '')[:500] as title, coalesce(p.abstract, '')[:1000] as abstract,
        coalesce(array_to_string(p.authors[1:10], ', '), '')[:500] as authors, coalesce(len(p.authors), 0) as author_count,
        coalesce(array_to_string(p.categories[1:10], ','), '')[:200] as categories, coalesce(c.primary_category, '') as primary_category,
        {field('c.primary_category')} as field, coalesce(c.year, 0) as year, coalesce(c.published, '') as published,
        coalesce(p.citation_count, c.citation_count, 0) as citation_count,
        case when coalesce(p.citation_count, c.citation_count, 0) >= 100 then 'high' when coalesce(p.citation_count, c.citation_count, 0) >= 10 then 'medium' else 'low' end as citation_tier,
        coalesce(contains(lower(p.abstract), 'github'), false) as has_code, coalesce(regexp_matches(lower(c.title), 'survey|review|overview'), false) as is_survey,
        chunk_type, coalesce(section_heading, '')[:200] as section_heading, coalesce(chunk_text, '')[:800] as snippet, coalesce(is_fulltext, false) as is_fulltext,
        coalesce(p.pdf_url, '') as pdf_url, coalesce(p.source, 'arxiv') as source from idx c left join p1 p on p.id = c.paper_id""",
    "clean_abstract": f"with {CURRENT} select pid as id, {_CLEAN} as abstract from cur",
    "sentence_counts": r"""select doc_id,
        len(list_filter(string_split(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))) as sentences,
        len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))) as paragraphs from documents where text is not null""",
    "keyword_weights": f"{_weights()} select id, word, weight from k",
    "keywords": f"{_keywords()} select id, array_to_string(keywords, ',') as keywords from kw",
    "enriched_text": f"""{_keywords(_CLEAN)} select pid as chunk_id, 'full' as chunk_type, concat_ws(chr(10),
        '[' || {field("coalesce(categories[1], primary_category)")} || ' | ' || coalesce(year::varchar, '') || '] ' || {strip("coalesce(title, '')")},
        case when len(authors) > 0 then 'Authors: ' || array_to_string(authors[1:3], ', ') || case when len(authors) > 3 then ' (+' || (len(authors) - 3) || ' more)' else '' end end,
        case when len(keywords) > 0 then 'Keywords: ' || array_to_string(keywords, ', ') end, coalesce({_CLEAN}, '')) as chunk_text
        from cur left join kw on kw.id = cur.pid""",
    "category_presets": """with c(archive, categories) as (values
            ('cs', 'cs.AI,cs.CL,cs.LG,cs.CV,cs.NE,cs.RO,cs.AR,cs.OS,cs.DC,cs.SE,cs.PL,cs.DS,cs.CR,cs.NI,cs.IT,cs.DB,cs.DL,cs.IR,cs.DM,cs.GR,cs.MM,cs.CG,cs.HC,cs.CC,cs.LO,cs.ET,cs.FL,cs.GT,cs.SC,cs.SI,cs.SY,cs.SD,cs.CE,cs.MS,cs.NA,cs.PF,cs.CY,cs.OH'),
            ('eess', 'eess.AS,eess.IV,eess.SP,eess.SY'), ('math', 'math.OC,math.NA,math.ST,math.IT,math.CO,math.DS'), ('stat', 'stat.ML,stat.AP,stat.TH,stat.CO'),
            ('q-bio', 'q-bio.BM,q-bio.CB,q-bio.GN,q-bio.MN,q-bio.NC,q-bio.OT,q-bio.PE,q-bio.QM,q-bio.SC,q-bio.TO'), ('q-fin', 'q-fin.CP,q-fin.ST,q-fin.TR'),
            ('econ', 'econ.EM,econ.TH,econ.GN'), ('physics', 'physics.data-an,physics.soc-ph,physics.comp-ph')),
        p(preset, parts) as (values ('cs-core', ['cs.AI,cs.CL,cs.LG,cs.CV,cs.NE,cs.RO']), ('cs-systems', ['cs.OS,cs.DC,cs.SE,cs.PL,cs.AR,cs.DS']),
            ('cs-data', ['cs.DB,cs.IR,cs.DL,cs.DM,cs.IT']), ('cs-security', ['cs.CR,cs.NI,cs.SY']), ('cs-graphics', ['cs.GR,cs.MM,cs.CG,cs.HC']),
            ('cs-all', ['cs']), ('eess-all', ['eess']), ('math-relevant', ['math']), ('stat-relevant', ['stat']), ('biotech', ['q-bio']), ('quant-finance', ['q-fin']),
            ('ai-applications', ['stat', 'q-fin', 'econ', 'physics']), ('comprehensive', ['cs', 'eess', 'math', 'stat', 'q-bio', 'q-fin', 'econ', 'physics'])),
        e as (select preset, unnest(parts) as part, unnest(range(len(parts))) as i from p),
        t as (select preset, string_agg(coalesce(categories, part), ',' order by i) as categories from e left join c on archive = part group by preset)
        select preset, len(string_split(categories, ',')) as n, categories from t""",
    "rate_limit_ip": sliding("events"),
    "admission": sliding(f"(select * from events qualify row_number() over (partition by {_DAY} order by ts, event_id) <= 200)"),
    "section_class": SECTIONS,
    "unparsed_papers": f"with {CURRENT} select pid as id from cur where pid not in (select 'arxiv:' || {bare('paper_id')} from parsed_papers where paper_id is not null)",
    "chunk_type_shares": f"with {INDEX}, c as (select chunk_type, count(*) as n from idx group by 1) select chunk_type, n, round_even(100 * n / sum(n) over (), 2) as percent from c",
    "upsert_chunks": f"""with {INDEX}, k as (select *, not is_fulltext as known, coalesce(len(embedding), 0) < 1 as bad from idx)
        select count(*) filter (not known and not bad) as upserted, count(*) filter (known) as skipped, count(*) filter (not known and bad) as failed from k""",
    "upsert_papers": f"""with {_FIRST}, n as (select id, title, ingested_at from papers where ingested_at >= timestamp '2020-01-01'
            qualify row_number() over (partition by id order by ingested_at) = 1)
        select id, title, ingested_at from p1 where ingested_at < timestamp '2020-01-01' and id not in (select id from n) union all from n""",
    "scan_categories": f"""with {_FIRST}, e as (select id, published, unnest(categories) as cat from p1 where published between '2012-01-01' and '2022-12-31'),
        t as (select * from e where cat in ({", ".join(f"'{c}'" for c in preset('cs-core'))}) qualify row_number() over (partition by cat order by published desc, id) <= 50)
        select distinct id, published from t""",
    "recent_papers": f"""with {_FIRST} select id, published from p1 where published::date >= date '2024-06-30' - 365 order by published desc, id limit 500""",
    "citation_enrichment": f"""with {_FIRST} select id, s2_id, case when enriched_at is null then 0 else coalesce(citation_count, 0) end as citation_count,
        case when enriched_at is not null then len("references") end as n_refs, case when enriched_at is not null then len(cited_by) end as n_cited
        from (select * replace (case when enriched_at is not null then s2_id end as s2_id) from p1)""",
    "citation_coverage": f"""with {CURRENT} select count(*) as papers, count(s2_id) as matched, count(*) filter (len("references") > 0) as with_references,
        coalesce(sum(len("references")), 0)::bigint as n_references from cur""",
    "failures_by_paper": """select paper_id, count(*) as failures, max(failed_at) as last_failed from failure_log
        where paper_id not in (select paper_id from parsed_papers) group by 1""",
    "rate_limit_global": f"""select event_id as request_id, 'u' || user_id as ip from events qualify row_number() over (partition by {_DAY} order by ts, event_id) <= 50""",
    "last_messages": """select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events qualify back <= 4""",
    "answer_citations": r"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::int))), ',') as ranks
        from documents where regexp_matches(text, '\[\d+\]')""",
}
