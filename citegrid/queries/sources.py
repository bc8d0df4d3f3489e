"""Queries that write what outside services give, and read it: logs, id lists, full texts as XML, live scans, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import papers as P
from ..operators import retrieval as R
from ..plans import context as C
from ..session import bounded, shared_dir, table
from ..sources import records as S
from ..streaming import limits as L
from .papers import requests, sliding
from .retrieval import HYBRID, TEXT, keyed_index, vectors
from .sql import CURRENT, bare


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def failures_read(spark, d):
    """A failure log of JSON lines, some of them cut off."""
    path = _path(spark, "failures")
    log = table(spark, d, "failure_log").select("paper_id", "error", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    lines = log.select(F.to_json(F.struct("paper_id", "error", "timestamp")).alias("value"))
    lines.unionByName(lines.select(F.substring("value", 1, 7).alias("value"))).write.text(path)
    return S.read_failures(spark, path)


def ids_read(spark, d):
    """Different ids of a text file with blanks, blank lines and repeats."""
    path = _path(spark, "ids")
    ids = table(spark, d, "papers").select(F.concat(F.lit(" "), "id", F.lit("  ")).alias("value")).where("value is not null")
    ids.unionByName(ids.select(F.lit("").alias("value"))).write.text(path)
    return S.read_ids(spark, path)


def tei_parsed(spark, d):
    """Titles and the number of sections with a text, of full texts as XML."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = P.first_wins(table(spark, d, "parsed_papers"), "paper_id", "parsed_at")
    divs = F.transform("sections", lambda s: F.concat(F.lit("<div><head>"), safe(s["heading"]), F.lit("</head><p>"), safe(s["text"]), F.lit("</p></div>")))
    xml = F.concat(F.lit('<TEI><title type="main">'), safe(F.col("grobid_title")), F.lit("</title><text><body>"), F.array_join(F.coalesce(divs, F.array().cast("array<string>")), ""), F.lit("</body></text></TEI>"))
    got = S.parsed_papers(one.select("paper_id", xml.alias("xml")))
    return got.select("paper_id", F.col("grobid_title").alias("title"), F.size("sections").alias("sections"))


def live_scan(spark, d):
    """A live source of three records for each category, scanned by category."""

    def fetch(category: str, options: dict):
        for i in range(int(options["records"])):
            yield (f"arxiv:{category}-{i}", f"{category}-{i}", f"title {i}", None, None, None, None, 2000 + i, [category], category, None, "live", 0)

    name = f"live_{uuid.uuid4().hex}"
    spark.dataSource.register(S.live_source(name, fetch))
    got = spark.read.format(name).option("categories", "cs.AI,cs.LG").option("records", "3").load()
    return got.select("id", "title", "year", "primary_category")


def _stream(spark, d, name):
    t = table(spark, d, name)
    return spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet" if _is_dir(spark, f"{d}/{name}.parquet") else _alone(spark, d, name))


def _is_dir(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _alone(spark, d, name):
    """A folder with this table alone: a stream reads folders."""
    path = _path(spark, name)
    table(spark, d, name).write.parquet(path)
    return path


def ingest_resumed(spark, d):
    """Papers ingested as a stream, twice from the same source: each id once."""
    out, mark = _path(spark, "ingested"), _path(spark, "mark")
    for _ in range(2):
        L.ingest_stream(_stream(spark, d, "papers"), out, "id", mark, lambda df: df.select("id", "primary_category").where("id is not null"))
    return spark.read.parquet(out)


def stream_limit(spark, d):
    """The sliding limit by ip on a stream of events."""
    e = _stream(spark, d, "events")
    req = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ip"), F.col("ts").cast("timestamp").alias("ts"))
    out = _path(spark, "limited")
    q = L.stream_ip_limit(req, 1, 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "mark")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("request_id", "ip", "accepted")


def keyed_requests(spark, d):
    """Requests with a known key, in the order key, day's budget, ip."""
    keyed = requests(spark, d).withColumn("api_key", F.when(F.col("request_id") % 3 == 0, "open").when(F.col("request_id") % 3 == 1, "other"))
    return L.admission(keyed, ["open"], 1, 5, 40).select("request_id", "ip", "accepted")


def breaker_runs(spark, d):
    """Runs of at least three events of a user under 20 in value."""
    e = table(spark, d, "events")
    return L.breaker(e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), (F.coalesce("value", F.lit(0.0)) >= 20).alias("ok")))


def basic_context(spark, d):
    """Context of the first papers of a hybrid search."""
    ix = keyed_index(spark, d)
    hits = bounded(R.ranked(R.hybrid_topk(ix, vectors(spark, d, 1)[0], TEXT, 20)).withColumn("rerank_score", F.lit(None).cast("double")), 20)
    return C.basic_context(bounded(R.group_papers(hits, 5), 5), hits, ix, P.current_papers(table(spark, d, "papers")))


def over_fetched(spark, d):
    """How many chunks are fetched for so many papers."""
    return spark.createDataFrame([(k, r, R.over_fetch(k, r), R.over_fetch(k, r, 100)) for k in range(1, 51) for r in (False, True)], "top_k int, rerank boolean, fetched int, chat int")


def clean_ids(spark, d):
    """Ids without their versions, and their versions."""
    return table(spark, d, "papers").select("id", T.base_id(F.col("id")).alias("base"), T.id_version(F.col("id")).alias("version")).distinct()


QUERIES = {f.__name__: f for f in (
    failures_read, ids_read, tei_parsed, live_scan, ingest_resumed, stream_limit, keyed_requests, breaker_runs, basic_context, over_fetched, clean_ids,
)}

_KEYED = f"'arxiv:' || {bare('hy.paper_id')}"
ORACLES = {
    "failures_read": "select paper_id, error, strftime(failed_at, '%Y-%m-%d %H:%M:%S') as timestamp from failure_log where paper_id is not null",
    "ids_read": "select distinct trim(id) as id from papers where trim(id) <> ''",
    "tei_parsed": r"""with one as (select * from parsed_papers where paper_id is not null qualify row_number() over (partition by paper_id order by parsed_at) = 1)
        select paper_id, trim(regexp_replace(coalesce(grobid_title, ''), '\s+', ' ', 'g')) as title,
        coalesce(len(list_filter(sections, lambda s: regexp_matches(coalesce(s."text", ''), '\S'))), 0)::int as sections from one""",
    "live_scan": """select 'arxiv:' || c || '-' || i as id, 'title ' || i as title, (2000 + i)::int as year, c as primary_category
        from (values ('cs.AI'), ('cs.LG')) a(c), range(3) b(i)""",
    "ingest_resumed": "select id, any_value(primary_category) as primary_category from papers where id is not null group by id",
    "stream_limit": sliding("events"),
    "keyed_requests": sliding("(select * from events where event_id % 3 = 0 qualify row_number() over (partition by epoch(ts)::bigint // 86400 order by ts, event_id) <= 40)"),
    "breaker_runs": """with r as (select user_id as worker, event_id as seq, coalesce(value, 0) >= 20 as ok,
            sum((coalesce(value, 0) >= 20)::int) over (partition by user_id order by event_id) as run from events)
        select worker, min(seq) as first, max(seq) as last, count(*) as failures from r where not ok group by worker, run having count(*) >= 3""",
    "basic_context": f"""{HYBRID.replace("with ", f"with {CURRENT},", 1)},
        hk as (select hy.chunk_id, {_KEYED} as paper_id, score, row_number() over (order by score desc, hy.chunk_id) as rank from hy),
        g as (select paper_id, row_number() over (order by max(score) desc, min(rank)) as pos from hk group by paper_id qualify pos <= 5),
        s as (select hk.paper_id, case when length(chunk_text) > 400 then chunk_text[:400] || '...' else chunk_text end as t, rank,
                     row_number() over (partition by hk.paper_id order by rank) as r from hk join idx using (chunk_id) where coalesce(chunk_text, '') <> ''),
        b as (select paper_id, string_agg(t, chr(10) order by rank) as body from s where r <= 3 group by paper_id)
        select pos::int as pos, concat_ws(chr(10), '[' || pos || '] ' || coalesce(title, '') || ' (' || coalesce(year::varchar, '') || ')',
            coalesce(body, case when length(abstract) > 400 then abstract[:400] || '...' else abstract end)) as text
        from g left join b using (paper_id) left join cur on pid = g.paper_id""",
    "over_fetched": """select k::int as top_k, r as rerank, least(k * case when r then 4 else 2 end, 80)::int as fetched, least(k * case when r then 4 else 2 end, 100)::int as chat
        from range(1, 51) a(k), (values (true), (false)) b(r)""",
    "clean_ids": """select distinct id, regexp_replace(id, 'v[0-9]+$', '') as base,
        coalesce(try_cast(regexp_extract(id, 'v([0-9]+)$', 1) as int), 0) as version from papers""",
}
