"""Reading paper records, id sets, logs, citation responses and parsed full texts."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

RAW = (
    "id string, arxiv_id string, title string, abstract string, authors array<string>, published string, published_date string, year int, "
    "categories array<string>, primary_category string, pdf_url string, source string, citation_count int"
)
PEER = "array<struct<paperId:string,externalIds:struct<ArXiv:string>>>"
CITATION = f"paperId string, externalIds struct<ArXiv:string>, citationCount int, influentialCitationCount int, citations {PEER}, references {PEER}"


def read_raw(spark: SparkSession, glob: str, skip_corrupt: bool = True) -> DataFrame:
    """All records of JSON files (arrays or one record a line), with the file each is from."""
    r = spark.read.schema(RAW).option("multiLine", True).option("mode", "DROPMALFORMED" if skip_corrupt else "FAILFAST")
    return r.json(glob).withColumn("file", F.col("_metadata.file_path")).where(F.col("id").isNotNull())


def head_per_file(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of each file."""
    w = W.partitionBy("file").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def scan(df: DataFrame, categories: list[str], start: str | None = None, end: str | None = None, most: int | None = None) -> DataFrame:
    """Records by category, latest first, the first category of a record wins. The predicates reach the scan."""
    cats = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], "cat string, cat_ord int")
    rows = df if start is None else df.where(F.col("published") >= start)
    rows = rows if end is None else rows.where(F.col("published") <= end)
    every = rows.withColumn("cat", F.explode("categories")).join(cats, "cat")
    if most is not None:
        w = W.partitionBy("cat").orderBy(F.desc("published"), "id")
        every = every.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    w = W.partitionBy("id").orderBy("cat_ord")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "cat", "cat_ord")


def recent(df: DataFrame, days: int, today: Column, most: int = 500) -> DataFrame:
    return df.where(F.to_date("published") >= F.date_sub(today, days)).orderBy(F.desc("published"), "id").limit(most)


def feed_record(entry: DataFrame) -> DataFrame:
    """entry(url, title, summary, authors, published timestamp, categories, pdf_url) -> record; the version ends the id."""
    aid = F.split_part(F.regexp_extract("url", r"([^/]+)$", 1), F.lit("v"), F.lit(1))
    return entry.select(
        F.concat(F.lit("arxiv:"), aid).alias("id"),
        aid.alias("arxiv_id"),
        "title",
        F.translate("summary", "\n", " ").alias("abstract"),
        "authors",
        F.date_format("published", "yyyy-MM-dd").alias("published"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_date"),
        F.year("published").alias("year"),
        "categories",
        F.get(F.col("categories"), F.lit(0)).alias("primary_category"),
        "pdf_url",
        F.lit("arxiv").alias("source"),
        F.lit(0).alias("citation_count"),
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Different ids of a text file, one a line; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "").distinct()


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (paper_id, error, timestamp); malformed lines are skipped."""
    rows = spark.read.schema("paper_id string, error string, timestamp string").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("paper_id").isNotNull())


def citation_record(responses: DataFrame) -> DataFrame:
    """Responses with the schema CITATION -> (arxiv_id, s2_id, citation_count, influential_citations, references, cited_by)."""

    def ids(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(PEER)), lambda x: x["externalIds"]["ArXiv"]), lambda x: x.isNotNull() & (x != ""))

    return responses.where(F.col("paperId").isNotNull()).select(
        F.col("externalIds.ArXiv").alias("arxiv_id"),
        F.col("paperId").alias("s2_id"),
        F.col("citationCount").alias("citation_count"),
        F.col("influentialCitationCount").alias("influential_citations"),
        ids("references").alias("references"),
        ids("citations").alias("cited_by"),
    )


def read_pdfs(spark: SparkSession, glob: str, least: int = 1000, most: int = 20 * 1024 * 1024) -> DataFrame:
    """PDF files that are neither stubs nor too large for the parser; the size is tested before contents are read."""
    return spark.read.format("binaryFile").load(glob).where((F.col("length") >= least) & (F.col("length") <= most))


def parse_tei(xml: str) -> dict:
    """Title, abstract and the top sections of a parsed full text; a section has the paragraphs of all its parts."""
    root = ET.fromstring(xml)
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: " ".join("".join(e.itertext()).split())
    title = next((text(e) for e in root.iter() if tag(e) == "title" and e.get("type") == "main"), "")
    abstract = next((text(e) for e in root.iter() if tag(e) == "abstract"), "")
    body = next((e for e in root.iter() if tag(e) == "body"), None)
    sections = []
    for div in body if body is not None else []:
        if tag(div) != "div":
            continue
        head = next((text(e) for e in div.iter() if tag(e) == "head"), "")
        paragraphs = [t for e in div.iter() if tag(e) == "p" and (t := text(e))]
        if paragraphs:
            sections.append({"heading": head, "text": "\n\n".join(paragraphs)})
    return {"grobid_title": title, "abstract_text": abstract, "sections": sections}


def parsed_papers(files: DataFrame) -> DataFrame:
    """files(paper_id, xml) -> (paper_id, grobid_title, abstract_text, sections); files that are no XML are left out."""
    out = pa.schema([("paper_id", pa.string()), ("grobid_title", pa.string()), ("abstract_text", pa.string()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pid, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append({"paper_id": pid, **parse_tei(xml)})
                except ET.ParseError:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return files.select("paper_id", "xml").where(F.col("xml").isNotNull()).mapInArrow(run, "paper_id string, grobid_title string, abstract_text string, sections array<struct<heading:string,text:string>>")


class CategoryPartition(InputPartition):
    def __init__(self, category: str):
        self.category = category


def live_source(name: str, fetch: Callable[[str, dict], Iterator[tuple]]) -> type[DataSource]:
    """A data source that scans one category per partition through `fetch(category, options)`, which pages, paces and retries (sources.fetch). With
    spark.sql.python.filterPushdown.enabled, bounds on `published` arrive there as the options start and end; without, it scans all and Spark filters."""

    class Push:
        """Bounds of the day of publication go to `fetch` as options; all filters are tested again, as a service may give more."""

        # Spark refuses a reader with a method pushFilters of its own where pushdown is off. This one may go uncalled.
        __func__ = staticmethod(DataSourceReader.pushFilters)

        def __init__(self, options: dict):
            self.options = options

        def __call__(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if f.attribute == ("published",) and isinstance(f, (GreaterThanOrEqual, LessThanOrEqual)):
                    self.options["start" if isinstance(f, GreaterThanOrEqual) else "end"] = f.value
                yield f

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)
            self.pushFilters = Push(self.options)

        def partitions(self) -> list[InputPartition]:
            return [CategoryPartition(c) for c in self.options["categories"].split(",")]

        def read(self, partition: CategoryPartition) -> Iterator[tuple]:
            yield from fetch(partition.category, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source
