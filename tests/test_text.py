import pytest
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.functions.fixed import CHUNK_FIELDS, section_keys


def one(spark, col, **vals):
    cols = [F.lit(v).alias(k) for k, v in vals.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,base,version", [("arxiv:2301.12345v1", "arxiv:2301.12345", 1), ("arxiv:2301.12345v2", "arxiv:2301.12345", 2), ("arxiv:2301.12345", "arxiv:2301.12345", 0)])
def test_versions(spark, raw, base, version):
    assert one(spark, T.base_id(F.lit(raw))) == base and one(spark, T.id_version(F.lit(raw))) == version


@pytest.mark.parametrize(
    "heading,position,kind",
    [
        ("3.1 Encoder Architecture", 0.5, "method"),
        ("Setting", 0.5, "background"),
        ("Settings", 0.5, "experiment"),
        ("Related Work", 0.5, "related_work"),
        ("Related work on model X", 0.5, "method"),
        ("Data availability statement", 0.5, "experiment"),
        ("Zzz", 0.10, "introduction"),
        ("Zzz", 0.20, "method"),
        ("Zzz", 0.50, "experiment"),
        ("Zzz", 0.80, "discussion"),
        ("Zzz", 0.95, "conclusion"),
        ("", 0.5, "unknown"),
        (None, 0.5, "unknown"),
    ],
)
def test_section_types(spark, heading, position, kind):
    assert one(spark, T.section_type(F.lit(heading).cast("string"), F.lit(position))) == kind


def test_section_keys():
    keys = section_keys()
    assert len(keys) == 113 and list(keys).index("setting") == 51 and keys["setting"] == "background"


@pytest.mark.parametrize("count,tier", [(9, "low"), (10, "medium"), (99, "medium"), (100, "high")])
def test_tiers(spark, count, tier):
    assert one(spark, T.citation_tier(F.lit(count))) == tier


@pytest.mark.parametrize("category,field,chunk", [("cs.AI", "Computer Science", "Computer Science"), ("q-bio.GN", "Quantitative Biology", "Other"), ("hep-th", "Other", "Other"), ("", "Other", "Other"), (None, "Other", "Other")])
def test_fields(spark, category, field, chunk):
    c = F.lit(category).cast("string")
    assert one(spark, T.field_of(c)) == field and one(spark, T.field_of(c, CHUNK_FIELDS)) == chunk


def test_texts(spark):
    assert one(spark, T.clean_abstract(F.lit("In this paper we propose a  novel method. It outperforms all."))) == "a . It all."
    assert one(spark, T.sentences(F.lit("One here.\nTwo there! three. Four?"))) == ["One here.", "Two there! three.", "Four?"]
    assert one(spark, T.paragraphs(F.lit("a\n \nb\n\n\n c "))) == ["a", "b", "c"]
    assert one(spark, T.clip(F.lit("abcdef"), 3)) == "abc..." and one(spark, T.clip(F.lit("abc"), 3)) == "abc"
    assert one(spark, T.cited_ranks(F.lit("x [2] y [1] [2]"))) == [1, 2]
    assert one(spark, T.explanation(F.lit("Step 2: because"))) == "because" and one(spark, T.explanation(F.lit("GOAL: x"))) == "x"
    assert one(spark, T.query_type(F.lit('```json{"type": "paths"}```'), ["PATH"])) == "SEARCH"
    assert one(spark, T.query_type(F.lit('```json{"type": "path"}```'), ["PATH"])) == "PATH"
    assert one(spark, T.client_ip(F.lit("1.2.3.4, 5.6.7.8"))) == "1.2.3.4"
    assert one(spark, T.comma_set(F.lit("a, b,,a "))) == ["a", "b"]
    assert T.interior(3) == [0.25, 0.5, 0.75]
    assert one(spark, F.bround(F.lit(0.125), 2)) == 0.12
