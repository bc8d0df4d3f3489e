"""Column functions over titles, abstracts, headings and categories. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHUNK_FIELDS, FIELDS, FILLER_PHRASES, SKIPPED_SECTIONS, section_keys

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x85\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def token_count(c: Column) -> Column:
    """Default tokenizer: runs of letters, digits and underscores, or one other sign."""
    return F.regexp_count(c, F.lit(TOKEN))


def clean_abstract(c: Column) -> Column:
    """Without filler phrases; runs of white space become a blank."""
    phrases = "|".join(p.replace("-", r"\-") for p in FILLER_PHRASES)
    return strip(F.regexp_replace(F.regexp_replace(c, rf"(?i)\b({phrases})\b", ""), r"\s{2,}", " "))


def base_id(c: Column) -> Column:
    """Identifier without its final version."""
    return F.regexp_replace(c, r"v\d+$", "")


def id_version(c: Column) -> Column:
    """Number after the last v, else 0."""
    return F.coalesce(F.when(c.contains("v"), F.element_at(F.split(c, "v"), -1).try_cast("int")), F.lit(0))


def path_safe(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("arxiv:"), F.lit("")), "/:", "__")


def sentences(c: Column) -> Column:
    """Sentences: after . ! or ? and white space, before a capital."""
    parts = F.split(F.regexp_replace(c, r"\n+", " "), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def first_prefix(category: Column) -> Column:
    return F.split_part(category, F.lit("."), F.lit(1))


def field_of(category: Column, table: dict[str, str] = FIELDS) -> Column:
    """Field by the prefix before the first dot, else Other."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(names, first_prefix(F.coalesce(category, F.lit("")))), F.lit("Other"))


def citation_tier(count: Column) -> Column:
    return F.when(count >= 100, "high").when(count >= 10, "medium").otherwise("low")


def has_code(abstract: Column) -> Column:
    return F.lower(abstract).contains("github")


def is_survey(title: Column) -> Column:
    return F.lower(title).rlike("survey|review|overview")


def section_type(heading: Column, position: Column) -> Column:
    """Type by exact heading without its number, else by the first known word in it, else by position (0 to 1)."""
    keys = section_keys()
    exact = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    order = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in keys.items()])
    bare = F.trim(F.regexp_replace(strip(F.lower(heading)), r"^[\d\.\s]+", ""))
    # a lambda's variable is computed once; the expression itself would be for every key
    named = F.transform(F.array(bare), lambda b: F.coalesce(F.try_element_at(exact, b), F.get(F.filter(order, lambda k: F.contains(b, k["k"])), F.lit(0))["v"]))
    place = (
        F.when(position < 0.15, "introduction").when(position < 0.35, "method").when(position < 0.75, "experiment").when(position < 0.90, "discussion").otherwise("conclusion")
    )
    return F.when(heading.isNull() | (heading == ""), "unknown").otherwise(F.coalesce(named[0], place))


def kept_section(kind: Column) -> Column:
    return ~kind.isin(*SKIPPED_SECTIONS)


def context_prefix(category: Column, year: Column, title: Column, heading: Column) -> Column:
    """Line that says where a chunk is from."""
    head = F.concat(F.lit("["), field_of(category, CHUNK_FIELDS), F.lit(" | "), F.coalesce(year.cast("string"), F.lit("")), F.lit("] "), F.coalesce(title, F.lit("")))
    return F.concat_ws("\n", head, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("Section: "), heading)))


def clip(c: Column, n: int) -> Column:
    """The first n characters, with dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def cited_ranks(answer: Column) -> Column:
    """Numbers in brackets of an answer, each once, in order."""
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def query_type(reply: Column, known: list[str], default: str = "SEARCH") -> Column:
    """Type in the JSON of a classifier's reply, fences removed."""
    bare = F.trim(F.regexp_replace(reply, "```json|```", ""))
    kind = F.upper(F.get_json_object(bare, "$.type"))
    return F.when(kind.isin(*known), kind).otherwise(default)


def explanation(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^(START:|GOAL:|Step (?:1?\d):)", ""))


def client_ip(forwarded: Column) -> Column:
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))


def comma_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def boost(count: Column, full: int) -> Column:
    """Citations as a share of `full`, at most 1."""
    return F.least(count / F.lit(float(full)), F.lit(1.0))


def interior(n: int) -> list[float]:
    """n positions strictly between 0 and 1, evenly spread."""
    return [i / (n + 1) for i in range(1, n + 1)]


def fill_template(template: str, query: Column) -> Column:
    """The template with its {query} replaced."""
    return F.replace(F.lit(template), F.lit("{query}"), query)


def authors_line(authors: Column, most: int = 3) -> Column:
    """First names of a list, and how many more there are."""
    rest = F.size(authors) - most
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def bold_parts(answer: Column) -> Column:
    """Texts between double asterisks."""
    return F.regexp_extract_all(answer, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1))


def bullet_lines(answer: Column) -> Column:
    """Lines that begin with a bullet, without it."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.rlike(r"^\s*[-*•]\s+\S"))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*[-*•]\s+", ""))


def cost(tokens: Column, per_million: float = 0.02) -> Column:
    """Price of embedding so many tokens."""
    return tokens / 1e6 * per_million
