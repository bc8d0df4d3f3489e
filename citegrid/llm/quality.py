"""Statistics of text quality per document, and which documents are no natural prose.

Texts are cut into units: paragraphs of lines that belong together, long ones at sentence ends. All statistics are computed for a whole batch at once, by
Arrow's kernels over one array of units, one of tokens and one of words: characters, words and their length, symbols, punctuation,
bullets, columns, repetition, common words. Fixed thresholds on them decide for each unit which rule it fails, if any; a document fails where the units
that fail make up half of its characters or more, and the rules that did it are its reasons. The thresholds published for filtering
whole web texts (word count, mean word length, symbols to words, words with a letter, bullets, ellipses, stop words) are applied to the document as
well and recorded beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words by language.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have had from or an which they we our its can only more than must when if however has been there whose between what does how after under before into also their these each who will all no one two most",
    "fr": "le la les de des du un une et est que qui dans en pour pas sur au aux avec par ce cette nous se ne plus son sa ses sont ou mais être il elle fait si après n'est l'on lorsque entre tous été ont comme",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über wir wenn aber ob zwischen einen eines zur kann nur haben mehr",
    "es": "el la los las de del que y en un una es se no por con para su al lo como más o este está si pero sus le ha me sin sobre ser entre cuando todo esta también fue son nos hay después tras",
    "it": "il lo la gli le di del della dei che e è in un una per non con si da al sono come più anche questo ma nel alla",
    "pt": "o os as do da dos das que e é em um uma para não com se por no na ao como mais mas foi são pelo",
    "nl": "de het een van en is dat in te niet op voor met zijn aan er om als ook bij door maar uit wordt we deze",
}
COMMON_WORDS = pa.array(sorted({w for ws in COMMON.values() for w in ws.split()}), pa.large_string())
#: The stop words of which published rules want two.
STOP_WORDS = pa.array(["the", "be", "to", "of", "and", "that", "have", "with"], pa.large_string())

# patterns for Arrow's regular expressions, which know no look-around
BLANK = r"[\s\p{Z}]"
LETTER = r"\p{L}"
BULLET = (
    r"^(?:[\s\p{Z}]+o[\s\p{Z}]|[\s\p{Z}]*(?:[-*+•‣◦▪·–—>»→][\s\p{Z}]|[0-9]+(?:\.[0-9]+)+\.?[\s\p{Z}]|\\item\b|\(?[0-9]{1,3}[.)][\s\p{Z}]|\(?[a-zA-Z][.)][\s\p{Z}]"
    r"|\[[0-9]{1,3}\][\s\p{Z}]|#{1,6}[\s\p{Z}]|[☐☑✓]))"
)
REFERENCE = r"^\s*(?:\[[0-9]{1,3}\]|[0-9]{1,3}\.)\s.*(?:\b(?:19|20)[0-9]{2}\b|\bProc\.|\bpp\.)"
KEY_VALUE = r"^\s*[\p{L}\p{N}_\- ]{1,30}:\s+\S"
LEADER = r"(?:\.{4,}|(?: \.){4,}|_{4,})\s*[0-9ivx]+\s*$"
COLUMNS = r"\S {3,}\S+ {3,}"
PAIR = r"[\p{L}\p{N}_]=\S"
NOISE = r"[\p{N}<>{}|#@^~¬_=\\]"
WIDE = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
WIDE_STOP = "[，。、！？；]"
ENDING = r"[.!?:;…。！？][\"')\]”’»\s\p{Z}]*$"
STOP = "[.!?。！？]$"
SYMBOL = r"[#|*~^=<>{}\\_…]|\.\.\."
#: Two-byte text read as one-byte text: a lead byte's letter followed by a continuation byte's sign.
GARBLED = r"[Â-ô][\x{80}-\x{bf}ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
ELISION = "^(?:l|d|n|qu|s|j|c)['’]"

#: Thresholds of a unit.
COMMON_SHARE, ODD_SHARE, SHORT_UNIT, LONG_PARAGRAPH, UNIT_CHARS = 0.15, 0.34, 4, 240, 60
#: Published thresholds of a document.
WORDS_MIN, WORDS_MAX, LENGTH_MIN, LENGTH_MAX, SYMBOLS_MAX, ALPHABETIC_MIN, BULLETS_MAX, ELLIPSIS_MAX, STOP_WORDS_MIN = 50, 100_000, 3.0, 10.0, 0.1, 0.8, 0.9, 0.3, 2
#: Rules of a unit in the order in which they are tried; the first that it fails is its reason.
RULES = ["wide_without_stops", "garbled", "no_words", "columns", "single_letters", "commas", "bullets", "repetition", "numbers_and_symbols", "fragment", "key_value", "common_words", "no_sentence"]
#: A rule is a document's reason if it took this share of the characters.
REASON_SHARE = 0.1


def _has(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)


def _count(a: pa.Array, pattern: str, plain: bool = False) -> np.ndarray:
    got = pc.count_substring(a, pattern) if plain else pc.count_substring_regex(a, pattern)
    return got.to_numpy(zero_copy_only=False).astype(np.int64)


def _len(a: pa.Array) -> np.ndarray:
    return pc.utf8_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(a: pa.Array, pattern: str | None) -> tuple[pa.Array, np.ndarray]:
    """Parts of all strings, and the string each is from; without a pattern the parts between white space, none of them empty."""
    # white space is trimmed first: the kernel that splits at it reads past the end of strings that end in it
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(a)) if pattern is None else pc.split_pattern(a, pattern)
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, of = parts.flatten(), np.repeat(np.arange(len(a)), n)
    if pattern is None:
        full = np.flatnonzero(np.asarray(pc.binary_length(flat)) > 0)
        if len(full) < len(flat):
            flat, of = flat.take(pa.array(full)), of[full]
    return flat, of


def _sums(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights, minlength=n)[:n]


def _kinds(of: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Number of different codes in each group."""
    if not len(of):
        return np.zeros(n, np.int64)
    pair = np.unique(of.astype(np.int64) * (int(codes.max()) + 1) + codes)
    return _sums(pair // (int(codes.max()) + 1), n)


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines without white space at their ends, blank ones too, and the text each is from."""
    if bool(pc.any(pc.match_substring(texts, "\r")).as_py()):
        several = pc.match_substring(texts, "\n")
        texts = pc.if_else(several, pc.replace_substring(texts, "\r", ""), pc.replace_substring(texts, "\r", "\n"))
    lines, doc = _split(texts, "\n")
    return pc.utf8_rtrim_whitespace(lines), doc


def units_of(lines: pa.Array, doc: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units and the text each is from. Lines of a block go on a paragraph where the block is of one width, or where a line goes on in lower case;
    paragraphs of over LONG_PARAGRAPH characters are cut at sentence ends into units of UNIT_CHARS or more."""
    size = _len(lines)
    blank = size == 0
    at = np.flatnonzero(~blank)
    if not len(at):
        return lines.slice(0, 0), doc[:0]
    new_block = np.r_[True, (np.diff(at) > 1) | (np.diff(doc[at]) > 0)]
    lines, doc, size = lines.take(pa.array(at)), doc[at], size[at]
    inner = pc.utf8_trim_whitespace(lines)
    starts = np.flatnonzero(new_block)
    block = np.cumsum(new_block) - 1
    ends = _has(lines, ENDING)
    layout = _has(lines, BULLET) | _has(inner, r"[|\t]|  ") | _has(lines, LEADER)
    plain = ~np.logical_or.reduceat(layout, starts)
    width = np.maximum.reduceat(size, starts)
    last = np.r_[new_block[1:], True]
    even = np.logical_and.reduceat(last | (size >= 0.7 * width[block]), starts) & (width >= 30) & (width <= 120) & (np.diff(np.r_[starts, len(size)]) > 1)
    goes_on = even[block] | (_has(inner, r"^\p{Ll}") & ~np.r_[False, ends[:-1]])
    join = ~new_block & plain[block] & goes_on & (_has(lines, " ") | ends)
    lines = pc.if_else(pa.array(join), inner, lines)
    size = np.where(join, _len(inner), size)
    paragraph = np.cumsum(~join) - 1
    length = _sums(paragraph, paragraph[-1] + 1, size) + _sums(paragraph, paragraph[-1] + 1) - 1
    long = length[paragraph] > LONG_PARAGRAPH
    cut = pc.if_else(pa.array(long), pc.replace_substring_regex(lines, r"([.!?。！？])[\s\p{Z}]+", "\\1\x01"), lines)
    parts, line = _split(cut, "\x01")
    first = np.r_[True, np.diff(line) > 0]
    stopped = _has(lines, STOP)
    # does a unit have to begin here (a new paragraph), may it (a new sentence of a long one)?
    must = first & ~join[line]
    may = long[line] & (~first | np.r_[False, stopped[line[:-1]]])
    begins = _begins(must, may, _len(parts))
    unit = np.flatnonzero(begins)
    offsets = pa.array(np.r_[unit, len(parts)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), pa.scalar(" ", parts.type)), doc[line[unit]]


def _begins(must: np.ndarray, may: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where units begin: where they must, and where they may if the unit so far is long enough."""
    out, held = must.tolist(), 0
    for i, (a, b, n) in enumerate(zip(must.tolist(), may.tolist(), size.tolist())):
        if a or (b and held >= UNIT_CHARS):
            out[i], held = True, n
        else:
            held += n + 1
    return np.array(out, bool)


def rules_of(units: pa.Array, words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit what it is after a unit that is prose and after another one: -1 too short to tell, 0 prose, else 1 + the number of the rule it
    fails; and its characters. words: per unit the words, single letters, common and different ones."""
    n = len(units)
    n_words, single, common, kinds = words
    size = _len(units)
    solid = size - _count(units, " ", True)
    tokens, of = _split(units, None)
    letters = _has(tokens, LETTER)
    n_tokens = np.maximum(_sums(of, n), 1)
    odd = _sums(of, n, (~letters | _has(tokens, NOISE)).astype(float)) / n_tokens
    wide, ends, bullet = _count(units, WIDE), _has(units, ENDING), _has(units, BULLET)
    bars, commas = _count(units, "|", True), _count(units, ",", True)
    share = common / np.maximum(n_words, 1)
    columns = (bars >= 2) | (_count(units, "\t", True) >= 3) | (_count(units, " & ", True) >= 2) | (_count(units, " [»«] ") >= 2) | _has(units, r"^\s*\\(?:begin|end)\{")
    columns |= _has(units, LEADER) | (_count(units, PAIR) >= 2) | _has(units, COLUMNS)
    listed = (commas >= 3) & ((commas >= 0.7 * (n_tokens - 1)) | ~_has(units, " "))
    asian = wide > 0.3 * solid
    full = asian & (wide >= 8)
    rule = {name: i + 1 for i, name in enumerate(RULES)}
    short = n_words <= SHORT_UNIT
    untold = (n_words <= 2) | ends | (share > 0.3)
    conds = [
        (full & _has(units, WIDE_STOP) & (bars < 2) & ~bullet, 0),
        (full, rule["wide_without_stops"]),
        (asian, -1),
        (3 * _count(units, GARBLED) > 0.2 * solid, rule["garbled"]),
        (n_words == 0, rule["no_words"]),
        (columns, rule["columns"]),
        ((n_words >= 8) & (single > 0.5 * n_words), rule["single_letters"]),
        (listed, rule["commas"]),
        (bullet & (n_words >= 8) & (share >= 0.25) & ends & ~_has(units, REFERENCE), 0),
        (bullet, rule["bullets"]),
        ((n_words >= 8) & (kinds < 0.3 * n_words), rule["repetition"]),
        (odd > ODD_SHARE, rule["numbers_and_symbols"]),
        (short & untold, -1),
        (short, rule["fragment"]),
        (_has(units, KEY_VALUE) & ~ends & (n_words <= 9), rule["key_value"]),
        (share < COMMON_SHARE, rule["common_words"]),
        ((n_words <= 8) & ~ends & (share < 0.25), rule["no_sentence"]),
    ]
    alone = np.select([c for c, _ in conds], [np.full(n, v) for _, v in conds], 0)
    # after prose, a short unit that ends a sentence is prose, and a few words without its marks can't be told
    after = alone.copy()
    reached = np.ones(n, bool)
    for c, _ in conds[:12]:
        reached &= ~c
    after[reached & short & ends] = 0
    after[(alone == rule["common_words"]) & (n_words < 7)] = -1
    after[alone == rule["no_sentence"]] = -1
    return after, alone, size


def judged(doc: np.ndarray, after: np.ndarray, alone: np.ndarray, size: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Characters of each text by verdict: column 0 prose, others by rule. Units too short to tell go with the next one that can be told, at the
    end of a text with the one before; where there is none, they are fragments if `closed` says so."""
    out = np.zeros((len(closed), len(RULES) + 1), np.int64)
    fragment = 1 + RULES.index("fragment")
    here, before, waiting = -1, None, 0

    def close() -> None:
        if waiting:
            out[here, before if before is not None else fragment if closed[here] else 0] += waiting

    for d, a, b, n in zip(doc.tolist(), after.tolist(), alone.tolist(), size.tolist()):
        if d != here:
            close()
            here, before, waiting = d, None, 0
        v = a if before == 0 else b
        if v < 0:
            waiting += n
            continue
        out[d, v] += n + waiting
        before, waiting = v, 0
    close()
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """All statistics of a batch of texts without nulls."""
    texts = texts.cast(pa.large_string())
    m = len(texts)
    lines, line_doc = lines_of(texts)
    units, doc = units_of(lines, line_doc)
    n = len(units)
    # words: runs of letters, with apostrophes inside
    spaced = pc.replace_substring_regex(pc.utf8_lower(units), r"[^\p{L}'’]+", " ")
    words, unit = _split(spaced, None)
    words = pc.utf8_trim(words, "'’")
    real = np.flatnonzero(_len(words) > 0)
    words, unit = words.take(pa.array(real)), unit[real]
    coded = words.dictionary_encode() if len(words) else pa.array([], pa.large_string()).dictionary_encode()
    codes, kinds = np.asarray(coded.indices), coded.dictionary
    length = _len(kinds)
    known = pc.is_in(kinds, value_set=COMMON_WORDS).to_numpy(zero_copy_only=False)
    often = known | _has(kinds, ELISION) if len(kinds) else known
    stop = pc.is_in(kinds, value_set=STOP_WORDS).to_numpy(zero_copy_only=False)
    per_unit = (_sums(unit, n), _sums(unit, n, (length == 1)[codes].astype(float)), _sums(unit, n, often[codes].astype(float)), _kinds(unit, codes, n))
    after, alone, size = rules_of(units, per_unit)
    of = doc[unit]
    n_words = _sums(of, m)
    chars, wide = _len(texts), _count(texts, WIDE)
    count = n_words + wide // 2  # a wide character counts as half a word
    filled = _len(lines) > 0
    lines, line_doc = lines.filter(pa.array(filled)), line_doc[filled]
    n_lines = _sums(line_doc, m)
    per_line = lambda pattern: _sums(line_doc, m, _has(lines, pattern).astype(float)) / np.maximum(n_lines, 1)
    tokens, token_doc = _split(texts, None)
    n_tokens = _sums(token_doc, m)
    alphabetic = _sums(token_doc, m, _has(tokens, LETTER).astype(float)) / np.maximum(n_tokens, 1)
    symbols = _count(texts, SYMBOL)
    symbol = np.where(count > 0, symbols / np.maximum(count, 1), (symbols > 0).astype(float))
    mean = _sums(of, m, length[codes].astype(float)) / np.maximum(n_words, 1)
    bullets, dots = per_line(BULLET), per_line(r"(?:\.\.\.|…)$")
    by_rule = judged(doc, after, alone, size, (n_lines >= 3) | ~_has(texts, ENDING))
    told = by_rule.sum(1)
    prose = by_rule[:, 0] / np.maximum(told, 1)
    spoken = wide < 0.3 * chars  # words can be told by blanks
    stops = _kinds(of[stop[codes]], codes[stop[codes]], m)
    published = {
        "word_count": (count < WORDS_MIN) | (count > WORDS_MAX),
        "mean_word_length": (n_words > 0) & spoken & ((mean < LENGTH_MIN) | (mean > LENGTH_MAX)),
        "symbol_ratio": symbol > SYMBOLS_MAX,
        "alphabetic_words": spoken & (alphabetic < ALPHABETIC_MIN),
        "bullet_lines": bullets > BULLETS_MAX,
        "ellipsis_lines": dots > ELLIPSIS_MAX,
        "stop_words": stops < STOP_WORDS_MIN,
    }
    failed = prose <= 0.5
    mine = {name: failed & (by_rule[:, i + 1] > REASON_SHARE * told) for i, name in enumerate(RULES)}
    flags = np.stack([failed & (told == 0), *mine.values(), *published.values()], 1)
    names = pa.array(["no_text", *mine, *published])
    row, which = np.nonzero(flags)
    reasons = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(m + 1)).astype(np.int32)), names.take(pa.array(which)))
    return {
        "words": count,
        "mean_word_length": mean,
        "symbol_ratio": symbol,
        "alphabetic_share": alphabetic,
        "punct_line_share": per_line(ENDING),
        "bullet_line_share": bullets,
        "common_share": _sums(of, m, known[codes].astype(float)) / np.maximum(n_words, 1),
        "common_kinds": _kinds(of[known[codes]], codes[known[codes]], m),
        "ellipsis_line_share": dots,
        "prose_share": prose,
        "reasons": reasons,
    }


FIELDS = [
    ("words", pa.int64(), "bigint"),
    ("mean_word_length", pa.float64(), "double"),
    ("symbol_ratio", pa.float64(), "double"),
    ("alphabetic_share", pa.float64(), "double"),
    ("punct_line_share", pa.float64(), "double"),
    ("bullet_line_share", pa.float64(), "double"),
    ("common_share", pa.float64(), "double"),
    ("common_kinds", pa.int32(), "int"),
    ("ellipsis_line_share", pa.float64(), "double"),
    ("prose_share", pa.float64(), "double"),
    ("reasons", pa.list_(pa.string()), "array<string>"),
]
#: Characters that are measured together: the arrays of units, tokens and words of a batch stay small.
BATCH_CHARS = 4_000_000


def columns_of(texts: pa.Array) -> list[pa.Array]:
    """The FIELDS of texts without nulls, measured in runs of about BATCH_CHARS characters."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_CHARS)) + 1).tolist(), len(texts)]
    parts = [measure(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
    return [pa.chunked_array([pa.array(p[name]).cast(t) for p in parts], t).combine_chunks() for name, t, _ in FIELDS]


def text_quality(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, mean_word_length, symbol_ratio, alphabetic_share, punct_line_share, bullet_line_share, common_share, common_kinds,
    ellipsis_line_share, prose_share, reasons, is_prose), one row per row with a text.

    Null texts give no row. An empty or blank text has no words, prose_share 0 and is no prose. A null id stays null; equal rows
    give equal rows. Whole texts are read, however long. Further columns, whatever their names, are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *columns_of(b.column(1))], names=["id", *(f[0] for f in FIELDS)])

    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))
    return out.withColumn("is_prose", F.col("prose_share") > 0.5)
