"""Splitting oversized texts at natural boundaries by lexical cohesion.

Sentence and paragraph ends are the candidate cuts. At each of them the words of the `block` tokens before and after are compared;
a valley of that similarity marks a change of topic, and its depth is the climb to the peaks on both sides. From the start of a
piece, the deepest valley within the size window is cut; a paragraph end counts `paragraph_bonus` deeper than a sentence end. Where
the window has no natural boundary, the last one before it is taken, else the last gap between words, else the limit itself.
Each further piece begins `overlap` tokens before the cut, within the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
JVM_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x85\x1c-\x1f]"
PARAGRAPH = re.compile(r"\n\s*\n")
ENDS, CLOSERS, WIDE_ENDS = frozenset(".!?…"), frozenset(".!?…\"')]”’»"), frozenset("。！？")


def token_count(text: Column) -> Column:
    """Tokens: longest runs of letters, digits and underscores, or any other single character that is not white space."""
    return F.regexp_count(text, F.lit(JVM_TOKEN))


def boundaries(text: str, spans: np.ndarray, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token positions at which a sentence or paragraph begins, and whether it is a paragraph."""
    n = len(tokens)
    gap = spans[1:, 0] > spans[:-1, 1]  # white space before token i+1
    paragraph = np.zeros(n, bool)
    starts = spans[:, 0]
    for m in PARAGRAPH.finditer(text):
        i = int(np.searchsorted(starts, m.end()))
        if 0 < i < n:
            paragraph[i] = True
    sentence = paragraph.copy()
    for i in range(1, n):
        t = tokens[i - 1]
        if t in WIDE_ENDS:
            sentence[i] = True
        elif t in CLOSERS and gap[i - 1]:
            j = i - 1
            while j > 0 and j > i - 4 and tokens[j] not in ENDS and tokens[j] in CLOSERS:
                j -= 1
            if tokens[j] in ENDS and not tokens[i][0].islower():
                sentence[i] = True
    if not sentence.any() and "\n" in text:  # lists and tables: lines
        for m in re.finditer(r"\n", text):
            i = int(np.searchsorted(starts, m.end()))
            if 0 < i < n:
                sentence[i] = True
    at = np.flatnonzero(sentence)
    return at, paragraph[at]


def depths(ids: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Depth of the cohesion valley at each boundary."""
    sim = np.empty(len(at))
    for k, g in enumerate(at):
        left, right = ids[max(0, g - block) : g], ids[g : g + block]
        words, code = np.unique(np.concatenate([left, right]), return_inverse=True)
        a = np.bincount(code[: len(left)], minlength=len(words)).astype(float)
        b = np.bincount(code[len(left) :], minlength=len(words)).astype(float)
        sim[k] = a @ b / np.sqrt((a @ a) * (b @ b))
    lift, right = sim.copy(), sim.copy()
    for k in range(1, len(at)):  # the peak reached by climbing without a step down
        if sim[k - 1] >= sim[k]:
            lift[k] = lift[k - 1]
    for k in range(len(at) - 2, -1, -1):
        if sim[k + 1] >= sim[k]:
            right[k] = right[k + 1]
    return (lift - sim) + (right - sim)


def cuts(text: str, limit: int, overlap: int, block: int, least: float, paragraph_bonus: float) -> list[tuple[int, int, int]]:
    """(first character, end character, tokens) of each piece; one piece that spans all where the text is within the limit."""
    matches = [m.span() for m in TOKEN.finditer(text)]
    n = len(matches)
    if n <= limit:
        return [(0, len(text), n)]
    spans = np.array(matches)
    tokens = [text[a:b] for a, b in matches]
    at, para = boundaries(text, spans, tokens)
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(t.lower(), len(vocabulary)) for t in tokens])
    worth = depths(ids, at, block) + paragraph_bonus * para
    out, begin, done = [], 0, 0
    while n - begin > limit:
        room = begin + limit
        low = max(done + 1, begin + int(least * limit))
        a, b = np.searchsorted(at, low), np.searchsorted(at, room, side="right")
        if a < b:
            window = worth[a:b]
            cut = int(at[a + len(window) - 1 - int(np.argmax(window[::-1]))])
        else:
            if b and at[b - 1] > done:  # the last boundary before the window
                cut = int(at[b - 1])
            else:
                cut = room
                while cut > low and spans[cut, 0] == spans[cut - 1, 1]:
                    cut -= 1
                if cut <= low:
                    cut = room
        out.append((begin, cut))
        done, begin = cut, max(cut - overlap, begin + 1)
    out.append((begin, n))
    return [(int(spans[a, 0]) if a else 0, int(spans[b, 0]) if b < n else len(text), b - a) for a, b in out]


def split_oversized(
    df: DataFrame,
    key: str,
    text: str,
    limit: int = 600,
    overlap: int = 60,
    block: int = 60,
    least: float = 0.5,
    paragraph_bonus: float = 0.3,
) -> DataFrame:
    """(key, piece, pieces, n_tokens, start, end, text): every text as pieces of at most `limit` tokens.

    A text within the limit is one piece, itself. Otherwise the pieces cover the text without a gap, in order, and neighbours share
    `overlap` tokens (fewer only where a cut lies within `overlap` tokens of the piece's start). start and end are positions of
    characters. Null texts give no row; empty texts give one empty piece; a null key stays null. Equal rows come out as often as
    they went in. Further columns, whatever their names, are not read.
    """
    if not 0 <= overlap < limit * least:
        raise ValueError("overlap must be under the least piece size")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # a text has no more tokens than characters, so short ones need no count
    rows = rows.withColumn("n", F.when(F.length("text") > limit, token_count(F.col("text"))).otherwise(F.lit(0)))
    whole = rows.where(F.col("n") <= limit).select(
        "key",
        F.lit(0).alias("piece"),
        F.lit(1).alias("pieces"),
        F.when(F.length("text") > limit, F.col("n")).otherwise(token_count(F.col("text"))).alias("n_tokens"),
        F.lit(0).alias("start"),
        F.length("text").alias("end"),
        "text",
    )
    schema = df.select(F.col(key).alias("key")).schema.simpleString()[7:-1]  # key:type

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, piece, count, size, start, end, part = [], [], [], [], [], [], []
            for i, t in enumerate(texts):
                got = cuts(t, limit, overlap, block, least, paragraph_bonus)
                for j, (a, b, k) in enumerate(got):
                    row.append(i)
                    piece.append(j)
                    count.append(len(got))
                    size.append(k)
                    start.append(a)
                    end.append(b)
                    part.append(t[a:b])
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    *(pa.array(x, i32) for x in (piece, count, size, start, end)),
                    pa.array(part, pa.string()),
                ],
                names=["key", "piece", "pieces", "n_tokens", "start", "end", "text"],
            )

    large = rows.where(F.col("n") > limit).select("key", "text")
    kind = schema.split(":", 1)[1]
    split = large.mapInArrow(pieces, f"key {kind}, piece int, pieces int, n_tokens int, start int, end int, text string")
    return whole.unionByName(split)
