"""Reading names as typed: parts, initials, decoration, organisations, affiliations. Pure functions on one string."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Words around a name that are not part of it.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir"}
DEGREES = {"phd", "md", "msc", "bsc", "esq", "dphil"}
RANKS = {"jr", "sr", "ii", "iii", "iv"}
ORG_KINDS = {
    "collaboration": "collaboration",
    "collab": "collaboration",
    "coll": "collaboration",
    "consortium": "consortium",
    "consort": "consortium",
    "wg": "group",
    "group": "group",
    "team": "team",
    "project": "project",
    "network": "network",
    "initiative": "initiative",
    "committee": "committee",
}
ORG_FILL = {"the", "on", "behalf", "of", "for", "and", "working", "work", "members", "member"}
SMALL = {"of", "for", "the", "and", "in", "at", "de"}
LOOKALIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "4": "a", "8": "b", "6": "g", "7": "t"})


class Name(NamedTuple):
    kind: str  # person or org
    last: str
    given: str  # first given name, full; '' if only an initial is known
    initial: str
    rest: tuple[str, ...]  # further given names or initials
    rank: str


def plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c))


def read_name(name: str) -> Name | None:
    """None where nothing is left after the decoration."""
    s = plain(name)
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|[†‡*§¶#^]", " ", s)
    s = re.sub(r"(?<=[^\W\d_])[\d]+(?:,\d+)*\s*$", " ", s)  # affiliation marks: Name1,2
    s = re.sub(r"(?<=[^\W\d_])\d(?=[^\W\d_])", lambda m: m.group().translate(LOOKALIKE), s)
    s = re.sub(r"([a-z])([A-Z])", r"\1 \2", s) if " " not in s.strip() else s
    words = re.findall(r"[^\W\d_]+", s.lower())
    kinds = [ORG_KINDS[w] for w in words if w in ORG_KINDS]
    if kinds:
        core = [w for w in words if w not in ORG_KINDS and w not in ORG_FILL]
        return Name("org", " ".join(core) or kinds[0], "", "", (), kinds[0]) if core or words else None
    parts = [p.strip() for p in s.split(",")]
    keep = []
    rank = ""
    for p in parts:
        left = []
        for t in p.split():
            w = re.sub(r"[^\w]", "", t).lower()
            if w in TITLES or w in DEGREES or not w:
                continue
            if w in RANKS:
                rank = w
                continue
            left.append(t)
        if left:
            keep.append(left)
    if not keep:
        return None
    if len(keep) >= 2:
        last, given = keep[0], keep[1]
    else:
        t = keep[0]
        tail = re.sub(r"[^\w]", "", t[-1])
        if len(t) == 2 and 1 <= len(tail) <= 2 and tail.isupper() and len(re.sub(r"\W", "", t[0])) > 2:
            last, given = t[:1], t[1:]  # Last FM
        else:
            last, given = t[-1:], t[:-1]
    surname = re.sub(r"[\W\d_]", "", "".join(last).lower())
    tokens: list[str] = []
    for t in given:
        for x in re.split(r"[.\s]+", t):
            w = re.sub(r"[^\w]", "", x)
            if not w:
                continue
            if len(w) <= 3 and w.isupper() and (len(w) == 1 or not any(c in "AEIOU" for c in w) or len(w) == 2):
                tokens += list(w.lower())
            else:
                tokens.append(w.lower())
    first = tokens[0] if tokens else ""
    return Name("person", surname, first if len(first) > 1 else "", first[:1], tuple(tokens[1:]), rank)


def _small(w: str) -> bool:
    """A particle, also with a slip in it."""
    return w in SMALL or (len(w) <= 4 and any(edits(w, x, 1) <= 1 for x in SMALL if len(x) > 1))


def read_affiliation(a: str | None) -> tuple[str, str, str]:
    """(acronym, full name or '', place or '')."""
    if not a or not a.strip():
        return "", "", ""
    s = plain(a).strip()
    head, _, place = s.partition(",")
    m = re.fullmatch(r"([A-Z]{2,5})(?:\s+(\S.*))?", head.strip())
    if m and not (m.group(2) or "").isupper():
        return m.group(1).lower(), "", (m.group(2) or place).strip().lower()
    words = [w.translate(LOOKALIKE) for w in re.findall(r"[^\W_]+", head.lower())]
    letters = "".join(w[0] for w in words if not _small(w))
    return letters, " ".join(words), place.strip().lower()


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            cur.append(v)
        if min(cur) > most:
            return most + 1
        before, prev = prev, cur
    return prev[-1]


def same_affiliation(a: tuple[str, str, str], b: tuple[str, str, str]) -> int:
    """1: the same, -1: another, 0: not known."""
    if not a[0] or not b[0]:
        return 0
    if a[1] and b[1]:
        return 1 if edits(a[1], b[1], 2) <= 2 else -1
    if a[0] == b[0]:
        return 1 if not a[2] or not b[2] or edits(a[2], b[2], 1) <= 1 else -1
    return 0 if edits(a[0], b[0], 1) <= 1 and (a[2] == b[2] or min(len(a[0]), len(b[0])) > 2) else -1  # a slip in the full form changes its letters
