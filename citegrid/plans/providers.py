"""Models as providers. The defaults are deterministic and need no network; their values are not those of hosted models."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

KINDS = ["SEARCH", "GRAPH", "TRENDING", "PATH", "GAPS", "FOLLOWUP", "COMPARE", "DIRECT"]


class Provider(Protocol):
    def embed(self, text: str) -> list[float]: ...
    def expand(self, query: str) -> str | None: ...
    def rewrite(self, query: str, history: list[dict]) -> str: ...
    def answer(self, query: str, context: str, history: list[dict]) -> str: ...
    def classify(self, query: str, history: list[dict]) -> tuple[str, dict]: ...
    def explain(self, titles: list[str]) -> list[str]: ...


class Offline:
    """Hashed words for vectors, rules for classes, extracts for answers."""

    def __init__(self, dim: int = 96):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / size for x in v]

    def expand(self, query: str) -> str | None:
        return f"This paper studies {query} and reports results on {query}."

    def rewrite(self, query: str, history: list[dict]) -> str:
        asked = [m["content"][:150] for m in history[-4:] if m["role"] == "user"]
        return f"{asked[-1]} {query}" if asked and len(query.split()) < 4 else query

    def answer(self, query: str, context: str, history: list[dict]) -> str:
        return context.split("\n\n")[0] if context else "Nothing was found."

    def classify(self, query: str, history: list[dict]) -> tuple[str, dict]:
        q = query.lower()
        if re.search(r"\b(hello|hi|thanks)\b", q):
            return "DIRECT", {}
        if m := re.search(r"from (.+) to (.+)", q):
            return "PATH", {"start": m[1], "end": m[2]}
        for kind, pattern in (("TRENDING", "trend|popular"), ("GAPS", r"\bgaps?\b|unexplored"), ("GRAPH", "author|cites|citation|collaborat"), ("COMPARE", "compare|versus"), ("FOLLOWUP", r"^(and|what about|why)\b")):
            if re.search(pattern, q):
                return kind, {}
        return "SEARCH", {}

    def explain(self, titles: list[str]) -> list[str]:
        return [f"START: {t}" if i == 0 else f"GOAL: {t}" if i == len(titles) - 1 else f"Step {i}: {t}" for i, t in enumerate(titles)]


def unwrap(reply: str) -> tuple[str, dict]:
    """Type and parameters in the JSON of a classifier's reply; SEARCH for anything else."""
    import json

    try:
        got = json.loads(reply.replace("```json", "").replace("```", "").strip())
        kind = str(got.get("type", "SEARCH")).upper()
        return (kind if kind in KINDS else "SEARCH"), dict(got.get("params") or {})
    except (ValueError, AttributeError):
        return "SEARCH", {}
