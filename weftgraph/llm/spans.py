"""Spans of characters found in texts: their order and their digest."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end of each span by start, then by the kind's place in `kinds`, then by end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def ascii_lower(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-32-le", "surrogatepass").lower().decode("utf-32-le", "surrogatepass")
