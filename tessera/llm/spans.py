"""Spans in texts: (start, end, kind) in code points, their digests, and redaction."""

from __future__ import annotations

import hashlib
import re

Span = tuple[int, int, str]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[2], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of spans, earlier ones first, that overlap neither taken nor each other."""
    kept: list[Span] = []
    for s in spans:
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken) and all(s[1] <= t[0] or t[1] <= s[0] for t in kept):
            kept.append(s)
    return kept


def redact(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the first one's [KIND]."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def matches(pattern: re.Pattern, text: str, group: int = 0) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[group]) for m in pattern.finditer(text)]
