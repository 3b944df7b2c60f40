"""Secrets in text: fixed patterns, and windows of high Shannon entropy.

Candidate strings are long runs of key characters with both letters and digits. Over each a
window slides; its entropy comes from counts that change by one character in and one out. The
window and the bits that it must reach depend on the narrowest character class the string fits.
Windows above the mark are joined into spans; those that meet a stretch on the allow-list do not count.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended

# Fixed patterns: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
# Character classes, narrowest first: name, pattern of the whole string, window, bits to reach.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 20, 3.0),
    ("alnum", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 20, 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.75),
)
# Allow-list: known harmless strings. A word stands for all letters and digits around it.
ALLOWED = re.compile(
    r"(?P<word>example|sample|dummy|placeholder|changeme|your[-_]|(?<![A-Za-z0-9])x{4,}(?![A-Za-z0-9])|0123456789|abcdefghij|qwertyuiop)"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r"|d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb924",
    re.IGNORECASE,
)


def entropy_windows(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Spans of ``s`` made of joined windows of ``width`` characters with at least ``bits`` of entropy."""
    counts: dict[str, int] = {}
    term = [0.0] + [k * log2(k) for k in range(1, width + 1)]
    total, spans, whole = 0.0, [], log2(width)
    for i, ch in enumerate(s):
        k = counts.get(ch, 0)
        counts[ch] = k + 1
        total += term[k + 1] - term[k]
        if i >= width:
            k = counts[s[i - width]]
            counts[s[i - width]] = k - 1
            total += term[k - 1] - term[k]
        if i + 1 >= width and whole - total / width >= bits:
            start = i + 1 - width
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap for each kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def between_allowed(s: str) -> list[tuple[int, int]]:
    """The stretches of ``s`` before, between and after those on the allow-list."""
    out, at = [], 0
    while m := ALLOWED.search(s, at):
        start, end = m.span()
        if m["word"]:
            while start > at and s[start - 1].isalnum():
                start -= 1
            while end < len(s) and s[end].isalnum():
                end += 1
        out.append((at, start))
        at = end
    return [*out, (at, len(s))]


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of high-entropy stretches."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
            continue
        _, _, width, bits = next(c for c in CLASSES if c[1].fullmatch(s))
        for start, end in between_allowed(s):
            found += [(m.start() + start + a, 3, m.start() + start + b) for a, b in entropy_windows(s[start:end], width, bits)]
    return found


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that meet none of ``base``, which is in order of start."""
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    return [x for x in spans if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[0]]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    more = apart(entropy_spans(text), base)
    n = [sum(1 for b in base if b[1] == kind) for kind in range(3)]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with counts by kind, a digest of the pattern spans, and all spans.

    Spans count code points and end after their last. A null text is an empty one: no spans.
    High-entropy spans that meet a pattern span are left to it. Each row is scanned on its own,
    so repeated rows give repeated results.
    """
    rows = docs.select(*keep, F.col(text).alias("text_"))
    return appended(rows, "text_", lambda: lambda texts: map(scan, texts), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", drop=True)
