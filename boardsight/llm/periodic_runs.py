"""Periodic runs of words, found as maximal pairs of bounded distance.

The repeated word sequences of a text are the intervals of its LCP-interval tree. The tree is walked
bottom up; each interval holds its positions in order, and the word to the left of a position is its
class. Two positions of one interval that come from different children (no common word follows) and
are of different classes (no common word precedes) are a maximal pair. A pair ``q`` apart with ``l``
words in common is a stretch of ``q + l`` words of period ``q`` that neither neighbour extends, so with
``l >= max(6 - q, 3 * q)`` the pair is a run as it stands, once multiples of a smaller period are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended

LEAST_WORDS, LEAST_PERIODS = 6, 4
LEAST_COMMON = LEAST_WORDS - 1  # words in common that every pair of a run has
TOGETHER = 1 << 20  # characters of texts whose suffixes are sorted together

FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def number(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words of several texts, after one another, each text ended by a number of its own; and where each text starts.

    Equal words of one text have equal numbers, words of different texts never.
    """
    parts, starts, used, at = [], [], 0, 1
    parts.append(np.zeros(1, np.int64))
    for words in texts:
        ids = {w: k for k, w in enumerate(dict.fromkeys(words), used + 1)}
        used += len(ids) + 1
        starts.append(at)
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([used], np.int64))
        at += len(words) + 1
    return np.concatenate(parts), np.array(starts, np.int64)


def repeated(x: np.ndarray) -> np.ndarray:
    """Places, in order, from where ``LEAST_COMMON`` words occur more than once (and, seldom, places whose words only look so by a hash)."""
    n = len(x) - LEAST_COMMON + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h = x[:n].astype(np.uint64)
    for k in range(1, LEAST_COMMON):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k:k + n].astype(np.uint64)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return np.flatnonzero(twice[spot] == h)


def sort_suffixes(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of the suffixes that start there, by prefix doubling.

    Suffixes tied over ``w`` words are compared by what follows them ``w`` words on. All words of a tie
    start in ``places`` but the last few, so the places ``LEAST_COMMON`` further on are all that has to be ranked besides.
    """
    x = np.append(x, np.zeros(LEAST_COMMON + 1, np.int64))
    ranked = np.union1d(places, places + LEAST_COMMON)
    key = x[ranked]
    for k in range(1, LEAST_COMMON):
        _, key = np.unique(key * (int(x.max()) + 1) + x[ranked + k], return_inverse=True)
    order = np.argsort(key, kind="stable")
    key, width = key[order], LEAST_COMMON
    todo = np.arange(len(ranked))  # indexes into the order whose suffixes are still tied
    first = np.zeros(len(ranked), np.int64)
    rank = np.zeros(len(x) + 1, np.int64)
    while True:
        # A rank is the index of the first suffix of its tie, so ranks of settled suffixes never change.
        new = np.append(True, key[1:] != key[:-1])
        first[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        rank[ranked[order[todo]]] = first[todo]
        todo = todo[~(new & np.append(new[1:], True))]
        if not len(todo):
            chosen = np.zeros(len(x), bool)
            chosen[places] = True
            return (at := ranked[order])[chosen[at]]
        key = first[todo] * (len(ranked) + 1) + rank[ranked[order[todo]] + width]
        moved = np.argsort(key, kind="stable")
        order[todo], key = order[todo][moved], key[moved]
        width *= 2


def common_words(x: list[int], ordered: np.ndarray) -> list[int]:
    """Of each suffix but the first, in order: how many words it shares with the one before (0 where fewer than ``LEAST_COMMON``)."""
    before = dict(zip(ordered[1:].tolist(), ordered[:-1].tolist()))
    shared, last, n = {}, (-2, 0), len(x)
    for i in np.sort(ordered[1:]).tolist():
        j, h = before[i], last[1] - 1 if last[0] == i - 1 and last[1] > LEAST_COMMON else 0
        while i + h < n and j + h < n and x[i + h] == x[j + h]:
            h += 1
        shared[i], last = h, (i, h)
    return [h if (h := shared[i]) >= LEAST_COMMON else 0 for i in ordered[1:].tolist()]


def maximal_pairs(x: list[int], ordered: list[int], shared: list[int]):
    """(place, distance, words in common) of the maximal pairs at most a third of their common words apart.

    Occurrences of a sequence of ``l`` words within ``l / 3`` of each other are evenly spaced by its
    period, all but the first of them in one class and all but the last in one child. So of the positions
    of the other child near a position only the farthest before and the next after can be of another class.
    """
    stack: list[tuple[int, list[int]]] = []

    def merged(a: list[int], b: list[int], depth: int, out: list):
        if len(a) < len(b):
            a, b = b, a
        reach = depth // (LEAST_PERIODS - 1)
        for i in b:
            k = bisect_left(a, i - reach)
            if k < len(a) and a[k] < i and x[a[k] - 1] != x[i - 1]:
                out.append((a[k], i - a[k], depth))
            k = bisect_left(a, i)
            if k < len(a) and a[k] - i <= reach and x[a[k] - 1] != x[i - 1]:
                out.append((i, a[k] - i, depth))
        if len(b) < 16:
            for i in b:
                insort(a, i)
        else:
            a.extend(b)
            a.sort()
        return a

    out: list[tuple[int, int, int]] = []
    here = [ordered[0]] if ordered else []
    for place, depth in zip(ordered[1:], shared):
        while stack and stack[-1][0] >= depth:
            above, group = stack.pop()
            here = merged(group, here, above, out)
        if depth:
            stack.append((depth, here))
        here = [place]
    while stack:
        above, group = stack.pop()
        here = merged(group, here, above, out)
    return out


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text: (start, length, smallest period), by start, then period."""
    x, starts = number(texts)
    places = repeated(x)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(places):
        return found
    ordered, words = sort_suffixes(x, places), x.tolist()
    best: dict[tuple[int, int], int] = {}
    for at, apart, depth in maximal_pairs(words, ordered.tolist(), common_words(words, ordered)):
        if depth >= LEAST_WORDS - apart:
            stretch = (at, apart + depth)
            best[stretch] = min(best.get(stretch, apart), apart)
    owner = np.searchsorted(starts, [at for at, _ in best], side="right") - 1 if best else []
    for ((at, length), period), doc in zip(best.items(), owner):
        found[doc].append((at - int(starts[doc]), length, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run has after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), start, length, period, 1000 * length // period if runs else None,
            sha256(lines.encode()).hexdigest(), sha256(collapsed(words, runs)).hexdigest())


def _measure():
    def work(texts: list[str | None]):
        group, size = [], 0
        for text in texts:
            words = (text or "").encode().split()  # bytes split at ASCII white space only
            group.append(words)
            size += len(text or "")
            if size >= TOGETHER:
                yield from map(row, group, runs_of(group))
                group, size = [], 0
        yield from map(row, group, runs_of(group))
    return work


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the periodic runs of words of each whole text.

    Columns: ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties:
    smallest start, then period; null without runs); digests of all runs and of the text without repeats.
    Columns of these names are replaced. A null or empty text has no runs. Repeated rows are measured each on its own.
    """
    return appended(docs, text, _measure, FIELDS)


def list_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``doc_id``, start, length, period) for each run of each text, and none for texts without."""
    runs = appended(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", _list, "runs array<struct<start: long, length: long, period: long>>", drop=True)
    return runs.select("doc_id", F.inline("runs"))


def _list():
    def work(texts: list[str | None]):
        for text in texts:
            yield ([{"start": s, "length": n, "period": q} for s, n, q in runs_of([(text or "").encode().split()])[0]],)
    return work


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with what each run repeats taken out of ``text``; a text without runs, or null, stays as it is, white space too."""
    clean = appended(docs, text, _collapse, "__clean string")
    kept = [F.coalesce("__clean", text).alias(text) if c == text else F.col(c) for c in docs.columns]
    return clean.select(*kept)


def _collapse():
    def work(texts: list[str | None]):
        for text in texts:
            words = (text or "").encode().split()
            runs = runs_of([words])[0]
            yield (collapsed(words, runs).decode() if runs else None,)
    return work


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periods put into the texts of every tenth digest of the id (see the contract of ``op11_periodic_runs``)."""
    c = F.col
    h = F.crc32(c(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(c(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("__h", h).withColumn("__w", F.when(c("__h") % 10 == 0, words)).withColumn("__n", F.size("__w"))
    g = F.floor(c("__h") / 10)
    chosen = chosen.withColumn("__a", F.when(c("__n") > 0, g % c("__n")).cast("int")).withColumn("__p", F.floor((c("__n") - c("__a")) / (3 + g % 8)).cast("int") + 1)
    again = F.slice(F.flatten(F.array_repeat(F.slice("__w", c("__a") + 1, c("__p")), (3 + g % 8).cast("int"))), F.lit(1), c("__n") - c("__a"))
    edited = F.when(c("__n") > 0, F.array_join(F.concat(F.slice("__w", F.lit(1), c("__a")), again), " "))
    return chosen.withColumn(text, F.coalesce(edited, c(text))).drop("__h", "__w", "__n", "__a", "__p")
