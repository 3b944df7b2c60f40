"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram binds the first letter's vector
rotated twice, the second's rotated once and the third's as it is, by multiplication. A text's
vector bundles (adds) its trigrams; a language's prototype bundles those of its texts. A text
gets the language whose prototype has the highest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended, small_batches

SYMBOLS = 64  # 0: anything but a letter; 1-26: a-z; the rest: other letters by their code
DIM = 512
PIECE = 1 << 20  # characters looked at together
BATCH = 96  # texts multiplied together
LANGUAGES = 20_000  # more distinct values than this are no column of languages


@cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(2024).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIM))


@cache
def symbol_of() -> np.ndarray:
    """The symbol of each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % (SYMBOLS - 27)
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram numbers of the whole text and how often each occurs; runs of other characters count as one space."""
    found, times, carry = [], [], np.zeros(1, dtype=np.int64)
    text = text.lower()
    for at in range(0, len(text) + 1, PIECE):
        codes = np.frombuffer((text[at:at + PIECE] + (" " if at + PIECE > len(text) else "")).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = np.concatenate([carry, symbol_of()[codes].astype(np.int64)])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        carry = s[-2:]
        ids, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
        found.append(ids)
        times.append(n)
    if len(found) == 1:
        return found[0], times[0]
    ids, back = np.unique(np.concatenate(found), return_inverse=True)
    return ids, np.bincount(back, np.concatenate(times)).astype(np.int64)


def trigram_vectors(ids: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    a, b, c = ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def bundle(ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The bundle of trigrams, in blocks of bounded size."""
    out = np.zeros(DIM)
    for at in range(0, len(ids), 8192):
        out += times[at:at + 8192].astype(np.float64) @ trigram_vectors(ids[at:at + 8192])
    return out


def bundles(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row for each text."""
    every, back = np.unique(np.concatenate([ids for ids, _ in texts]), return_inverse=True)
    counts = np.zeros((len(texts), len(every)), dtype=np.float32)
    counts[np.repeat(np.arange(len(texts)), [len(ids) for ids, _ in texts]), back] = np.concatenate([n for _, n in texts])
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for at in range(0, len(every), 8192):
        out += counts[:, at:at + 8192] @ trigram_vectors(every[at:at + 8192])
    return out


def _sum_profiles(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One bundle a language and task: ``DIM`` whole numbers, so that no order of adding changes them."""
    totals: dict[str, np.ndarray] = {}
    counts = np.zeros(SYMBOLS**3)
    for frame in frames:
        for lang, texts in frame.groupby("lang", sort=False)["text"]:
            for text in texts:
                ids, n = trigrams(text)
                counts[ids] += n
            ids = np.flatnonzero(counts)
            totals[lang] = totals.get(lang, 0) + bundle(ids, counts[ids])
            counts[ids] = 0
    for lang, total in totals.items():
        yield pd.DataFrame({"lang": [lang], "profile": [total]})


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the prototype of each: a row of ``DIM`` numbers.

    Rows with a null text or language teach nothing. What reaches the driver is one row of
    ``DIM`` sums a language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    parts = small_batches(rows).mapInPandas(_sum_profiles, "lang string, profile array<double>")
    sums = parts.select("lang", F.posexplode("profile").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).limit(LANGUAGES + 1).collect()
    if len(got) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages: {lang} is no column of languages")
    got.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in got], np.array([[p["x"] for p in r["v"]] for r in got]).reshape(len(got), DIM)


def identify(docs: DataFrame, profiles: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (the cosine, 0 to 1) of every row.

    A null text, a text without letters, and any text when no language was learnt get ``und``
    and 0. Of equal cosines the first language by name is taken.
    """
    langs, sums = profiles
    unit = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(texts: list) -> Iterator[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        todo: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        for i, t in enumerate([*texts, None]):
            if i < len(texts) and t and langs:
                ids, n = trigrams(t)
                if ids.any():
                    todo.append((i, (ids, n)))
            if todo and (len(todo) == BATCH or i == len(texts)):
                v = bundles([t for _, t in todo])
                cosine = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for (k, _), best, own in zip(todo, cosine.argmax(axis=1), cosine, strict=True):
                    out[k] = langs[best], min(1.0, max(0.0, float(own[best])))
                todo.clear()
        yield from out

    return appended(docs.select(*keep, F.col(text).alias("text_")), "text_", lambda: predict, "lang_pred string, score double", drop=True)
