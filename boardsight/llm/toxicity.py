"""Toxicity: a learnt lexicon, matched with misspellings, and scored by context.

Terms, whole words and word beginnings, are learnt from labelled texts: those far more frequent
in toxic ones. They stand in a trie. A word of the text is matched by walking the trie together
with the states of a Levenshtein automaton of the word, so one edit is forgiven where a term is
long enough. Each match then gets a score from the words around it: quotation marks and verbs of
saying speak for a quotation, words that address someone for abuse. A logistic model over the
sums of what was matched, abusive and quoted, exact and misspelled, gives the probability.
"""

from __future__ import annotations

from collections import defaultdict
from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended, remainder, staged

FIT_ROWS = 10_000  # labelled rows to learn from, the first by a digest of their id
TERMS = 4_000  # terms in the lexicon
STEM = (4, 7)  # lengths of the word beginnings that may become terms
LEAST_LOG_ODDS = 2.0
FUZZY_LENGTH = 5  # a term this long forgives one edit
AROUND = 8  # words to either side that make the context
MEMO = 100_000  # words whose match a task remembers
FEATURES = 6

EDGES = ".,;:!?\"'()[]{}<>*$%&#@|~^_=+-/\\…«»“”„‘’‚`´"
OPEN, CLOSE = "\"“„«‘‚(", "\"”“»’)"
# Fixed word lists: verbs and nouns of reported speech, and words that address someone.
SAYING = frozenset("said says say wrote writes quoted quote quotes called calls reported reports term word words slur so-called sagte sagt schrieb zitat wort nannte dit écrit mot cité appelé dijo dice escribió palabra cita llamó".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes eres".split())


class Lexicon:
    """Terms with weights: whole words, and beginnings that stand for all words that go on from them."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.words = {t: w for t, stem, w in terms if not stem}
        self.stems = {t: w for t, stem, w in terms if stem}
        self.starts = {t[:STEM[0]] for t in self.stems}
        self.trie: dict = {}
        self.mirror: dict = {}  # the terms from behind
        # Of three parts of a term one edit leaves two as they are: what a word then starts and ends with, by the term's length.
        kept: dict[int, dict[tuple[int, int], set[str]]] = defaultdict(lambda: defaultdict(set))
        for term, weight in self.words.items():
            k = len(term)
            if k >= FUZZY_LENGTH:
                for node, letters in ((self.trie, term), (self.mirror, term[::-1])):
                    for ch in letters:
                        node = node.setdefault(ch, {})
                    node[""] = weight
                third = k // 3
                for start, end in ((k - third, 0), (0, k - third), (third, third)):
                    kept[k][start, end].add(f"{term[:start]}|{term[k - end:]}")
        self.near: dict[int, list[tuple[int, int, set[str]]]] = {}
        for n in {k + d for k in kept for d in (-1, 0, 1)}:
            at: dict[tuple[int, int], set[str]] = defaultdict(set)
            for k in (n - 1, n, n + 1):
                for ends, parts in kept.get(k, {}).items():
                    at[ends] |= parts
            self.near[n] = [(start, n - end, parts) for (start, end), parts in at.items()]
        self.memo: dict[str, tuple[bool, float] | None] = {}

    def match(self, token: str) -> tuple[bool, float] | None:
        """(spelled exactly, weight) of the heaviest term that the token stands for."""
        if token not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = self._match(token.strip(EDGES))
        return self.memo[token]

    def _match(self, word: str) -> tuple[bool, float] | None:
        exact = [self.words[word]] if word in self.words else []
        if word[:STEM[0]] in self.starts:
            exact += [self.stems[word[:k]] for k in range(STEM[0], min(STEM[1], len(word)) + 1) if word[:k] in self.stems]
        if exact:
            return True, max(exact)
        weight = 0.0
        for start, end, parts in self.near.get(len(word), ()):
            if f"{word[:start]}|{word[end:]}" in parts:
                found = self._walk(self.trie, word, start) if start else self._walk(self.mirror, word[::-1], len(word) - end)
                weight = max(weight, found)
        return (False, weight) if weight else None

    def _walk(self, trie: dict, word: str, known: int) -> float:
        """The heaviest term within one edit of ``word`` that shares its first ``known`` letters.

        A state of the word's Levenshtein automaton is two sets of positions, as bits: those
        reached without an edit and with one. Branches whose state is empty are left. Letters in
        common at the start need no edit, so the walk sets out behind them.
        """
        for ch in word[:known]:
            trie = trie.get(ch)
            if trie is None:
                return 0.0
        whole, end = (2 << len(word)) - 1, 1 << len(word)
        at: dict[str, int] = {}
        for k, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << k
        best, todo = 0.0, [(trie, 1 << known, 2 << known)]
        while todo:
            node, free, spent = todo.pop()
            if (free | spent) & end and node.get("", 0.0) > best:
                best = node[""]
            for ch in node if free else [c for c, x in at.items() if x & spent and c in node]:
                if ch:
                    here = at.get(ch, 0)
                    kept = (free & here) << 1
                    lost = ((spent & here) << 1 | free << 1 | free | kept << 1) & whole
                    if kept or lost:
                        todo.append((node[ch], kept, lost))
        return best


def abuse(tokens: list[str], at: int) -> float:
    """0 to 1: whether the word at ``at`` is used (high) or quoted (low), by the words around it."""
    before, after = tokens[max(0, at - AROUND):at], tokens[at + 1:at + 1 + AROUND]
    opened = any(t[0] in OPEN and not (len(t) > 1 and t.rstrip(".,;:!?")[-1:] in CLOSE) for t in before[-4:]) or tokens[at][0] in OPEN
    closed = any(t.rstrip(".,;:!?")[-1:] in CLOSE and t[-1:] != "(" for t in after[:4]) or (len(tokens[at]) > 1 and tokens[at].rstrip(".,;:!?")[-1:] in CLOSE)
    near = {t.strip(EDGES) for t in before + after}
    z = 1.0 + 1.5 * bool(near & ADDRESS) - 2.0 * (opened and closed) - 1.0 * bool(near & SAYING)
    return 1.0 / (1.0 + exp(-z))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of the whole text: logarithms of matched weight, exact and misspelled, each used and quoted; of distinct matches; and a constant."""
    tokens = (text or "").lower().split()
    known, match = lexicon.memo, lexicon.match
    hits = {t: m for t in set(tokens) if (m := known[t] if t in known else match(t))}
    sums = [0.0] * 4
    if hits:
        for at, t in enumerate(tokens):
            if t in hits:
                exact, weight = hits[t]
                used = abuse(tokens, at)
                k = 0 if exact else 2
                sums[k] += weight * used
                sums[k + 1] += weight * (1 - used)
    return [*map(log1p, sums), log1p(len({t.strip(EDGES) for t in hits})), 1.0]


def count_words(rows: DataFrame) -> tuple[DataFrame, dict[bool, tuple[int, int]]]:
    """Of labelled ``rows`` (text, toxic, half): a table of words with how many texts of each half
    have them, and how many toxic ones; and how many texts and toxic texts each half has.

    Texts count once, however often they are repeated.
    """
    c = F.col
    texts = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("half").alias("half"), F.first("text").alias("text"))
    texts = staged(texts, "labelled")
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES))))).alias("term")
    each = texts.select("toxic", "half", word).filter(F.length("term").between(3, 40))
    toxic = c("toxic") == 1
    words = each.groupBy("term").agg(F.count_if("half").alias("n1"), F.count_if(~c("half")).alias("n0"),
                                      F.count_if(c("half") & toxic).alias("pos1"), F.count_if(~c("half") & toxic).alias("pos0"))
    sizes = texts.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).collect()
    return staged(words, "words"), {r["half"]: (r["n"], r["toxic"]) for r in sizes}


def mine_terms(words: DataFrame, sizes: dict[bool, tuple[int, int]], halves: tuple[bool, ...] = (True, False)) -> list[tuple[str, bool, float]]:
    """The lexicon of the given halves: terms by how much more often they occur in toxic texts.

    A term needs at least 3 toxic texts, and 1 in 200 of them; a beginning, counted over the
    words that go on from it, also three of those.
    """
    c = F.col
    n, toxic = (sum(sizes.get(h, (0, 0))[k] for h in halves) for k in (0, 1))
    added = lambda name: sum((c(f"{name}{int(h)}") for h in halves), F.lit(0))
    found = words.select("term", added("pos").alias("pos"), added("n").alias("n")).filter("n > 0")
    lengths = F.filter(F.array(*[F.lit(k) for k in range(STEM[0], STEM[1] + 1)]), lambda k: k < F.length("term"))
    stems = found.select("pos", "n", F.explode(F.transform(lengths, lambda k: F.substring(c("term"), F.lit(1), k))).alias("term"))
    stems = stems.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.lit(True).alias("stem"))
    counted = found.select("term", "pos", "n", F.lit(3).cast("long").alias("forms"), F.lit(False).alias("stem")).unionByName(stems)
    odds = F.log((c("pos") + 0.5) / (toxic + 1.0)) - F.log((c("n") - c("pos") + 0.5) / (n - toxic + 1.0))
    least = max(3, toxic // 200)
    got = (counted.filter((c("pos") >= least) & (c("forms") >= 3)).withColumn("w", odds).filter(c("w") >= LEAST_LOG_ODDS)
           .orderBy((c("w") * c("pos")).desc(), "term", "stem").limit(TERMS).collect())
    return [(r["term"], r["stem"], min(8.0, r["w"])) for r in got]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton steps; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


class Model:
    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray):
        self.terms, self.weights = terms, weights


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model of ``label`` (0 or 1) from at most ``rows`` labelled documents.

    The labels to use are chosen by a digest of the id and broadcast (their number is bounded by
    ``rows``), so texts are not shuffled. The logistic weights are fitted across: each half of
    the rows gets the lexicon of the other. Nulls in id or label teach nothing; of several
    labels of an id the greatest counts. With no labels every text scores 0.
    """
    c = F.col
    chosen = (labels.filter(c(doc_id).isNotNull() & c(label).isNotNull()).groupBy(c(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("toxic"))
              .orderBy(F.md5(c("__id").cast("string")), "__id").limit(rows))
    picked = docs.select(c(doc_id).alias("__doc"), F.coalesce(c(text), F.lit("")).alias("text")).join(F.broadcast(chosen), c("__doc") == c("__id"))
    picked = staged(picked.select("text", "toxic", (F.substring(F.md5("text"), 1, 1) < "8").alias("half")), "picked")
    words, sizes = count_words(picked)
    table = []
    for half in (True, False):
        other = mine_terms(words, sizes, (not half,))
        table += _measured(picked.filter(c("half") == half), other).collect()
    if not table:
        return Model([], np.array([0.0] * (FEATURES - 1) + [-30.0]))
    x, y = np.array([r["x"] for r in table]), np.array([r["toxic"] for r in table], dtype=float)
    return Model(mine_terms(words, sizes), fit(x, y))


def _measured(rows: DataFrame, terms: list[tuple[str, bool, float]]) -> DataFrame:
    return appended(rows.select("text", "toxic"), "text", lambda: _measure(terms), "x array<double>", drop=True)


def _measure(terms: list[tuple[str, bool, float]]):
    lexicon = Lexicon(terms)
    return lambda texts: ((features(t, lexicon),) for t in texts)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; a null text is an empty one. A column of that name is replaced."""
    terms, weights = model.terms, model.weights

    def make():
        lexicon = Lexicon(terms)
        return lambda texts: ((1 / (1 + exp(-max(-30.0, min(30.0, float(weights @ features(t, lexicon)))))),) for t in texts)

    return appended(docs, text, make, f"`{name}` double")


def learnt_labels(labels: DataFrame, mod: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """Labels whose id is not held out."""
    return labels.filter(remainder(F.col(doc_id), mod) != 2)
