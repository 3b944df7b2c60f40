"""Scores of texts under a gated recurrent language model.

Words are parted by ASCII blanks, A-Z lowered; every text ends with an end token. All training
tokens are counted. The model predicts units: the most frequent words have one each, other words
share one by their last letters, and within such a unit go by their counts, plus one. A unit's
probability is factored into its class and its place in the class, each a softmax of the state
of a gated recurrent network that has read the text so far. The state is carried from window to
window through the whole text, in training (where gradients stop at the window) and in scoring.

Training is by shards: each task trains from the common weights on its own texts, and the means
of all shards' weights are the next common ones. All training texts are read: there are as many
shards as the corpus fills, the first makes a common start, and then each has its turn in one of
the rounds, at every size of the corpus. Shards are written once and read by their number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt, log10
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended, ascii_lower, small_batches, staged

FREQUENT = 200_000  # words whose counts every task holds, at most
WORDS, TAILS = 352, 160  # units: single words (the end among them), and shared ones
UNITS = WORDS + TAILS
CLASSES = 24
HIDDEN = 32
SHARD = 400_000  # tokens
ROUNDS = 3  # the first, from one shard, makes a common start
LANES, STEPS = 96, 16  # texts side by side and steps of a window, in training
SCORE_LANES, SCORE_STEPS = 256, 32
BLANKS = r"[\x20\x09-\x0D]+"
END = 0


@dataclass
class Vocabulary:
    """Counts of the frequent words; units; the mass that the words of a shared unit have together."""
    index: dict[bytes, int]
    unit: np.ndarray  # of each frequent word
    log_count: np.ndarray  # log10(count + 1) of each
    end_log: float
    mass_log: np.ndarray  # log10 of the mass of each unit; 0 for a unit of one word
    tokens: int
    distinct: int
    units: np.ndarray  # counts of the units


def words(column: str = "text"):
    text = F.coalesce(F.col(column), F.lit(""))
    return F.filter(F.split(ascii_lower(text), BLANKS), lambda w: w != "")


def tail(word):
    """The shared unit of a word: by its last three bytes."""
    return WORDS + F.crc32(F.substring(word.cast("binary"), -3, 3)) % TAILS


def vocabulary(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts of all training tokens: a summary of bounded size, and the table (word, n) of all words."""
    counts = staged(train.select(F.explode(words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    docs = train.select(F.lit(1)).count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count that no more than FREQUENT words reach, from how many words have each count.
    least, held = None, 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > FREQUENT:
            break
        least = r["n"]
    top = counts.filter(F.col("n") >= F.lit(least)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    shared = counts.groupBy(tail(F.col("word")).alias("u")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    names = [w.encode("utf-8", "surrogatepass") for w in top["word"]]
    n_of = top["n"].to_numpy(dtype=np.int64)
    unit = np.array([WORDS + crc32(w[-3:]) % TAILS for w in names], dtype=np.int16).reshape(-1)
    own = min(WORDS - 1, len(names))
    mass, units = np.zeros(UNITS), np.ones(UNITS)
    for r in shared:
        mass[r["u"]], units[r["u"]] = r["n"] + r["v"], units[r["u"]] + r["n"]
    np.subtract.at(mass, unit[:own], n_of[:own] + 1)
    np.subtract.at(units, unit[:own], n_of[:own])
    unit[:own] = np.arange(1, own + 1)
    units[END] += docs
    units[1:own + 1] += n_of[:own]
    mass_log = np.where(np.arange(UNITS) >= WORDS, np.log10(mass + 1), 0.0)  # and one word that was never seen
    return Vocabulary({w: i for i, w in enumerate(names)}, unit, np.log10(n_of + 1.0), log10(docs + 1), mass_log, int(n) + docs, int(v) + (docs > 0), units), counts


def encode(text: bytes | None, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Units of a text's words, indices of its frequent words, and its other words."""
    tokens = (text or b"").lower().split()
    get = vocab.index.get
    at = np.fromiter((get(w, -1) for w in tokens), dtype=np.int64, count=len(tokens))
    known = at >= 0
    units = np.empty(len(tokens), dtype=np.int16)
    units[known] = vocab.unit[at[known]]
    rest = [tokens[k] for k in np.flatnonzero(~known)]
    units[~known] = [WORDS + crc32(w[-3:]) % TAILS for w in rest]
    return units, at[known], rest


def softmax(a: np.ndarray, targets: np.ndarray, every: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each column's target among its rows ``a``, which are used up, and with ``slope`` its gradient by ``a``."""
    a -= a.max(axis=0)
    got = a[targets, every]
    np.exp(a, out=a)
    total = a.sum(axis=0)
    got -= np.log(total)
    if not slope:
        return got, None
    a /= -total
    a[targets, every] += 1
    return got, a


class Network:
    """A gated recurrent network with a factored output, and its gradients.

    Inside, arrays have a row a feature and a column a lane or token, so gates and classes are
    contiguous rows and sums over them run along columns. Output units are in order of class.
    """

    def __init__(self, units: np.ndarray):
        """``units``: counts of the units, for classes of about equal mass and for the first biases."""
        order = np.argsort(-units, kind="stable")
        share = np.cumsum(np.sqrt(units[order])) / np.sqrt(units).sum()
        self.klass = np.empty(UNITS, dtype=np.int64)
        self.klass[order] = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
        sizes = np.bincount(self.klass, minlength=CLASSES)
        self.ends = np.cumsum(sizes)  # of the classes, among the output units
        by_class = np.argsort(self.klass, kind="stable")
        self.place = np.empty(UNITS, dtype=np.int64)  # of each unit in its class
        self.place[by_class] = np.arange(UNITS) - np.repeat(self.ends - sizes, sizes)
        mass = np.maximum(np.bincount(self.klass, units, CLASSES), 1e-3)
        rng = np.random.default_rng(5)
        self.p = {
            "x": rng.normal(0, 0.1, (UNITS, 3 * HIDDEN)), "h": rng.normal(0, 1 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN)),
            "c": rng.normal(0, 0.05, (CLASSES, HIDDEN)), "cb": np.log(mass / mass.sum()),
            "m": rng.normal(0, 0.05, (UNITS, HIDDEN)), "mb": np.log(units / mass[self.klass])[by_class],
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def read(self, inputs: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step (steps, lanes, HIDDEN); ``starts`` marks where a text begins and the state is cleared."""
        w, n = self.p["h"], HIDDEN
        gx = np.ascontiguousarray(self.p["x"][inputs].transpose(0, 2, 1))
        out = np.empty((len(inputs), n, inputs.shape[1]), dtype=np.float32)
        h = np.ascontiguousarray(h.T)
        for t, go_on in enumerate(~starts):
            h = h * go_on
            gh = w @ h
            zr = np.tanh(0.5 * (gx[t, :2 * n] + gh[:2 * n]))
            zr += 1
            zr *= 0.5
            z, r = zr[:n], zr[n:]
            c = np.tanh(gx[t, 2 * n:] + r * gh[2 * n:])
            if keep is not None:
                keep.append((h, z, r, c, gh[2 * n:]))
            h = c + z * (h - c)
            out[t] = h
        return out.transpose(0, 2, 1)

    def log_probability(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithm of each target unit's probability; with ``grads``, those of the sum are added there and that by ``h`` returned."""
        k = self.klass[targets]
        order = np.argsort(k, kind="stable")
        ends = np.cumsum(np.bincount(k, minlength=CLASSES))
        k, place = k[order], self.place[targets[order]]  # classes side by side, until the end
        rows = h[order]
        h, every = np.ascontiguousarray(rows.T), np.arange(len(targets))
        got, d = softmax(self.p["c"] @ h + self.p["cb"][:, None], k, every, grads is not None)
        dh = None
        if grads is not None:
            grads["c"] += d @ rows
            grads["cb"] += d.sum(axis=1)
            dh = self.p["c"].T @ d
        for c in np.unique(k):
            at, own = slice(ends[c - 1] if c else 0, ends[c]), slice(self.ends[c - 1] if c else 0, self.ends[c])
            if own.stop - own.start > 1:
                w = self.p["m"][own]
                inner, d = softmax(w @ h[:, at] + self.p["mb"][own, None], place[at], every[:at.stop - at.start], grads is not None)
                got[at] += inner
                if grads is not None:
                    grads["m"][own] += d @ rows[at]
                    grads["mb"][own] += d.sum(axis=1)
                    dh[:, at] += w.T @ d
        out = np.empty_like(got)
        out[order] = got
        if dh is None:
            return out, None
        back = np.empty_like(rows)
        back[order] = dh.T
        return out, back

    def train_window(self, inputs: np.ndarray, starts: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log probability over a window, and the state after it; targets under 0 do not count."""
        keep: list = []
        states = self.read(inputs, starts, h, keep)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        live = targets >= 0
        _, d = self.log_probability(states[live], targets[live], grads)
        dout = np.zeros(states.shape, dtype=d.dtype)
        dout[live] = d
        dout = np.ascontiguousarray(dout.transpose(0, 2, 1))
        n, w = HIDDEN, np.ascontiguousarray(self.p["h"].T)
        carry = np.zeros(dout.shape[1:], dtype=dout.dtype)
        dx = np.empty((len(inputs), 3 * n, inputs.shape[1]), dtype=dout.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, c, ghc = keep[t]
            g = dout[t] + carry
            gz = g * z
            dc = (g - gz) * (1 - c * c)
            dr = dc * r
            dx[t, :n] = gz * (before - c) * (1 - z)
            dx[t, n:2 * n] = dr * ghc * (1 - r)
            dx[t, 2 * n:] = dr  # by the state's part of the candidate, for now
            grads["h"] += dx[t] @ before.T
            carry = (gz + w @ dx[t]) * ~starts[t]
            dx[t, 2 * n:] = dc
        order = np.argsort(inputs, axis=None, kind="stable")
        units = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
        grads["x"][units[first]] += np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first)
        size = max(1, int(live.sum()))
        return {k: v / size for k, v in grads.items()}, states[-1]


def lanes(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid into at most ``width`` lanes of about equal length, longest lane first: (inputs and targets interleaved as unit rows) and owners.

    Returns units (steps, lanes) with -1 after a lane's end, and the number of the text at each place.
    """
    width = max(1, min(width, len(texts)))
    heap = [(0, k, []) for k in range(width)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k, own = heap[0]
        own.append(i)
        heapq.heapreplace(heap, (size + len(texts[i]), k, own))
    heap.sort(key=lambda x: (-x[0], x[1]))
    units = np.full((heap[0][0], width), -1, dtype=np.int16)
    owner = np.full((heap[0][0], width), -1, dtype=np.int32)
    for k, (size, _, own) in enumerate(heap):
        units[:size, k] = np.concatenate([texts[i] for i in own]) if own else 0
        owner[:size, k] = np.repeat(own, [len(texts[i]) for i in own]) if own else 0
    return units, owner


def windows(texts: list[np.ndarray], width: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, starts, targets, owners) of ``steps`` steps; lanes that have ended are left out. Each text ends with ``END``."""
    units, owner = lanes(texts, width)
    first = np.vstack([np.ones((1, units.shape[1]), dtype=bool), owner[1:] != owner[:-1]])
    for at in range(0, len(units), steps):
        live = int((units[at] >= 0).sum())
        part = slice(at, at + steps), slice(0, live)
        before = np.vstack([units[at - 1:at, :live] if at else np.zeros((1, live), dtype=np.int16), units[part][:-1]])
        yield np.maximum(np.where(first[part], END, before), 0), first[part], units[part], owner[part]


def train(net: Network, texts: list[np.ndarray], rate: float) -> None:
    """One pass over texts by Adam, state and moments carried from window to window."""
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    h = np.zeros((LANES, HIDDEN), dtype=np.float32)
    for step, (inputs, starts, targets, _) in enumerate(windows(texts, LANES, STEPS), 1):
        grads, h = net.train_window(inputs, starts, targets, h[:inputs.shape[1]])
        scale = rate * min(1.0, step / 20)
        for k, g in grads.items():
            m, v = moments[k]
            g = np.clip(g, -0.5, 0.5)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] += scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


def turn_of(shard):
    """The round after the first in which a shard, a number or a column, has its turn."""
    return 1 + shard % (ROUNDS - 1)


def _add(rows: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of weights, and of what they count for."""
    total, n = None, 0.0
    for frame in rows:
        for w, k in zip(frame["w"], frame["n"], strict=True):
            x = np.frombuffer(w, dtype=np.float64)
            total, n = x if total is None else total + x, n + k
    if total is not None:
        yield pd.DataFrame({"w": [total.tobytes()], "n": [n]})


def fit(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, list[int]]:
    """Weights of a network trained on all ``docs`` (text), by rounds of shards; and the tokens read in each round."""
    spark = docs.sparkSession
    shards = max(1, ceil(vocab.tokens / SHARD))
    dealt = docs.select(F.col("text").cast("binary").alias("text")).repartition(shards)
    dealt = staged(dealt.withColumn("shard", F.spark_partition_id()), "training")
    held = spark.sparkContext.broadcast(vocab)
    weights, read = Network(vocab.units).flat(), [0] * ROUNDS

    for turn in range(ROUNDS):
        common = spark.sparkContext.broadcast(weights)
        rate = 0.01 / (1 + turn)

        def run(frames: Iterable[pd.DataFrame], common=common, rate=rate) -> Iterator[pd.DataFrame]:
            shard, net, used = None, None, 0

            def done():
                if used:
                    yield pd.DataFrame({"w": [(net.flat().astype(np.float64) * used).tobytes()], "n": [float(used)]})

            for frame in frames:
                # A task may read the files of several shards, one after another.
                for here, rows in frame.groupby("shard", sort=False):
                    if here != shard:
                        yield from done()
                        shard, net, used = here, Network(held.value.units).load(common.value), 0
                    texts = [np.append(encode(t, held.value)[0], np.int16(END)) for t in rows["text"]]
                    train(net, texts, rate)
                    used += sum(map(len, texts))
            yield from done()

        mine = dealt.filter(F.col("shard") == 0 if turn == 0 else turn_of(F.col("shard")) == turn)
        # A tree of sums: the driver gets about the square root of the shards.
        sums = small_batches(mine).mapInPandas(run, "w binary, n double").repartition(isqrt(shards)).mapInPandas(_add, "w binary, n double").toPandas()
        for mean in _add([sums]):
            weights, read[turn] = (np.frombuffer(mean["w"][0], dtype=np.float64) / mean["n"][0]).astype(np.float32), int(mean["n"][0])
        common.unpersist()
    return weights, read


def log_scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's units, the end among them."""
    out = np.zeros(len(texts))
    if texts:
        h = np.zeros((SCORE_LANES, HIDDEN), dtype=np.float32)
        for inputs, starts, targets, owner in windows(texts, SCORE_LANES, SCORE_STEPS):
            states = net.read(inputs, starts, h[:inputs.shape[1]])
            h = states[-1]
            live = targets >= 0
            got, _ = net.log_probability(states[live], targets[live].astype(np.int64))
            out += np.bincount(owner[live], got, len(texts))
    return out / np.log(10)


def score(docs: DataFrame, train_docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score, a row for each row of ``docs``.

    base_score goes by counts plus one alone; score is the network's log10 probability of the
    whole text. A null text is an empty one, of one token. Words beyond the frequent ones are
    looked up by a join, so no task holds the vocabulary. With no training texts every word is
    new and both scores are finite.
    """
    vocab, counts = vocabulary(train_docs)
    weights, _ = fit(train_docs.select("text"), vocab)
    spark = docs.sparkSession
    held, trained = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(weights)

    def make():
        v = held.value
        net = Network(v.units).load(trained.value)

        def work(values: list) -> Iterator[tuple]:
            texts, rows = [], []
            for text in values:
                units, at, rest = encode(text, v)
                texts.append(np.append(units, np.int16(END)))
                logs = v.log_count[at]
                rows.append((len(units) + 1, len(at) + int(v.distinct > 0), float(logs.sum() + v.end_log), float(logs[v.unit[at] >= WORDS].sum() - v.mass_log[units].sum()), rest))
            for row, units_log in zip(rows, log_scores(net, texts).tolist(), strict=True):
                yield *row, units_log
        return work

    scored = appended(docs.select(*keep, F.col("text").cast("binary").alias("text_")), "text_", make,
                      "n_tokens long, n_frequent long, counts_log double, inner_log double, rest array<binary>, units_log double", drop=True, at_once=10_000)
    scored = staged(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("__row", F.explode("rest").alias("word")).join(counts.select(F.col("word").cast("binary").alias("word"), "n"), "word", "left")
    sums = rest.groupBy("__row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest_log"), F.count("n").alias("n_rest"))
    c = F.col
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return scored.drop("rest").join(sums, "__row", "left").select(
        *[c(f"`{k}`") for k in keep], "n_tokens", (c("n_frequent") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (c("counts_log") + rest_log - c("n_tokens") * log10(vocab.tokens + vocab.distinct + 1)).alias("base_score"),
        (c("units_log") + c("inner_log") + rest_log).alias("score"))
