"""Quality by a convolutional network over bytes, in numpy.

Every byte of a text has a learnt vector. Learnt filters slide over the vectors of eight bytes at every place;
each filter's greatest answer within a chunk describes the chunk. Chunks overlap by half and cover the whole
text. A hidden layer looks at each chunk, so a chunk may be told by what it has and by what it lacks; each
hidden unit's greatest value over all chunks goes into one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended, remainder, small_batches, staged

FIT_ROWS = 6_000  # labelled rows to learn from, the first by a digest of their id
FIT_BYTES = 32 << 20  # and of those texts, whole, so many bytes; a text that does not fit is left out of learning
EPOCHS = 12
SEED = 5

WIDTH, DEPTH, FILTERS, HIDDEN = 8, 8, 48, 48  # bytes a filter sees, numbers a byte, filters, hidden units
BLOCK = 256  # half a chunk
AT_ONCE = 256 * BLOCK  # bytes whose vectors are held at once


class Net:
    """Weights by name. ``embed`` has a row a byte, ``conv`` one column a filter."""

    NAMES = ("embed", "conv", "bias", "hidden", "offset", "out", "shift")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, share: float = 0.5) -> Net:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b, scale: (rng.standard_normal((a, b)) * scale).astype(np.float32)
        w = {"embed": draw(256, DEPTH, 0.5), "conv": draw(WIDTH * DEPTH, FILTERS, 0.25), "bias": np.zeros(FILTERS, np.float32),
             "hidden": draw(FILTERS, HIDDEN, 0.25), "offset": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1, 0.3)[:, 0], "shift": np.float32([np.log(share / (1 - share))])}
        w["embed"][0] = 0  # what short blocks are filled with
        return cls(w)

    def dump(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in self.NAMES)

    @classmethod
    def load(cls, data: bytes) -> Net:
        shapes = {k: v.shape for k, v in cls.fresh().w.items()}
        flat, at, w = np.frombuffer(data, "<f4"), 0, {}
        for k in cls.NAMES:
            n = int(np.prod(shapes[k]))
            w[k], at = flat[at:at + n].reshape(shapes[k]).copy(), at + n
        return cls(w)

    def blocks(self, data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's greatest answer within each block of ``data`` (whole blocks, each text after ``WIDTH`` zeros), and where."""
        n = len(data) // BLOCK
        best = np.full((n, FILTERS), -np.inf, np.float32)
        where = np.zeros((n, FILTERS), np.int64) if places else None
        data = np.append(data, np.zeros(WIDTH, np.uint8))
        for at in range(0, n * BLOCK, AT_ONCE):
            end = min(at + AT_ONCE, n * BLOCK)
            vectors = self.w["embed"][data[at:end + WIDTH]]
            rows = slice(at // BLOCK, end // BLOCK)
            for phase in range(WIDTH):  # places of one phase lie side by side, so nothing is copied
                answers = vectors[phase:phase + end - at].reshape(-1, WIDTH * DEPTH) @ self.w["conv"]
                answers = answers.reshape(-1, BLOCK // WIDTH, FILTERS)
                top = answers.max(1)
                if places:
                    better = top > best[rows]
                    spot = answers.argmax(1) * WIDTH + phase + np.arange(at, end, BLOCK)[:, None]
                    where[rows][better] = spot[better]
                np.maximum(best[rows], top, out=best[rows])
        return best, where

    def forward(self, texts: list[bytes], places: bool = False) -> tuple[np.ndarray, dict]:
        """The logit of each text, and what a step back needs."""
        data, owner = filled(texts)
        best, where = self.blocks(data, places)
        # A chunk is a block and the next of the same text; the only block of a text is a chunk by itself.
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        only = np.flatnonzero(np.bincount(owner, minlength=len(texts))[owner] == 1)
        first = np.sort(np.concatenate([pair, only]))
        second = np.minimum(first + 1, len(owner) - 1)
        second = np.where(owner[second] == owner[first], second, first)
        later = best[second] > best[first]
        chunk = np.maximum(best[first], best[second]) + self.w["bias"]
        seen = np.maximum(chunk, 0)
        hidden = np.maximum(seen @ self.w["hidden"] + self.w["offset"], 0)
        text_of = owner[first]
        starts = np.flatnonzero(np.append(True, text_of[1:] != text_of[:-1]))
        pooled = np.maximum.reduceat(hidden, starts, axis=0)
        logits = pooled @ self.w["out"] + self.w["shift"]
        if not places:
            return logits, {}
        return logits, {"data": data, "where": np.where(later, where[second], where[first]), "chunk": chunk, "seen": seen, "hidden": hidden, "pooled": pooled, "starts": starts}

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the texts and its gradient."""
        logits, kept = self.forward(texts, places=True)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        g = {"out": kept["pooled"].T @ d, "shift": np.float32([d.sum()])}
        # Only the chunk that gave a hidden unit its greatest value passes anything back, and in it the places of the filters.
        ends = np.append(kept["starts"][1:], len(kept["hidden"]))
        picked = np.stack([s + kept["hidden"][s:e].argmax(0) for s, e in zip(kept["starts"], ends)])
        dh = np.zeros_like(kept["hidden"])
        unit = np.broadcast_to(np.arange(HIDDEN), picked.shape)
        dh[picked, unit] = np.outer(d, self.w["out"])
        dh[kept["hidden"] <= 0] = 0
        rows = np.flatnonzero(dh.any(1))
        dh, seen = dh[rows], kept["seen"][rows]
        g["hidden"], g["offset"] = seen.T @ dh, dh.sum(0)
        dc = (dh @ self.w["hidden"].T) * (kept["chunk"][rows] > 0)
        g["bias"] = dc.sum(0)
        spots = kept["data"][np.minimum(kept["where"][rows][..., None] + np.arange(WIDTH), len(kept["data"]) - 1)]
        vectors = self.w["embed"][spots].reshape(len(rows), FILTERS, WIDTH * DEPTH)
        g["conv"] = np.einsum("rfk,rf->kf", vectors, dc)
        back = np.einsum("rf,kf->rfk", dc, self.w["conv"]).reshape(-1, DEPTH)
        g["embed"] = np.stack([np.bincount(spots.ravel(), back[:, k], 256) for k in range(DEPTH)], 1).astype(np.float32)
        g["embed"][0] = 0
        return loss, g


def filled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each after ``WIDTH`` zeros, so that no filter sees two of them, and filled up to whole blocks; and whose each block is."""
    counts = [(len(t) + WIDTH - 1) // BLOCK + 1 for t in texts]
    data = b"".join((bytes(WIDTH) + t).ljust(n * BLOCK, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(data, np.uint8), np.repeat(np.arange(len(texts)), counts)


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3) -> Net:
    """A network learnt by Adam over shuffled batches, with a falling rate."""
    y = np.array(labels, np.float32)
    net = Net.fresh(float(np.clip(y.mean(), 0.02, 0.98)))
    rng = np.random.default_rng(SEED)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, g = net.gradient([texts[i] for i in some], y[some])
            step += 1
            now = rate * min(1.0, step / 50) * (1 - step / (steps + 1))
            for k, v in net.w.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                v -= (now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                if k in ("conv", "hidden", "out"):
                    v *= np.float32(1 - now * 0.01)
    return net


class Model:
    """A network, or without labels none: then every text scores 0.5."""

    def __init__(self, data: bytes | None):
        self.data = data


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """A model of ``label`` (0 or 1) from whole texts of at most ``rows`` labelled documents and ``size`` bytes.

    The sample is chosen by a digest of the id and learnt from in one task, whose memory those bounds hold; the
    weights, 33 KB, come to the driver. Nulls in id or label teach nothing; of several labels of an id the
    greatest counts; equal texts teach once.
    """
    c = F.col
    chosen = (labels.filter(c(doc_id).isNotNull() & c(label).isNotNull()).groupBy(c(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.md5(c("__id").cast("string")), "__id").limit(rows))
    picked = docs.select(c(doc_id).alias("__doc"), F.coalesce(c(text), F.lit("")).alias("text")).join(F.broadcast(chosen), c("__doc") == c("__id"))
    texts = picked.filter(F.octet_length("text") <= size).groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    texts = staged(texts, "quality-sample")

    def train(batches) -> Iterator[pa.RecordBatch]:
        held, marks, room = [], [], size
        for batch in batches:
            for t, y in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist()):
                if len(t) <= room:
                    held.append(t)
                    marks.append(y)
                    room -= len(t)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([fit(held, marks).dump()], pa.binary())], names=["net"])

    ordered = texts.select("text", "label", "h").repartition(1).sortWithinPartitions("h", "label").select("text", "label")
    got = small_batches(ordered).mapInArrow(train, "net binary").collect()
    return Model(bytes(got[0]["net"]) if got else None)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text has the label 1; a null text is an empty one. A column of that name is replaced."""
    data = model.data

    def make():
        net = Net.load(data) if data else None

        def work(texts: list[str | None]):
            held, size = [], 0
            for t in texts:
                held.append((t or "").encode())
                size += len(held[-1])
                if size >= AT_ONCE * 4:
                    yield from probabilities(net, held)
                    held, size = [], 0
            yield from probabilities(net, held)
        return work

    return appended(docs, text, make, f"`{name}` double")


def probabilities(net: Net | None, texts: list[bytes]) -> list[tuple[float]]:
    if not texts:
        return []
    logits = net.forward(texts)[0].tolist() if net else [0.0] * len(texts)
    return [(1 / (1 + exp(-max(-30.0, min(30.0, z)))),) for z in logits]


def learnt_labels(labels: DataFrame, mod: int = 5, doc_id: str = "doc_id") -> DataFrame:
    """Labels whose id is not held out: its remainder is not 0."""
    return labels.filter(remainder(F.col(doc_id), mod) != 0)
