"""Periodic runs, byte-level quality and phrase collocations."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardsight.llm import byte_quality as bq, collocations as co, periodic_runs as pr, plans

SMALL = "/root/testdata/sf0.001"


# ---- Periodic runs ----------------------------------------------------------------------------

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_maximal_pairs_are_the_runs():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
            w = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if w and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w * rng.randint(1, 3))
        assert pr.runs_of(docs) == [brute_runs(w) for w in docs]


def test_very_long_repetitive_texts():
    assert pr.runs_of([[b"a"] * 100_000, [b"a", b"b", b"c"] * 30_000, [], [b"x"]]) == [[(0, 100_000, 1)], [(0, 90_000, 3)], [], []]


def test_periodic_runs_query_equals_plain_code(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = plans.QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and any(r["n_runs"] for r in got)
    for r in got:
        w = re.findall("[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert r["collapsed_sha256"] == sha256(" ".join(kept).encode()).hexdigest()


def test_runs_of_odd_documents(spark, odd_docs, no_docs):
    got = pr.find_runs(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["n_runs"] == 0 for r in got if not (r["text"] or "").strip())
    assert set(odd_docs.columns) <= set(got[0].asDict())
    assert pr.find_runs(no_docs).count() == 0 and pr.collapse(no_docs).columns == no_docs.columns
    docs = spark.createDataFrame([(1, "go a  b a b a b\na b on"), (1, "go a  b a b a b\na b on"), (2, None), (3, "  just  words ")], "doc_id long, text string")
    assert sorted(map(tuple, pr.list_runs(docs).collect())) == [(1, 1, 8, 2)] * 2
    assert sorted((r["doc_id"], r["text"]) for r in pr.collapse(docs).collect() if r["text"]) == [(1, "go a b on"), (1, "go a b on"), (3, "  just  words ")]


# ---- Quality ----------------------------------------------------------------------------------

def test_blocks_equal_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = bq.Net.fresh()
    for n in (0, 1, 247, 248, 249, 600):
        data, owner = bq.filled([rng.integers(0, 256, n, np.uint8).tobytes()])
        best, where = net.blocks(data, places=True)
        padded = np.append(data, np.zeros(bq.WIDTH, np.uint8))
        for b in range(len(owner)):
            answers = np.stack([net.w["embed"][padded[i:i + bq.WIDTH]].ravel() @ net.w["conv"] for i in range(b * bq.BLOCK, (b + 1) * bq.BLOCK)])
            assert np.allclose(best[b], answers.max(0), atol=1e-5)
            assert np.allclose(answers[where[b] - b * bq.BLOCK, np.arange(bq.FILTERS)], answers.max(0), atol=1e-5)


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    net = bq.Net.fresh()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["bias"] += 0.1
    texts, y = [rng.integers(1, 256, n, np.uint8).tobytes() for n in (30, 700, 300)], np.array([0, 1, 1.0])
    _, g = net.gradient(texts, y)
    for name in ("out", "hidden", "bias", "conv"):
        flat = net.w[name].reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False):
            kept = flat[i]
            losses = []
            for step in (1e-3, -1e-3):
                flat[i] = kept + step
                losses.append(net.gradient(texts, y)[0])
            flat[i] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name].reshape(-1)[i]) < 5e-3


def test_a_text_scores_alike_alone_and_among_others():
    net = bq.Net.fresh()
    texts = [b"x" * 5, b"some words here " * 90, b"", b"y" * 248]
    together = net.forward(texts)[0]
    assert np.allclose(together, [net.forward([t])[0][0] for t in texts], atol=1e-5)
    assert np.allclose(bq.Net.load(net.dump()).forward(texts)[0], together)


def test_quality_is_learnt_and_held_out_rows_are_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in plans.QUERIES["op12_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[i]["predicted"] == q for i, q in known) / len(known) > 0.88
    seen = bq.learnt_labels(labels).collect()
    assert seen and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in seen)


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (5, 1), (99, 1)], "doc_id long, quality int")
    model = bq.learn(odd_docs, labels)
    got = bq.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    nothing = bq.learn(no_docs, labels)
    assert nothing.data is None and {r["score"] for r in bq.score(odd_docs, nothing).collect()} == {0.5}
    assert bq.score(no_docs, model).count() == 0


# ---- Collocations -----------------------------------------------------------------------------

def brute_phrases(rows, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < 10:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        if len(p) == 2 and any(100 * m >= 50 * a for (o, t), m in f.items() if o == lang and len(t) == 3 and m >= 10 and p in (t[:2], t[1:])):
            continue
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    return [(r[0], ranks[r[0]], *r[1:]) for r in out if ranks.update([r[0]]) or ranks[r[0]] <= top]


def listed(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("chunk, shard, at_once", [(1 << 20, 2 << 20, 96 << 20), (300, 40, 1000)])
def test_collocations_equal_plain_code(spark, monkeypatch, chunk, shard, at_once):
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(co, "SHARD_BYTES", shard)
    monkeypatch.setattr(co, "PASS_BYTES", at_once)
    rng = random.Random(6)
    words = ["New", "york", "the", "of", "é", "über", "a-b", "ÉT", "x\x00y", "漢字", "\x1d"]
    rows = [(None, "en"), ("", None), (" ,. \n", "en")]
    for lang in ("en", "de", None, "und", "", "é\n"):
        for _ in range(25):
            rows.append(("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for _ in range(rng.randint(1, 60))), lang))
    rows += [("new york city", "en")] * 12 + [("only twice", "fr")] * 9
    docs = spark.createDataFrame([(t, lang, 1, "n") for t, lang in rows], "text string, lang string, rank int, phrase string").repartition(3)
    if chunk == 300:
        monkeypatch.setattr(co, "TOP", 5)
        assert listed(co.collocations(docs, top=5)) == sorted(brute_phrases(rows, 5))
    else:
        assert listed(co.collocations(docs)) == sorted(brute_phrases(rows))


def test_collocations_of_nothing(spark, no_docs, odd_docs):
    assert co.collocations(no_docs).count() == 0
    assert listed(co.collocations(odd_docs)) == sorted(brute_phrases([(r["text"], r["lang"]) for r in odd_docs.collect()]))


def test_trie_counts_and_long_texts_are_cut_at_pieces():
    rng = random.Random(3)
    phrases = sorted({(rng.choice(["a", "b"]), b" ".join(bytes(rng.choices(range(97, 123 if rng.random() < 0.5 else 99), k=rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))) for _ in range(4000)})
    trie = co.build_trie(phrases)
    text = b" ".join(rng.choice(phrases)[1] for _ in range(3000)) + b"\n" + b", ".join(p for _, p in phrases[:500])
    words = [piece.split() for piece in re.split(rb"[,\n]", text)]
    seen = Counter(b" ".join(w[i:i + k]) for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang in ("a", "b"):
        got = trie.count(co.Pieces(text), lang)
        assert [int(x) for x in got] + [0] * (len(phrases) - len(got)) == [seen[p] if lang == o else 0 for o, p in phrases]
    assert b"".join(co.cut_long(text, 700)) == text
    used = trie.check[trie.check >= 0]
    assert len(trie.base) < 4 * len(used) + 4096


def test_filter_lets_all_keys_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    filt = co.make_filter(keys)
    h = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    assert filt.has(h).all() and filt.has(co.mixed(h)).mean() < 0.01
    assert not co.make_filter(keys.limit(0)).has(h).any()
