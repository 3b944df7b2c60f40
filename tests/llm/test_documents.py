"""Operators that compare documents: lines, fingerprints, benchmarks, mixtures, near duplicates; and the pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardsight.llm import decontaminate, fingerprint, line_dedup, mixing, near_dedup, plans, toxicity
from boardsight.llm.common import staged

SMALL = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def against_sql(spark, name, folder):
    import duckdb

    from tools.check_oracle import rows
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(plans.SQL[name])
    df = plans.QUERIES[name](spark, folder)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_decontaminate", "op8_mix_sources"])
def test_queries_equal_their_sql(spark, name):
    against_sql(spark, name, SMALL)


# ---- lines ------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    pre = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suf = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return pre + suf >= max(len(a), len(b)) - 1


def plain_lines(rows):
    first = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first[line] = min(first.get(line, (i, k)), (i, k))
    gone = {a for a in first for b in first if a != b and min(len(a), len(b)) >= line_dedup.LEAST_CHARS and first[b] < first[a] and one_edit(a, b)}
    return {i: t and "\n".join(line for k, line in enumerate(t.split("\n")) if not line.strip(" ") or first[line] == (i, k) and line not in gone) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé 𝒳") for _ in range(rng.randint(18, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice(["", "z", s[k] + "y"]) + s[k + 1:]
            lines.append(rng.choice([s, s, "", "  ", "short"]))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_a_hot_family_of_lines_stays_linear(spark):
    """Hundreds of lines one substitution apart: all but the earliest go."""
    rows = [(i, f"this is page number {chr(0x4E00 + i)} of the long book") for i in range(300)]
    got = line_dedup.dedup_lines(frame(spark, rows)).agg(F.sum("n_dropped"), F.max(F.when(F.col("n_dropped") == 0, F.col("doc_id")))).first()
    assert tuple(got) == (299, 0)


def test_lines_of_odd_rows(odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["places"] for r in got} == {"y"} and {r["part"] for r in got} == {3}
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[2][0]["text"] is None and by[2][0]["n_lines"] == 0 and by[3][0]["text"] == "" and by[4][0]["n_dropped"] == 0
    assert [r["n_dropped"] for r in by[5]] == [0, 0] and by[8][0]["text"] == "" and by[7][0]["text"] == "one"
    assert by[6][0]["n_dropped"] == 0 and by[2**60 + 1][0]["n_chars"] == 25
    assert line_dedup.dedup_lines(no_docs).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------

def test_fingerprints_are_of_multisets():
    a, b = "one two three\nfour five\none two three", "four five\none two three\none two three\n\n"
    assert (fingerprint.fingerprint(a) == fingerprint.fingerprint(b)).all()
    assert (fingerprint.fingerprint(a) != fingerprint.fingerprint("one two three\nfour five")).any()
    assert (fingerprint.delete(fingerprint.insert(fingerprint.fingerprint(a), "new one"), "new one") == fingerprint.fingerprint(a)).all()
    assert fingerprint.likeness(fingerprint.fingerprint(None), fingerprint.fingerprint("")) == 1.0
    assert fingerprint.likeness(fingerprint.fingerprint("x y z"), fingerprint.fingerprint("")) == 0.0


def test_likeness_estimates_common_shingles():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    a = " ".join(words[:800])
    for share in (0.25, 0.5, 0.75):
        b = " ".join(words[:int(800 * share)] + words[800:800 + 800 - int(800 * share)][:400] + ["q"] * 0)
        common = int(800 * share)
        want = 2 * common / (800 + len(b.split()))
        assert abs(fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) - want) < 0.15


def check_fingerprints(rows, got):
    order = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in order]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(order):
        t, following, r = texts[k], texts[(k + 1) % len(texts)], by[i]
        new = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        mine, theirs, its = map(fingerprint.fingerprint, (t, new, following))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert np.array_equal(np.frombuffer(base64.b64decode(r["fingerprint"]), "<u4"), mine)
        assert np.array_equal(np.frombuffer(base64.b64decode(r["edited_fingerprint"]), "<u4"), theirs)
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(mine, theirs), fingerprint.likeness(mine, its))


def test_fingerprint_query_equals_plain_code(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = plans.QUERIES["op2_fingerprint"](spark, SMALL).collect()
    check_fingerprints(rows, got)
    assert np.mean([r["near_edited"] for r in got]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in got])


def test_fingerprints_of_few_and_far_ids(spark):
    for rows in ([], [(7, "only one\nof them")], [(-5, None), (2**62, "far\naway 𝒳"), (2**62 + 1, "next to it")]):
        check_fingerprints(rows, fingerprint.compare_with_next(frame(spark, rows)).collect())


def test_fingerprints_of_odd_rows(odd_docs):
    got = fingerprint.compare_with_next(odd_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    assert [r["near_next"] for r in got if r["doc_id"] == 7] == [1.0]  # eight has the same text


# ---- benchmarks -------------------------------------------------------------------------------

def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    items = frame(spark, [(1, "one"), (2, "Zeile mit"), (3, "no id but"), (4, None), (5, "--- "), (None, "far id has its"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")],
                  "item_id long, text string")
    got = decontaminate.contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["items_sha256"]) for r in got}
    assert found[(7, 1)] == (1, 1, sha("1")) and found[(1, 12)] == (11, 1, sha("6")) and found[(6, 12)] == (11, 1, sha("6"))
    assert found[(None, 7)] == (3, 1, sha("3")) and found[(2**60 + 1, 7)] == (4, 0, sha("")) and found[(2, 0)] == (0, 0, sha(""))
    assert sum(r["contaminated"] for r in got if r["doc_id"] == 9) == 2
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd_docs, items.limit(0)).collect())
    assert decontaminate.contamination(no_docs, items).count() == 0


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))) for i in range(30)]
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    for i, t in docs:
        w, places, ids = t.split(), set(), set()
        for k, item in items:
            x = item.split()
            n = min(10, len(x))
            windows = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    places |= set(range(j, j + n))
                    ids.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(places), len(ids))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


# ---- mixtures ---------------------------------------------------------------------------------

def test_every_prefix_is_within_a_block(spark):
    weights = spark.createDataFrame([("a", 500, 1000), ("b", 301, 1000), ("c", 150, 1000), (None, 48, 1000), ("e", 1, 1000)], "source string, q int, period int")
    turns = {r["at"]: r["source"] for r in mixing.one_period(weights).collect()}
    assert sorted(turns) == list(range(1000))
    given, q = Counter(), {r["source"]: r["q"] for r in weights.collect()}
    for t in range(1000):
        given[turns[t]] += 1
        assert all(abs(given[s] - q[s] * (t + 1) / 1000) < 1 for s in q)
    assert given == q


def test_mix_holds_every_row_once_in_even_blocks(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, None, None)] * 3
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, stretch_rows=100).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in got))) == sorted(map(repr, rows))
    slots = defaultdict(list)
    for r in got:
        slots[r["mix_slot"]].append(r)
    assert all(len({(r["source"], r["mix_block"]) for r in s}) == 1 and sorted(r["mix_row"] for r in s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == mixing.BLOCK_ROWS for slot, s in slots.items() if s[0]["in_mix"])
    assert [(r["doc_id"], r["mix_slot"], r["mix_row"]) for r in sorted(got, key=repr)] == [(r["doc_id"], r["mix_slot"], r["mix_row"]) for r in sorted(mixing.mix(docs, stretch_rows=5000).collect(), key=repr)]


def test_a_short_source_ends_alone(spark):
    rows = [(i, f"t{i}", "a" if i % 2 else "b") for i in range(8000)]
    for more in ([], [(-1, "x", "c"), (-2, "y", "c"), (None, None, None)]):
        got = mixing.mix(frame(spark, rows + more, "doc_id long, text string, source string")).filter("source IN ('a', 'b')").agg(F.count_if("in_mix")).first()[0]
        assert got >= 7900


def test_rows_of_one_id_are_spread(spark):
    docs = frame(spark, [(None, f"t{i}", "a") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, stretch_rows=50).collect()
    assert sorted((r["mix_slot"], r["mix_row"]) for r in got) == [(i // 16, i % 16) for i in range(1000)]
    by_place = [r["text"] for r in sorted(got, key=lambda r: (r["mix_slot"], r["mix_row"]))]
    assert by_place == sorted(by_place, key=lambda t: hashlib.md5(f"7:null:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest())


def test_target_weights_fill_the_period(spark):
    for n in (1, 5, 1200):
        got = mixing.target_weights(spark.range(n).select(F.col("id").cast("string").alias("source"), (F.col("id") * F.col("id") + 1).alias("n"))).collect()
        assert sum(r["q"] for r in got) == got[0]["period"] and min(r["q"] for r in got) >= 1


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs.withColumn("mix_slot", F.lit("old")))
    assert got.count() == odd_docs.count() and dict(got.dtypes)["mix_slot"] == "bigint"
    assert mixing.mix(no_docs).count() == 0


# ---- near duplicates --------------------------------------------------------------------------

def plain_groups(rows, width, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(spark):
    """A chain of texts that drift, a crowd around one text at all distances, copies, and short texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**5)}"
    rows, text = [], [word() for _ in range(120)]
    for _ in range(40):
        text = list(text)
        text[rng.randrange(len(text))] = word()
        rows.append(" ".join(text))
    centre = [word() for _ in range(150)]
    for _ in range(120):
        t = list(centre)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += [rows[0]] * 5 + ["a b", "A  b", "a", "", None, "a b c d", "a b c d e"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for width in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows), width=width).collect()}
        assert got == plain_groups(rows, width, 80)


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        s = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(2 * 2000 * share / (1 + share))
        a, b = np.unique(s[:2000]), np.unique(np.concatenate([s[:both], s[2000:4000 - both]]))
        row = spark.createDataFrame([(near_dedup.sketch(a)[1].tolist(), near_dedup.sketch(b)[1].tolist())], "x array<long>, y array<long>")
        assert abs(row.select(near_dedup.estimate("x", "y")).first()[0] - share) < 0.16


def test_components_of_any_shape(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["id"]: r["least"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == least for x, least in parent.items()) and all(parent[x] == least for x, least in got.items())


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [(r["component_id"], r["kept"]) for r in by[5]] == [(5, True)] * 2 and (by[6][0]["component_id"], by[6][0]["kept"]) == (1, False)
    assert by[8][0]["component_id"] == 7 and by[2][0]["n_shingles"] == 0 and by[2][0]["kept"] and [r["kept"] for r in by[None]] == [True, True]
    assert near_dedup.near_duplicates(no_docs).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------

def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.terms)
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = staged(stage(spark, docs, SMALL), "test")
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "mix_sources":
            assert docs.columns == columns
        texts = [(r["doc_id"], r["text"]) for r in before]
        if name == "toxicity":
            kept = {i for i, t in texts if 1 / (1 + np.exp(-np.clip(model.weights @ toxicity.features(t, lexicon), -30, 30))) < corpus_pipeline.TOXIC}
            assert after.keys() == kept
        elif name == "line_dedup":
            assert {i: r["text"] for i, r in after.items()} == plain_lines(texts) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_dedup":
            assert after.keys() == {i for i, (_, least) in plain_groups(texts, 5, 80).items() if i == least}
        elif name == "decontaminate":
            hits = {r["doc_id"] for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).filter("contaminated").collect()}
            assert after.keys() == {i for i, _ in texts} - hits and hits
        else:
            assert after.keys() == {i for i, _ in texts} and {*docs.columns} - {*columns} == {"mix_block", "mix_slot", "mix_row", "in_mix"}


def test_pipeline_of_no_rows_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SMALL), "test")
        assert {"doc_id", "text", "mix_slot", "score", "places"} <= set(docs.columns)


@pytest.mark.parametrize("n", [40_000, 65_536, 70_000])
def test_likeness_of_long_repetitive_texts(n):
    text = "a b c " * n
    more = text + "and three more"
    assert fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(more)) > 0.999
    new, _ = fingerprint.edited(text, "x y z " * n)
    assert 0.7 < fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(new)) < 0.99
