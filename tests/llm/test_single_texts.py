"""Operators that read one text at a time: HTML, secrets, languages, toxicity, language model."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardsight.llm import html_text, lang_id, plans, rnn_score, secret_scan, toxicity

SMALL = "/root/testdata/sf0.001"


# ---- HTML -------------------------------------------------------------------------------------

def brute_region(scores):
    best, span = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best + 1e-9:
                best, span = sum(scores[i:j]), (i, j)
    return best, span


def test_region_has_the_greatest_sum():
    rng = random.Random(3)
    for _ in range(200):
        found = [("text", "w " * rng.randint(1, 5)) if rng.random() < 0.5 else (rng.choice(["p", "x"]), "") for _ in range(rng.randint(0, 14))]
        weights = {"word": 1.0, "p": -0.5, "x": -4.0}
        scores = [len(t.split()) if k == "text" else weights[k] for k, t in found]
        start, end = html_text.region(found, weights)
        assert math.isclose(sum(scores[start:end]), brute_region(scores)[0], abs_tol=1e-6)


@pytest.mark.parametrize("page, text", [
    ("<nav>menu one</nav><article><h1>T&amp;x</h1><p>foo <b>b</b>ar<div class='ad'>buy now</div> more text<p class=promo>promo<p>last one<form>q</form></article>"
     "<section id='comments'><article class=comment>nice post</article></section><footer>f</footer>", "T&x foo bar more text last one"),
    ("<article><p>a<script>if (a<b) x('</p>')</script>b</p><style>p{}</style><!-- no --><p>c&nbsp;&lt;d&gt;</article>", "ab c <d>"),
    ("<body><nav>never closed<article><p>real words here</p></article>", "real words here"),
    ("<article><header>by line</header><p>kept</p><aside>side</aside><p>also</p></article>", "kept also"),
    ("<main><p class=x'>Hello world this is a text.</p><p>it's fine and goes on</p></main>", "Hello world this is a text. it's fine and goes on"),
    ("<article><p title=\"a > b\" '>one <a href = 'x>y'>two</a> <i \"=>three</i></p><p class=\"never closed>four</article>", "one two three four"),
    ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("plain words", "plain words"), ("<article><p>unclosed", "unclosed"),
])
def test_main_text(page, text):
    weights = {"word": 1.0, "tag": -1.0, "p": -0.01, "/p": -0.01} | dict.fromkeys(("article", "/article"), html_text.BORDER)
    assert html_text.main_text(page, weights) == text


@pytest.mark.parametrize("page, text", [
    ('<p>top</p><article class="post comments-open"><h1>Title</h1><p>the text is here</p></article>', "Title the text is here"),
    ('<div class="content has-sidebar"><ul><li>x</ul><article><p>the text is here</p></article></div>', "the text is here"),
    ('<main class="page with-sidebar"><p>the text is here</p></main><div class=footer>f</div>', "the text is here"),
    ('<p>top</p><div class="content has-sidebar"><p>the text is here and long enough to be most</p></div>', "the text is here and long enough to be most"),
    ('<article><p>old <a href="/hidden-history">link</a> and <a title="the hidden life">life</a></p><p title=\'so hidden now\'>more</p><p data-id="comments">last</p></article>', "old link and life more last"),
    ("<article><p>text of the page</p><div hidden>not seen</div><p id=comments>no</p></article><div id=comments><p>far more words in here than the article itself ever had</p></div>", "text of the page"),
])
def test_names_take_out_no_article(page, text):
    weights = {"word": 1.0, "tag": -1.0, "p": -0.01, "/p": -0.01, "div": -3.0} | dict.fromkeys(html_text.BORDERS, html_text.BORDER)
    assert html_text.main_text(page, weights) == text


def test_html_query_equals_the_article(spark):
    import html
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = plans.QUERIES["op6_html_text"](spark, SMALL).collect()
    assert len(got) == len(pages) and got
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_html_of_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "", "t"), (2, "v", "<p>" * 2000 + "word " * 3000, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, html_text.learn_weights(pages)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 14999]
    assert html_text.extract(pages.limit(0), html_text.learn_weights(pages.limit(0))).count() == 0


# ---- secrets ----------------------------------------------------------------------------------

def slow_entropy_windows(s, width, bits):
    hot = []
    for i in range(len(s) - width + 1):
        w = s[i:i + width]
        if -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w)) >= bits - 1e-9:
            hot.append((i, i + width))
    out = []
    for a, b in hot:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_entropy_windows_equal_recounting():
    rng = random.Random(5)
    for _ in range(100):
        s = "".join(rng.choice("abcdef0123456789" if rng.random() < 0.7 else "aab") for _ in range(rng.randint(0, 90)))
        for bits in (2.5, 3.17, 3.4):
            assert secret_scan.entropy_windows(s, 20, bits) == slow_entropy_windows(s, 20, bits)


def slow_base(text):
    """The contract, read plainly."""
    out = []
    for kind, (pattern, flags, group, least) in enumerate([
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), (r"AKIA[A-Z0-9]+", 0, 0, 16), (r"[0-9a-f]+", 0, 0, 32)]):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_equal_the_contract(spark):
    rng = random.Random(7)
    parts = ["token", "TOKEN", "=", ": ", '"', "secret", "apikey", "api_key", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "x.y-z_1", " ", "é", "ſecret", "toKen", "deadbeef", "\n", "a1b2c3d4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == slow_base(text)
    for r, t in [(r, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]:
        assert secret_scan.base_spans(t or "") == slow_base(t or "")


def test_allow_list_and_classes():
    noise = "q7Zt" + "kP4xW9vB2nL8sD5fG1hJ6mR3cT0yU"
    assert [k for _, k, _ in secret_scan.entropy_spans(f"see {noise} there")] == [3]
    assert secret_scan.entropy_spans(f"example{noise}") == []
    assert secret_scan.entropy_spans("thequickbrownfoxjumpsoverthelazydog") == []
    assert secret_scan.entropy_spans("123e4567-e89b-42d3-a456-426614174000") == []


def test_allow_list_hides_only_what_it_names():
    key = "q7ZtkP4xW9vB2nL8sD5fG1hJ6mR3cT0yU"
    for before in ("hooks/example-team/T0/", "123e4567-e89b-42d3-a456-426614174000-", "123e4567-e89b-42d3-a456-426614174000"):
        (start, _, end), = secret_scan.entropy_spans(before + key)
        assert end == len(before + key) and start <= len(before) and "example" not in (before + key)[start:end]
        assert not before.startswith("1") or start >= 36
    rng = random.Random(11)
    run = "".join(rng.choice("ABCDEFGHabcdefghijklmnopqrstuvwyz0123456789+/") for _ in range(2000))
    assert secret_scan.entropy_spans(run[:1000] + "bXxxXb" + run[1000:]) and secret_scan.entropy_spans("xxxx-xxxx-xxxx-xxxx-1234") == []


def test_secrets_of_odd_rows(odd_docs, no_docs):
    got = secret_scan.find_secrets(odd_docs, keep=("doc_id", "score")).collect()
    assert len(got) == odd_docs.count() and {r["score"] for r in got} == {0.5}
    assert 2**60 + 1 in {r["doc_id"] for r in got} and all(r["spans"] is not None for r in got)
    assert secret_scan.find_secrets(no_docs).count() == 0


# ---- languages --------------------------------------------------------------------------------

def test_trigrams_in_pieces(monkeypatch):
    text = "Some words, größere Wörter -- and more!! of them 123 été " * 40
    want = lang_id.trigrams(text)
    monkeypatch.setattr(lang_id, "PIECE", 97)
    got = lang_id.trigrams(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_bundle_is_the_sum_of_bound_letters():
    letters, at = lang_id.letter_vectors(), lang_id.symbol_of()
    text = "the cat"
    s = [0, *[int(at[ord(c)]) for c in text], 0]
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert (lang_id.bundle(*lang_id.trigrams(text)) == want).all()
    assert np.allclose(lang_id.bundles([lang_id.trigrams(text)])[0], want)


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    got = plans.QUERIES["op7_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right / n > 0.97


def test_profiles_are_the_same_in_one_task_or_many(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 40).cast("string")))
    names, one = lang_id.learn_profiles(docs.coalesce(1))
    again, many = lang_id.learn_profiles(docs.repartition(7))
    assert len(names) > 64 and names == again and np.array_equal(one, many)


def test_languages_of_odd_rows(odd_docs, no_docs):
    profiles = lang_id.learn_profiles(odd_docs)
    assert profiles[0] == ["de", "en", "fr"]
    got = lang_id.identify(odd_docs, profiles).collect()
    assert len(got) == odd_docs.count() and sum(r["lang_pred"] == "und" for r in got) == 4
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = lang_id.learn_profiles(no_docs)
    assert {r["lang_pred"] for r in lang_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert lang_id.identify(no_docs, profiles).count() == 0


# ---- toxicity ---------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(60))
    lexicon = toxicity.Lexicon([(t, False, 1.0 + i) for i, t in enumerate(terms)])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        near = max((x for t, x in lexicon.words.items() if distance(t, w) <= 1), default=0)
        assert lexicon.match(w) == ((True, lexicon.words[w]) if w in lexicon.words else (False, near) if near else None)


def test_quotation_counts_less_than_abuse():
    you, said = "you are such an idiot and always were", 'they said the word "idiot" was in the report'
    assert toxicity.abuse(you.split(), 4) > 0.8 > 0.3 > toxicity.abuse(said.split(), 4)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = plans.QUERIES["op4_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    hit, toxic, said = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic"), F.sum("predicted")).first()
    assert hit / toxic > 0.9 and hit / said > 0.9


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, None), (5, 1, 1), (None, 1, 1), (7, None, 0), (8, 0, 1), (8, 1, 1)], "doc_id long, toxic int, text string")
    model = toxicity.learn(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got) and {r["h"] for r in got} == {"x"}
    empty = toxicity.learn(odd_docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.score(odd_docs, empty).collect()) < 0.01
    assert toxicity.score(no_docs, model).count() == 0


# ---- language model ---------------------------------------------------------------------------

def network(seed=0):
    rng = np.random.default_rng(seed)
    return rnn_score.Network(np.maximum(1, rng.integers(0, 5000, rnn_score.UNITS)).astype(float)), rng


def test_units_have_a_distribution():
    net, _ = network()
    h = np.random.default_rng(1).normal(size=(1, rnn_score.HIDDEN)).astype(np.float32)
    logs, _ = net.log_probability(np.repeat(h, rnn_score.UNITS, axis=0), np.arange(rnn_score.UNITS))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_gradients():
    net, rng = network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [np.append(rng.integers(0, rnn_score.UNITS, rng.integers(0, 40)).astype(np.int16), np.int16(0)) for _ in range(7)]
    inputs, starts, targets, _ = next(rnn_score.windows(texts, 4, 200))
    grads, _ = net.train_window(inputs, starts, targets.astype(np.int64), np.zeros((inputs.shape[1], rnn_score.HIDDEN)))

    def goal():
        states = net.read(inputs, starts, np.zeros((inputs.shape[1], rnn_score.HIDDEN)))
        live = targets >= 0
        return net.log_probability(states[live].astype(np.float64), targets[live].astype(np.int64))[0].mean()

    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = net.p[k][at], 1e-2
        net.p[k][at] = old + step
        up = goal()
        net.p[k][at] = old - step
        down = goal()
        net.p[k][at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 * max(1e-3, abs(g[at])) + 1e-6, k


def test_state_goes_through_windows_and_lanes(monkeypatch):
    net, rng = network(2)
    texts = [np.append(rng.integers(0, rnn_score.UNITS, n).astype(np.int16), np.int16(0)) for n in (0, 1, 5, 300, 77, 31, 32, 33)]
    whole = rnn_score.log_scores(net, texts)
    assert np.allclose(whole, [rnn_score.log_scores(net, [t])[0] for t in texts], atol=1e-3)
    monkeypatch.setattr(rnn_score, "SCORE_STEPS", 5)
    assert np.allclose(whole, rnn_score.log_scores(net, texts), atol=1e-3)


def test_language_model_against_counts(spark, monkeypatch):
    """Counts and the base score by plain counting, with most words looked up by the join; the model beats the base."""
    import zlib
    from collections import Counter
    monkeypatch.setattr(rnn_score, "FREQUENT", 400)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = plans.QUERIES["op5_lm_score"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


@pytest.mark.parametrize("shard", [300, 10**9])
def test_every_training_text_shapes_the_weights(spark, monkeypatch, shard):
    """In many shards or one, each text is read in one round after the first."""
    monkeypatch.setattr(rnn_score, "SHARD", shard)
    docs = spark.range(0, 400, 1, 5).select(F.when(F.col("id") % 9 > 0, F.expr("array_join(transform(sequence(0, id % 7), x -> concat('w', x)), ' ')")).alias("text"))
    vocab, _ = rnn_score.vocabulary(docs)
    weights, read = rnn_score.fit(docs, vocab)
    assert 0 < read[0] <= vocab.tokens and sum(read[1:]) == vocab.tokens and np.isfinite(weights).all()


def test_language_model_of_odd_rows(odd_docs, no_docs):
    got = rnn_score.score(odd_docs, odd_docs.limit(0)).collect()
    assert len(got) == odd_docs.count() and {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert rnn_score.score(no_docs, odd_docs).count() == 0
