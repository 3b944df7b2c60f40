"""The registered queries of these operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from boardsight.llm import (byte_quality, collocations, decontaminate, fingerprint, html_text, lang_id, line_dedup, mixing, near_dedup, periodic_runs, rnn_score,
                            secret_scan, toxicity)
from boardsight.llm.common import held_out, learnt, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a reader of tables under ``name``."""
    def register(plan):
        QUERIES[name] = lambda spark, folder: plan(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return plan
    return register


OP1_SQL = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM l),
u AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM o WHERE trim(line, ' ') <> '' GROUP BY line),
big AS (SELECT * FROM u WHERE n >= 20),
cand AS (
  SELECT a.line AS s, b.line AS r, a.n AS n, b.n AS m, a.first AS fa, b.first AS fb FROM big a JOIN big b ON b.n = a.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.line < b.line
  UNION SELECT a.line, b.line, a.n, b.n, a.first, b.first FROM big a JOIN big b ON b.n = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.line < b.line
  UNION SELECT a.line, b.line, a.n, b.n, a.first, b.first FROM big a JOIN big b ON b.n - 1 = a.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION SELECT a.line, b.line, a.n, b.n, a.first, b.first FROM big a JOIN big b ON b.n - 1 = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)),
near AS (SELECT *, list_max(list_filter(range(0, n + 1), lambda k: left(s, k) = left(r, k))) AS pre, list_max(list_filter(range(0, n + 1), lambda k: right(s, k) = right(r, k))) AS suf FROM cand),
gone AS (SELECT DISTINCT CASE WHEN fa < fb THEN r ELSE s END AS line FROM near WHERE pre + suf >= m - 1),
k AS (SELECT doc_id, pos, o.line, trim(o.line, ' ') = '' OR ((o.doc_id, o.pos) = u.first AND gone.line IS NULL) AS stays FROM o LEFT JOIN u ON o.line = u.line LEFT JOIN gone ON o.line = gone.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(g.text) AS n_chars, md5(g.text) AS text_md5 FROM documents d LEFT JOIN g USING (doc_id)"""


@query("op1_line_dedup", OP1_SQL)
def _(table):
    return line_dedup.dedup_lines(table("documents")).select("doc_id", "n_lines", "n_dropped", "n_chars", F.md5("text").alias("text_md5"))


@query("op2_fingerprint")
def _(table):
    return fingerprint.compare_with_next(table("documents"))


OP3_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM win),
spots AS (SELECT doc_id, i, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), widths WHERE i + width - 1 <= len(w)),
hit AS (SELECT doc_id, i, spots.width, item FROM spots JOIN win ON spots.width = win.width AND spots.t = win.t),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op3_decontaminate", OP3_SQL)
def _(table):
    return decontaminate.contamination(table("documents"), table("benchmark")).drop("h")


@query("op4_toxicity")
def _(table):
    docs = table("documents")
    model = toxicity.learn(docs, toxicity.learnt_labels(table("labels")))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_lm_score")
def _(table):
    docs = table("documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "text")
    return rnn_score.score(rows, docs.filter(learnt(F.col("doc_id"), 7)), keep=("doc_id", "held_out"))


@query("op6_html_text")
def _(table):
    pages = table("pages")
    return html_text.extract(pages, html_text.learn_weights(pages))


@query("op7_language_id")
def _(table):
    docs = table("documents")
    profiles = lang_id.learn_profiles(docs.filter(learnt(F.col("doc_id"), 4)))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    return lang_id.identify(rows, profiles, keep=("doc_id", "held_out"))


OP8_SQL = f"""WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
p AS (SELECT source, n, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () AS share, count(*) OVER () AS k, 1000 * (1 + count(*) OVER () // 1000) AS period FROM counts),
e AS (SELECT source, n, period, 1 + CAST(floor(share * (period - k)) AS BIGINT) AS least, share * (period - k) AS exact FROM p),
wt AS (SELECT source, n, period, least + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source NULLS FIRST) <= period - sum(least) OVER () THEN 1 ELSE 0 END AS q,
  row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM e),
sched(t, given, pick) AS (
  SELECT CAST(-1 AS BIGINT), (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM wt), CAST(0 AS BIGINT)
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, j: CASE WHEN j = c.i THEN g + 1 ELSE g END), c.i
  FROM sched, LATERAL (SELECT wt.i AS i FROM wt WHERE given[wt.i] < q AND (given[wt.i] * period) // q <= t + 1 ORDER BY ((given[wt.i] + 1) * period + q - 1) // q, wt.i LIMIT 1) c
  WHERE t + 1 < (SELECT max(period) FROM wt)),
turns AS (SELECT pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k, t AS place FROM sched WHERE t >= 0),
ends AS (SELECT q, period, (n // {mixing.BLOCK_ROWS}) // q * period + place AS d FROM wt JOIN turns ON turns.i = wt.i AND k = (n // {mixing.BLOCK_ROWS}) % q),
dry AS (SELECT coalesce(min(d) FILTER (WHERE 100 * gone > {mixing.ENDED_PERCENT} * period), max(d)) AS dry FROM (SELECT d, period, sum(q) OVER (ORDER BY d) AS gone FROM ends)),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || left(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 15) AS BIGINT), doc_id) - 1 AS r FROM documents),
placed AS (SELECT doc_id, ranked.source, r // {mixing.BLOCK_ROWS} AS mix_block, CAST(r % {mixing.BLOCK_ROWS} AS INT) AS mix_row, q, n, period, i FROM ranked JOIN wt ON ranked.source IS NOT DISTINCT FROM wt.source)
SELECT doc_id, source, mix_block, CAST(mix_block // q * period + place AS BIGINT) AS mix_slot, mix_row, mix_block // q * period + place < dry AND mix_block < n // {mixing.BLOCK_ROWS} AS in_mix
FROM placed JOIN turns ON turns.i = placed.i AND k = mix_block % q, dry"""


@query("op8_mix_sources", OP8_SQL)
def _(table):
    return mixing.mix(table("documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_row", "in_mix")


@query("op9_near_dedup")
def _(table):
    return near_dedup.near_duplicates(table("documents"), width=4, threshold=80)


@query("op10_secret_scan")
def _(table):
    return secret_scan.find_secrets(table("documents"))


OP11_SQL = r"""WITH ids AS (SELECT doc_id, text, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(unicode(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS raw FROM documents),
d AS (SELECT doc_id, xor(raw, CAST(4294967295 AS BIGINT)) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM ids),
e AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) END AS w FROM e),
five AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM t WHERE n > 4)),
pair AS (SELECT x.doc_id, x.i AS i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i),
isle AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) GROUP BY doc_id, q, g),
run AS (SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS s,
  arg_min({'s': start, 'n': length, 'q': period}, (-length, start, period)) AS b, list({'f': start + period, 't': start + length}) AS gone FROM run GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(gone, lambda x: i >= x.f AND i < x.t)) = 0), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (doc_id)"""


@query("op11_periodic_runs", OP11_SQL)
def _(table):
    docs = table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return periodic_runs.find_runs(periodic_runs.with_repeats(docs)).drop("text")


@query("op12_quality")
def _(table):
    docs = table("documents")
    model = byte_quality.learn(docs, byte_quality.learnt_labels(table("labels")))
    out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return byte_quality.score(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP13_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.k, c.phrase, a, w, j, array_to_string(w[:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < c.k),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, j, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
best AS (SELECT lang, k, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, (score, j)) AS b FROM s GROUP BY ALL),
longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.lang, best.phrase, a, b.l AS l, b.r AS r, b.score AS score FROM best LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN tot USING (lang) QUALIFY rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def _(table):
    return collocations.collocations(table("documents"))
