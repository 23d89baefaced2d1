"""One query per operator over its whole table with production parameters, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, class_lm, mixing, near_dedup, periodic, pii, quality, spelling, substring_dedup, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight, source_size * 3 AS cap FROM per),
r AS (SELECT *, cap / weight AS full_at FROM w),
f AS (
    SELECT *, ((SELECT sum(source_size) FROM r)::BIGINT - coalesce(sum(cap) OVER p, 0)::BIGINT) / ((SELECT sum(weight) FROM r)::BIGINT - coalesce(sum(weight) OVER p, 0)::BIGINT) AS level
    FROM r WINDOW p AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT k, source_size, CASE WHEN level >= full_at THEN cap::DOUBLE
        ELSE weight * (SELECT arg_min(level, (full_at, k)) FROM f WHERE level < full_at) END AS target FROM f),
n AS (
    SELECT s.*, t.source_size, t.target, coalesce(floor(target / source_size * 16777216)::BIGINT, 0) AS parts,
        ('0x' || substr(md5('17:' || s.k), 1, 6))::BIGINT AS off, row_number() OVER (PARTITION BY s.k ORDER BY size, doc_id) AS n
    FROM sized s JOIN t ON s.k = t.k)
SELECT doc_id, size, source_size, target, (size * ((n * parts + off) // 16777216 - ((n - 1) * parts + off) // 16777216))::BIGINT AS taken FROM n
"""


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark, sf_dir):
    planned = mixing.mixture_plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL_SQL = """
WITH rules(verdict, host, path) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + r"""),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
p AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut)
SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
"""


@query("op5_url_filter", URL_SQL)
def op5_url_filter(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS r(verdict, host, path)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op2_quality")
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS h FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.m)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m) AS component_id, r.doc_id = min(m) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op3_near_dedup", NEAR_SQL)
def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


TOP_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query("op8_top_k", TOP_SQL)
def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_class_lm")
def op9_class_lm(spark, sf_dir):
    return class_lm.score(table(spark, sf_dir, "documents"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("doc")


def crc32_sql(codes: str) -> str:
    """SQL for the unsigned crc32 of a list of bytes: eight shifts a byte."""
    bits = f"flatten(list_transform({codes}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"


def utf8_sql(text: str) -> str:
    """SQL for the UTF-8 bytes of a text of code points below 2048."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"


SPELLING_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, 'null') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
per AS (SELECT d, r, count(*) AS n FROM runs WHERE length(r) >= 7 GROUP BY d, r),
h AS (SELECT r, n, {crc} AS h FROM per),
v AS MATERIALIZED (
    SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
    SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
    UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word),
chain AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word) c ON c.word = f.word
""".replace("{crc}", crc32_sql(utf8_sql("d || ':' || r")))


@query("op11_spelling", SPELLING_SQL)
def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


RUNS_SQL = r"""
WITH given AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS d, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
hashed AS (SELECT doc_id, w, len(w)::BIGINT AS n, {crc} AS h FROM given),
tail AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS k FROM hashed),
made AS MATERIALIZED (SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) AS w FROM tail),
grams AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM made, unnest(range(n - 15)) AS t(i)),
equal AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
ranked AS (
    SELECT a.*, row_number() OVER (PARTITION BY doc_id ORDER BY (SELECT count(*) FROM runs b WHERE b.doc_id = a.doc_id AND b.length * a.period > a.length * b.period), start, period) AS place FROM runs a),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT doc_id, i, w[i + 1] AS word FROM made, unnest(range(n)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.start::BIGINT AS start, r.length::BIGINT AS length, r.period::BIGINT AS period, (1000 * r.length // r.period)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM made m LEFT JOIN listed l ON l.doc_id = m.doc_id LEFT JOIN ranked r ON r.doc_id = m.doc_id AND place = 1 LEFT JOIN kept k ON k.doc_id = m.doc_id
""".replace("{crc}", crc32_sql(utf8_sql("d")))


@query("op12_periodic", RUNS_SQL)
def op12_periodic(spark, sf_dir):
    return periodic.digests(table(spark, sf_dir, "documents"), altered=periodic.repeated_tail)


CHAT_EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
CHAT_SQL = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {extra}),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
counted AS (
    SELECT *, row_number() OVER o - 1 AS place, 4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
        length(regexp_replace(text, '{escape}', '\1\\\2\3', 'g')) AS size, length(regexp_replace(role, '{escape}', '\1\\\2\3', 'g')) AS role_size
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
placed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS start, place = 0 AND role = 'system' AS leads,
        size + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9 ELSE role_size + 23 END AS chars
    FROM counted),
roomy AS MATERIALIZED (SELECT p.*, greatest(384 - coalesce(h.tokens, 0), 1) AS room, CASE WHEN h.tokens IS NULL THEN 0 ELSE 1 END AS head FROM placed p LEFT JOIN placed h ON h.conv_id = p.conv_id AND h.leads),
cut AS (
    SELECT conv_id, place, start, tokens, chars, start AS window_start FROM roomy WHERE place = head
    UNION ALL
    SELECT r.conv_id, r.place, r.start, r.tokens, r.chars, CASE WHEN r.place % 512 <> 0 AND r.start + r.tokens - c.window_start <= r.room THEN c.window_start ELSE r.start END
    FROM cut c JOIN roomy r ON r.conv_id = c.conv_id AND r.place = c.place + 1),
windows AS (SELECT DISTINCT conv_id, window_start FROM cut),
chars AS (
    SELECT conv_id, chars FROM cut
    UNION ALL SELECT c.conv_id, c.chars FROM cut c JOIN windows w ON w.conv_id = c.conv_id AND w.window_start >= c.start + c.tokens AND w.window_start <= c.start + 128
    UNION ALL SELECT r.conv_id, r.chars FROM roomy r LEFT JOIN windows w ON w.conv_id = r.conv_id WHERE r.leads),
total AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM chars GROUP BY conv_id),
told AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt
    FROM placed GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM told t JOIN total USING (conv_id)
""".replace("{extra}", ", ".join(map(str, CHAT_EXTRA))).replace("{escape}", r"([\[<])(\\*)(" + chat.CONTROL + ")")


@query("op13_chat", CHAT_SQL)
def op13_chat(spark, sf_dir):
    extra = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, CHAT_EXTRA))} AS t(conv_id, turn, role, text)")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_windows(given))
