"""The registered queries of the operators, their production parameters and the SQL to hold them against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hilbert_ann, html_cut, importance, language_id, mixing, order_minhash, prefix_trie, quality_rules, re_pair, secret_scan, token_counts, warc
from .util import read

#: The vocabulary that the queries encode with.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The tokenizers library's file for the shards of ids, and the id that ends a document there.
LIBRARY_FILE, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs.select("doc_id", "text"), rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # the spans do not need the text any more, so it is not kept with them
    found = secret_scan.scan(docs, keep_text=False)
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.spans_text(F.col("secrets.base")), 256).alias("base_sha256"), secret_scan.spans_text(F.col("secrets.all")).alias("spans"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    docs = docs.withColumn("held_out", held_out)
    net = language_id.fit(docs.where("not held_out").select("text", "lang"))
    out = docs.select("doc_id", "held_out", language_id.predict_column(net, docs).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("text")
    return token_counts.length_histogram(token_counts.token_lengths(docs, VOCABULARY, public_tokenizers.PATTERN))


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hilbert_ann.neighbours(rows, rows.where(F.col("vec_id") % 50 == 0))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = byte_bpe.encoder(spark, VOCABULARY, public_tokenizers.PATTERN)
    out = read(spark, sf_dir, "documents").select("doc_id", byte_bpe.digest_column(shared).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op9_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    text = html_cut.extract_column(html_cut.fit(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(read(spark, sf_dir, "documents"))


def op11_re_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_pair.round_trip(read(spark, sf_dir, "documents"), LIBRARY_FILE, END_ID)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = prefix_trie.with_heads(prefix_trie.turn_arrays(read(spark, sf_dir, "conversations")), group=100, turns=6)
    return prefix_trie.trie(arrays).drop("turn")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules' operator counts before any rule is learned: the part of it that SQL can say."""
    out = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), quality_rules.DecisionList())
    return out.select("doc_id", *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the secret scan finds by fixed patterns: the part of it that SQL can say."""
    return op2_secret_scan(spark, sf_dir).drop("spans")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith(("op", "base_")) and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}


SQL: dict[str, str] = {
    # the water level in closed form; keys are digests of the ids, so the prefix sums are the engine's own
    "op3_source_mixing": r"""WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 0.0)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM p""",
    # base32 by fives of hex digits: 20 bits are four characters
    "op5_warc_normaliser": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p""",
    # the CRC of a feature byte by byte from its hex digits; only distinct features are hashed
    "op12_importance": r"""WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM w),
g AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT f, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM u, crcs),
s AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM g JOIN b USING (f) GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (all_t + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s, a),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM g JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
r AS (SELECT doc_id, coalesce(d.n, 0) AS n_features, CAST(coalesce(floor(total / d.n), 0) AS BIGINT) AS weight, len(w.words) >= 20 AS eligible,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM documents LEFT JOIN d ON d.id = doc_id LEFT JOIN w ON w.side = 'd' AND w.id = doc_id),
p AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY eligible ORDER BY weight + noise DESC, doc_id) AS place, (count(*) FILTER (eligible) OVER ()) * 25 // 100 AS k FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= k THEN place END AS rank FROM p""",
    # nodes by their turns, subtrees by joining every node with its ancestors
    "op13_prefix_trie": r"""WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, turns, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, strlen(CAST(c AS VARCHAR))), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), i + 1, 1)) AS BIGINT)), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])), 4294967295) % 6 AS h FROM o, crcs),
v AS (SELECT h.c, coalesce(b.turns, [])[1:h] || h.turns[h + 1:] AS turns FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
m AS (SELECT c, turns[1:d] AS p, d, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM v)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(p[-1].t) END AS saved FROM n LEFT JOIN k USING (p, d)),
s AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1, 2)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN s USING (p, d) LEFT JOIN n up ON up.d = own.d - 1 AND up.p = own.p[1:own.d - 1]""",
    "base_quality_counts": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
x AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)),
m AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed
FROM w LEFT JOIN c USING (r)""",
    # a match starts after all pieces up to it and all matches before it; runs of hex digits are maximal
    "base_secret_spans": r"""WITH p AS (SELECT * FROM (VALUES (0, 'assign', 12), (1, 'access', 18), (2, 'hex', 16)) v(rank, kind, least)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, rank, kind, least, CASE rank WHEN 0 THEN regexp_extract_all(t, ASSIGNED) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]{16,}') END AS m,
  CASE rank WHEN 0 THEN regexp_extract_all(t, ASSIGNED, 2) END AS v,
  CASE rank WHEN 0 THEN string_split_regex(t, ASSIGNED) WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]{16,}') END AS g FROM d, p),
s AS (SELECT r, rank, kind, least, coalesce(v[i], m[i]) AS tested, length(m[i]) AS n, coalesce(sum(length(g[i]) + CASE WHEN i > 1 THEN length(m[i - 1]) ELSE 0 END) OVER (PARTITION BY r, rank ORDER BY i), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
k AS (SELECT r, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM s WHERE length(tested) >= least GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN k USING (r)""".replace("ASSIGNED", f"$a${secret_scan.ASSIGN}$a$"),
}
