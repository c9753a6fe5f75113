"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (conversation_repair, debruijn, decontaminate, html_extract, metric_join, ngram_lm, packing, prefix_trie,
               quality, secret_scan, simhash, suffix_dedup, token_scan)
from .shared import read_table
from .tokens import default_byte_encoder, default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
END_OF_TEXT = 50_256  # the id that the byte-level vocabulary leaves free


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a missing doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return secret_scan.digests(secret_scan.find_secrets(docs))


@query
def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_join(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    trees = quality.train(docs, labels, usable=remainder(5) != 0)
    return quality.score(docs.withColumn("held_out", remainder(5) == 0), trees).select(
        "doc_id", "held_out", F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_scan.token_counts(docs, default_byte_encoder(), END_OF_TEXT)


@query
def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(
        read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


@query
def op2_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                 read_table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", remainder(10) == 0)
    model = ngram_lm.train(docs.where("not held_out"))
    return model.score(docs, ("held_out",)).withColumn("train_tokens", F.lit(model.vocabulary.tokens).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# Every pair of equal label, in double precision; components by walking links from each vector.
ORACLES["op5_metric_join"] = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_aggregate([abs(x) for x in embedding], 'max') > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e
JOIN (SELECT a, min(b) AS c FROM walk GROUP BY a) ON a = e.vec_id
LEFT JOIN (SELECT a AS k, count(*) AS n FROM l GROUP BY a) ON k = e.vec_id"""

ORACLES["op10_debruijn"] = """WITH d AS (SELECT doc_id,
  [x for x in regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+') if x <> ''] AS ws FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS h FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)"""

# Every window of every text as hexadecimal digits, cut into overlapping stretches so that substrings stay short.
ORACLES["op11_suffix_array"] = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, j, x[1 + j * 1024:j * 1024 + 1422] AS x FROM (SELECT r, x, unnest(range((len(x) + 1023) // 1024)) AS j FROM d)),
w AS (SELECT r, j * 512 + i AS i, hash(x[1 + 2 * i:2 * i + 400]) AS h FROM (
  SELECT r, j, x, unnest(range((len(x) - 400) // 2 + 1)) AS i FROM c WHERE len(x) >= 400)),
again AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (
  SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS g FROM (
    SELECT r, i, (i - lag(i, 1, i - 201) OVER (PARTITION BY r ORDER BY i) > 200)::INT AS n FROM again)) GROUP BY r, g),
gaps AS (SELECT r, string_agg(x[1 + 2 * s:2 * e], '' ORDER BY s) AS kept FROM (
  SELECT d.r, x, s, e FROM d JOIN (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS s, s AS e FROM runs
    UNION ALL SELECT r, max(e), 1::BIGINT << 40 FROM runs GROUP BY r) USING (r)) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN gaps USING (r) LEFT JOIN (SELECT r, count(*) AS n, sum(e - s) AS gone FROM runs GROUP BY r) q USING (r)"""

_CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(s, '')]),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM (SELECT DISTINCT {0} AS s FROM conversations), crc_table)"""

# The cheapest edits of a conversation from its last row to its first, for each role that may stand before them.
ORACLES["op12_path_ranking"] = "WITH RECURSIVE " + _CRC.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))") + """,
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, crc % 20 AS code FROM conversations
  JOIN crc ON s = concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))),
r1 AS (SELECT *, CASE WHEN code = 4 THEN 'user' ELSE role0 END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN
  regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM r0 WHERE code <> 0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, sha256(text0), copy) AS i, role[1] AS c,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM r2),
r4 AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN again THEN 'd' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM r3),
r5 AS (SELECT *, (f = 't')::INT + CASE WHEN f IN ('b', 'd') THEN 1000000000 ELSE 0 END AS stay FROM r4),
total AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
  count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r5 GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, {c: 0, a: '', o: ''} AS s0, {c: 4, a: 'II', o: chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
  {c: 2, a: 'I', o: chr(10) || 'assistant:'} AS s2, {c: 0, a: '', o: ''} AS s3 FROM total
UNION ALL
SELECT conv_id, i, least(b0, u), least(b1, u), b2, least(b3, u) FROM (
  SELECT *, {c: b2.c + 2, a: 'I' || b2.a, o: chr(10) || 'user:' || b2.o} AS u FROM (
    SELECT conv_id, i, b0, b1, b3, least(d2, {c: b3.c + 2, a: 'I' || b3.a, o: chr(10) || 'assistant:' || b3.o}) AS b2 FROM (
      SELECT conv_id, i, least({c: s0.c + 3, a: 'D' || s0.a, o: s0.o}, k, v, first) AS b0, least({c: s1.c + 3, a: 'D' || s1.a, o: s1.o}, k, v) AS b1,
        least({c: s2.c + 3, a: 'D' || s2.a, o: s2.o},
          {c: s3.c + stay + CASE WHEN c = 'a' THEN 0 ELSE 1000000000 END, a: 'K' || s3.a, o: chr(10) || role || ':' || text || s3.o},
          {c: s3.c + stay + 2, a: 'R' || s3.a, o: chr(10) || 'assistant:' || text || s3.o}) AS d2,
        least({c: s3.c + 3, a: 'D' || s3.a, o: s3.o}, k, v) AS b3 FROM (
        SELECT walk.conv_id, walk.i - 1 AS i, s0, s1, s2, s3, role, text, stay, r5.c,
          {c: s2.c + stay + CASE WHEN r5.c = 'u' THEN 0 ELSE 1000000000 END, a: 'K' || s2.a, o: chr(10) || role || ':' || text || s2.o} AS k,
          {c: s2.c + stay + 2, a: 'R' || s2.a, o: chr(10) || 'user:' || text || s2.o} AS v,
          {c: s1.c + stay + CASE WHEN r5.c = 's' THEN 0 ELSE 1000000000 END, a: 'K' || s1.a, o: chr(10) || role || ':' || text || s1.o} AS first
        FROM walk JOIN r5 ON walk.conv_id IS NOT DISTINCT FROM r5.conv_id AND walk.i = r5.i)))))
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(s0.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN total ON k.conv_id IS NOT DISTINCT FROM total.conv_id
LEFT JOIN (SELECT * FROM walk WHERE i = 0) w ON k.conv_id IS NOT DISTINCT FROM w.conv_id"""

# Nodes are lists of turns; sums over subtrees add every node to all of its first parts.
ORACLES["op13_prefix_trie"] = "WITH " + _CRC.format("conv_id::VARCHAR") + """,
own AS (SELECT conv_id, list({r: coalesce(role, ''), t: coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT own.conv_id AS c, list_concat(coalesce(b.l, [])[1:crc % 9], own.l[crc % 9 + 1:]) AS l FROM own
  JOIN crc ON s = own.conv_id::VARCHAR LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 5),
parts AS (SELECT c, l, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM built)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256
  FROM parts GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
weighed AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN (node.n - 1) * strlen(node.k[-1].t) ELSE 0 END AS saved
  FROM node LEFT JOIN kids ON node.k = kids.k),
below AS (SELECT k[1:j] AS k, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (
  SELECT *, unnest(range(d + 1)) AS j FROM weighed) GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM weighed w JOIN below ON w.k = below.k LEFT JOIN node p ON w.d > 0 AND p.k = w.k[1:w.d - 1]"""
