"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import clusters, encode, leaks, neighbours, quality
from weftline.plans.vectors import CURRENT_SQL
from weftline.session import table

#: Components of the vectors of the test tables.
DIM = 64

#: The vocabulary file of byte_bpe_50k; a parameter of the operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _clusters(spark, sf_dir):
    return clusters.clusters(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "lsh_model"), dim=DIM)


def p1_found(spark, sf_dir):
    return _clusters(spark, sf_dir).select("typeno", "featno", "cluster_featno")


def p1_described(spark, sf_dir):
    return clusters.described(_clusters(spark, sf_dir))


def p5_found(spark, sf_dir):
    return neighbours.similar_pairs(neighbours.nearest(table(spark, sf_dir, "vectors"), least=0.8, dim=DIM))


def p5_topk(spark, sf_dir):
    near = neighbours.nearest(table(spark, sf_dir, "vectors"), every=20, dim=DIM)
    return near.select("typeno", "featno", "other", "cosine", "rank")


def p6_ids(spark, sf_dir):
    return encode.encode_corpus(table(spark, sf_dir, "documents"), RANKS)


def p7_found(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p7_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return leaks.cleaned(docs, leaks.leaks(docs, table(spark, sf_dir, "benchmark")))


def _structure(spark, sf_dir):
    return quality.text_structure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark, sf_dir):
    return quality.not_prose(_structure(spark, sf_dir)).select("doc_id")


def p8_stats(spark, sf_dir):
    r = [F.round(c, 6).alias(c) for c in ("mean_word_len", "symbol_ratio", "line_punct", "common_share")]
    found = quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return found.select("doc_id", "n_words", *r)


def p8_profiles(spark, sf_dir):
    return _structure(spark, sf_dir).select("doc_id", F.round("outside", 6).alias("outside"), "profile", "language")


QUERIES = {f.__name__: f for f in (p1_found, p1_described, p5_found, p5_topk, p6_ids, p7_found, p7_clean, p8_found, p8_stats, p8_profiles)}

_NEAR = (
    CURRENT_SQL.strip()
    + """,
n AS (SELECT a.typeno, a.featno, b.featno AS other, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine FROM cur a JOIN cur b ON a.typeno = b.typeno AND a.featno <> b.featno),
r AS (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY cosine DESC, other) AS rank FROM n)
"""
)

# exact searches: the approximate operators give the same rows on the small tables
ORACLE = {
    "p1_found": _NEAR + "SELECT typeno, featno, least(featno, min(other)) AS cluster_featno FROM n WHERE cosine >= 0.8 GROUP BY typeno, featno",
    "p1_described": _NEAR
    + """,
m AS (SELECT typeno, featno, least(featno, min(other)) AS cluster_featno FROM n WHERE cosine >= 0.8 GROUP BY typeno, featno),
v AS (SELECT typeno, featno, cluster_featno, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS u FROM m JOIN cur USING (typeno, featno)),
d AS (SELECT typeno, cluster_featno, u, min(featno) AS featno FROM v GROUP BY 1, 2, 3),
s AS (SELECT a.typeno, a.cluster_featno, a.featno, a.u, round(avg(list_inner_product(a.u, b.u)), 6) AS mean FROM d a JOIN d b USING (typeno, cluster_featno) GROUP BY 1, 2, 3, 4),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typeno, cluster_featno ORDER BY mean DESC, featno) AS rn FROM s) WHERE rn = 1),
t AS (SELECT v.typeno, v.cluster_featno, v.featno, round(list_inner_product(v.u, h.u), 6) AS sim FROM v JOIN h USING (typeno, cluster_featno)),
k AS (SELECT *, count(*) OVER (PARTITION BY typeno, cluster_featno) AS size, row_number() OVER (PARTITION BY typeno, cluster_featno ORDER BY sim DESC, featno) AS rank FROM t)
SELECT typeno, cluster_featno, size, CAST(rank AS INT) AS rank, featno, sim FROM k WHERE rank <= 3""",
    "p5_found": _NEAR + "SELECT DISTINCT typeno, least(featno, other) AS featno_a, greatest(featno, other) AS featno_b FROM r WHERE rank <= 10 AND cosine >= 0.8",
    "p5_topk": _NEAR + "SELECT typeno, featno, other, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10 AND featno % 20 = 0",
    "p8_stats": r"""
WITH cw AS (SELECT DISTINCT lower(word) AS w FROM common_words WHERE word IS NOT NULL),
d AS (SELECT row_number() OVER () AS k, doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '') AS ls FROM documents),
c AS (SELECT k, count(*) AS n FROM (SELECT k, unnest(ws) AS w FROM d) u JOIN cw ON lower(u.w) = cw.w GROUP BY k)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS INT) AS n_words,
  round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) END, 6) AS mean_word_len,
  round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\p{L}\p{N} \t\n\r\f\v]', '', 'g')) / length(text) END, 6) AS symbol_ratio,
  round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: right(x, 1) IN ('.', '!', '?', '…', '。', '！', '？'))) / len(ls) END, 6) AS line_punct,
  round(CASE WHEN len(ws) > 0 THEN coalesce(c.n, 0) / len(ws) END, 6) AS common_share
FROM d LEFT JOIN c ON d.k = c.k""",
}
