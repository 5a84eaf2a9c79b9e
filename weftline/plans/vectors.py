"""Queries over vectors and their hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import bits as B
from weftline.functions import sql as sqlnames
from weftline.functions import vec as V
from weftline.operators import lshmodel, search
from weftline.operators.upsert import current_vectors
from weftline.session import Cut, table

DIM, BITS = 64, 416
#: Parameters of the searches: results, least similarity and recall factor.
K, MIN_SIM, FACTOR = 10, 0.8, 0.3


def _id():
    return F.shiftleft(F.col("typeno").cast("bigint"), 32) + F.col("featno")


def hashed(spark, sf_dir):
    """Current vectors with their hashes, written once, since searches read them twice."""
    model = lshmodel.from_frame(table(spark, sf_dir, "lsh_model"))
    df = lshmodel.hash_vectors(current_vectors(table(spark, sf_dir, "vectors"), DIM), model)
    return Cut(spark, "hash").keep(df)


def _asked(df):
    """The stated query set: features whose number is divisible by 20, against all rows."""
    return df.where(F.col("featno") % 20 == 0).withColumn("query_id", _id())


def _named(found, *cols):
    other = F.col("featno").alias("other")
    return found.select((F.col("query_id") % (1 << 32)).cast("int").alias("featno"), "typeno", other, *cols)


def current_vector_keys(spark, sf_dir):
    return current_vectors(table(spark, sf_dir, "vectors"), DIM).select("typeno", "featno", F.round(V.norm("vec"), 6).alias("norm"))


def normalized_vectors(spark, sf_dir):
    df = current_vectors(table(spark, sf_dir, "vectors"), DIM).withColumn("u", V.normalize("vec"))
    return df.select("typeno", "featno", F.round(F.get("u", F.lit(0)).cast("double"), 5).alias("first"), F.round(V.dot("u", "u"), 5).alias("length"))


def simhash_words(spark, sf_dir):
    return hashed(spark, sf_dir).select("typeno", "featno", B.to_text("lsh", BITS).alias("bits"))


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "vectors").where(F.size("lsh") == B.n_words(BITS)).select("seq", "typeno", "featno", "lsh").distinct()


def stored_hash_bits(spark, sf_dir):
    """H7-H10, H13 on the stored hashes."""
    return _stored(spark, sf_dir).select(
        "seq", B.count("lsh").alias("n_set"), B.get_bit("lsh", 100, BITS).alias("bit100"), B.next_free("lsh", 100, BITS).alias("free100"), F.size(B.indices("lsh", BITS, 0)).alias("n_clear"), B.to_text("lsh", BITS).alias("bits")
    )


def stored_hash_algebra(spark, sf_dir):
    """Each stored hash against its own words in reverse."""
    df = _stored(spark, sf_dir).withColumn("other", F.reverse("lsh"))
    return df.select(
        "seq",
        B.to_hex(B.bit_and("lsh", "other")).alias("hex_and"),
        B.to_hex(B.bit_or("lsh", "other")).alias("hex_or"),
        B.to_hex(B.bit_xor("lsh", "other")).alias("hex_xor"),
        B.to_hex(B.bit_not("lsh", BITS)).alias("hex_not"),
        B.distance("lsh", "other").alias("dist"),
        B.near("lsh", "other", 200).alias("near200"),
        B.less("lsh", "other").alias("less"),
        B.count(B.bit_or("lsh", B.constant(BITS, 1))).alias("n_ones"),
    )


def stale_hashes(spark, sf_dir):
    """Stored hashes of current vectors that differ from the vector's own hash."""
    own = hashed(spark, sf_dir).select("typeno", "featno", F.col("lsh").alias("own"))
    from weftline.operators.upsert import latest

    stored = latest(table(spark, sf_dir, "vectors").select("typeno", "featno", "seq", "lsh"), ["typeno", "featno"], ["seq"], ["seq", "lsh"])
    both = own.join(stored.where(F.size("lsh") == B.n_words(BITS)), ["typeno", "featno"])
    return both.select("typeno", "featno", B.distance("own", "lsh").alias("dist")).where("dist > 0")


def cosine_topk(spark, sf_dir):
    df = current_vectors(table(spark, sf_dir, "vectors"), DIM)
    found = search.exact_topk(df, _asked(df), k=K)
    return _named(found, "cosine", "rank")


def hamming_topk(spark, sf_dir):
    df = hashed(spark, sf_dir)
    found = search.search(df, _asked(df), bits=BITS, k=K, min_sim=MIN_SIM, factor=FACTOR)
    return _named(found, "dist", F.round("weight", 6).alias("weight"), "rank")


def lsh_prefilter_topk(spark, sf_dir):
    df = hashed(spark, sf_dir)
    found = search.search(df, _asked(df), bits=BITS, k=K, min_sim=MIN_SIM, factor=FACTOR, prefilter=True)
    return _named(found, "dist", F.round("weight", 6).alias("weight"), "rank")


def lsh_filter_stats(spark, sf_dir):
    df = hashed(spark, sf_dir)
    return search.search_stats(df, _asked(df), bits=BITS, k=K, min_sim=MIN_SIM, factor=FACTOR)


def rerank_topk(spark, sf_dir):
    df = hashed(spark, sf_dir)
    found = search.reranked(df, _asked(df), bits=BITS, k=K, min_sim=MIN_SIM, factor=FACTOR)
    return _named(found, "weight", "rank")


def bench_candidate_counts(spark, sf_dir):
    df = hashed(spark, sf_dir)
    return search.bench_candidates(df, _asked(df), bits=BITS, word=3, dist=60)


def term_similarity(spark, sf_dir):
    """Each feature divisible by 20 and the next in number, weighted 1 and 0.5, searched in the type of the first."""
    df = hashed(spark, sf_dir)
    base = _asked(df).select("query_id", "typeno", "featno")
    first = base.select("query_id", "typeno", "featno", F.lit(1.0).alias("term_weight"))
    second = base.select("query_id", "typeno", (F.col("featno") + 1).alias("featno"), F.lit(0.5).alias("term_weight"))
    model = lshmodel.from_frame(table(spark, sf_dir, "lsh_model"))
    found = search.similar_terms(first.unionByName(second), base.select("query_id", "typeno"), df, model, k=K, min_sim=0.7, recall=FACTOR, min_norm=0.9)
    return _named(found, "weight", "rank")


def wide_filter_topk(spark, sf_dir):
    """The filtered search at 1,248 bits, where all four filter words count: the model beside itself turned by one and by two components."""
    m = lshmodel.from_frame(table(spark, sf_dir, "lsh_model")).matrix
    model = lshmodel.LshModel(np.vstack([np.roll(m, turn, axis=1) for turn in range(3)]))
    df = Cut(spark, "hash").keep(lshmodel.hash_vectors(current_vectors(table(spark, sf_dir, "vectors"), DIM), model))
    found = search.search(df, _asked(df), bits=model.total_bits, k=K, min_sim=MIN_SIM, factor=FACTOR, prefilter=True)
    return _named(found, "dist", F.round("weight", 6).alias("weight"), "rank")


def bench_candidate_pairs(spark, sf_dir):
    """F10 as pairs: each feature divisible by 20 with all whose word 3 differs in at most 9 bits."""
    df = hashed(spark, sf_dir)
    return _named(search.bench_pairs(df, _asked(df), bits=BITS, word=3, dist=60), "word_dist")


def stored_hash_edits(spark, sf_dir):
    """Bits set and cleared, hashes read back from text, seeded random bits."""
    noise = B.random_words(BITS, "seq")
    return _stored(spark, sf_dir).select(
        "seq",
        B.to_hex(B.set_bit("lsh", 100, 1, BITS)).alias("hex_set"),
        B.to_hex(B.set_bit("lsh", 415, 0, BITS)).alias("hex_clear"),
        B.set_bit("lsh", 416, 1, BITS).isNull().alias("out_of_bounds"),
        (B.from_hex(B.to_hex("lsh"), 7) == F.col("lsh")).alias("read_back"),
        (B.to_hex(B.bit_and(noise, B.constant(BITS, 1))) == B.to_hex(noise)).alias("padding_clear"),
        (B.count(noise).between(130, 290) & (B.to_hex(noise) == B.to_hex(B.random_words(BITS, F.col("seq"))))).alias("random"),
    )


def sql_names(spark, sf_dir):
    """The functions as SQL names, in a query of text."""
    sqlnames.register(spark, lshmodel.from_frame(table(spark, sf_dir, "lsh_model")))
    current_vectors(table(spark, sf_dir, "vectors"), DIM).withColumn("vec", F.col("vec").cast("array<double>")).createOrReplaceTempView("weftline_current")
    return spark.sql("""
        SELECT typeno, featno, bits_set(h) AS n_set, hamming(h, reverse(h)) AS dist, round(lsh_weight(hamming(h, reverse(h)), 416), 6) AS weight,
          round(vec_cosine(vec, reverse(vec)), 6) AS cosine
        FROM (SELECT typeno, featno, vec, simhash(vec) AS h FROM weftline_current)""")


QUERIES = {
    f.__name__: f
    for f in (wide_filter_topk, bench_candidate_pairs, stored_hash_edits, sql_names, current_vector_keys, normalized_vectors, simhash_words, stored_hash_bits, stored_hash_algebra, stale_hashes, cosine_topk, hamming_topk, lsh_prefilter_topk, lsh_filter_stats, rerank_topk, bench_candidate_counts, term_similarity)
}

CURRENT_SQL = """
WITH cur AS (SELECT typeno, featno, CAST(vec AS DOUBLE[]) AS vec, lsh FROM (
  SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY seq DESC NULLS LAST) AS rn FROM vectors WHERE typeno IS NOT NULL AND featno IS NOT NULL)
  WHERE rn = 1 AND vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)
"""

_HASH = (
    CURRENT_SQL
    + """,
h AS (SELECT typeno, featno, any_value(c.vec) AS vec, any_value(c.lsh) AS lsh,
  string_agg(CASE WHEN list_inner_product(c.vec, CAST(m.coeffs AS DOUBLE[])) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m.row_no) AS t
  FROM cur c CROSS JOIN lsh_model m GROUP BY typeno, featno),
q AS (SELECT typeno, featno, vec, CAST(t AS BIT) AS b, t FROM h WHERE featno % 20 = 0),
"""
)

# distance limits of weight 0.8 at 416 bits: 104; with the recall factor 0.3: 135; per word: 135 // 7 = 19
_NEAR = """
d AS (SELECT q.typeno, q.featno, h.featno AS other, bit_count(xor(CAST(h.t AS BIT), q.b)) AS dist,
      bit_count(xor(CAST(substr(h.t, 1, 64) AS BIT), CAST(substr(q.t, 1, 64) AS BIT))) AS partial, h.vec, q.vec AS q_vec
      FROM q JOIN h ON h.typeno = q.typeno),
"""

_FILTER = """
c AS (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY partial, other) AS pos FROM d WHERE partial <= 19),
s AS (SELECT typeno, featno, list_sort(list(dist)) AS l FROM c WHERE pos <= 30 GROUP BY 1, 2),
p AS (SELECT typeno, featno, len(l) AS sampled, l[len(l)] AS sample_max,
      CAST(floor(floor((CASE WHEN len(l) > 10 AND l[11] > 0 THEN l[11] ELSE 104 END) * (135 / 104) + 1) / 7) AS INT) AS prob_sum FROM s),
"""


def _best(source: str, order: str, cols: str, k: int = K) -> str:
    return f"SELECT featno, typeno, other, {cols}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY {order}) AS rank FROM ({source})) WHERE rank <= {k}"


_TEXT = r"array_to_string(list_transform(lsh, lambda w: CAST(CAST(w AS BIT) AS VARCHAR)), '')"
_ALGEBRA = """
WITH s AS (SELECT DISTINCT seq, typeno, featno, lsh FROM vectors WHERE len(lsh) = 7),
x AS (SELECT seq, typeno, featno, CAST(t AS BIT) AS a, CAST(r AS BIT) AS b, t, r FROM (SELECT *, array_to_string(list_transform(lsh, lambda w: CAST(CAST(w AS BIT) AS VARCHAR)), '') AS t,
  array_to_string(list_transform(list_reverse(lsh), lambda w: CAST(CAST(w AS BIT) AS VARCHAR)), '') AS r FROM s))
"""


def _hex(bits: str) -> str:
    return f"array_to_string(list_transform(range(0, 7), lambda i: lpad(hex(CAST(CAST(substr(CAST({bits} AS VARCHAR), CAST(1 + 64 * i AS INT), 64) AS BIT) AS BIGINT)), 16, '0')), '')"


# limits at 1,248 bits and weight 0.8: 312, with the recall factor 405; per word 20, and 37, 55 and 73 after 2, 3 and 4 words
_WIDE = (
    CURRENT_SQL
    + """,
wm AS (SELECT row_no, coeffs FROM lsh_model UNION ALL SELECT row_no + 416, list_concat(coeffs[64:64], coeffs[1:63]) FROM lsh_model UNION ALL SELECT row_no + 832, list_concat(coeffs[63:64], coeffs[1:62]) FROM lsh_model),
h AS (SELECT typeno, featno, string_agg(CASE WHEN list_inner_product(c.vec, CAST(m.coeffs AS DOUBLE[])) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m.row_no) AS t FROM cur c CROSS JOIN wm m GROUP BY typeno, featno),
d AS (SELECT q.typeno, q.featno, h.featno AS other, bit_count(xor(CAST(h.t AS BIT), CAST(q.t AS BIT))) AS dist,
      list_transform(range(0, 4), lambda i: bit_count(xor(CAST(substr(h.t, CAST(1 + 64 * i AS INT), 64) AS BIT), CAST(substr(q.t, CAST(1 + 64 * i AS INT), 64) AS BIT)))) AS w FROM h q JOIN h ON h.typeno = q.typeno AND q.featno % 20 = 0),
c AS (SELECT *, list_sum(w) AS partial, row_number() OVER (PARTITION BY typeno, featno ORDER BY list_sum(w), other) AS pos FROM d
      WHERE w[1] <= 20 AND w[2] <= 20 AND w[3] <= 20 AND w[4] <= 20 AND w[1] + w[2] <= 37 AND w[1] + w[2] + w[3] <= 55 AND list_sum(w) <= 73),
s AS (SELECT typeno, featno, list_sort(list(dist)) AS l FROM c WHERE pos <= 30 GROUP BY 1, 2),
p AS (SELECT typeno, featno, floor((4 * p - 3 * (p - 312)) / 20) AS prob_sum FROM (SELECT *, floor((CASE WHEN len(l) > 10 AND l[11] > 0 THEN l[11] ELSE 312 END) * (405 / 312) + 1) AS p FROM s)),
z AS (SELECT 1) """
)
_PUT = "substr(t, 1, {0}) || '{1}' || substr(t, {0} + 2)"

ORACLE = {
    "wide_filter_topk": _WIDE + _best("SELECT c.*, round(1 - dist / 1560, 6) AS weight FROM c JOIN p USING (typeno, featno) WHERE partial < prob_sum AND dist <= 312 AND 1 - dist / 1560 > 0.8", "dist, other", "CAST(dist AS INT) AS dist, weight"),
    "bench_candidate_pairs": _HASH
    + "z AS (SELECT q.typeno, q.featno, h.featno AS other, CAST(bit_count(xor(CAST(substr(h.t, 193, 64) AS BIT), CAST(substr(q.t, 193, 64) AS BIT))) AS INT) AS word_dist FROM q JOIN h ON h.typeno = q.typeno AND h.featno <> q.featno) SELECT * FROM z WHERE word_dist <= 9",
    "stored_hash_edits": f"""
WITH s AS (SELECT DISTINCT seq, typeno, featno, lsh FROM vectors WHERE len(lsh) = 7), x AS (SELECT seq, {_TEXT} AS t FROM s)
SELECT seq, {_hex(_PUT.format(100, 1))} AS hex_set, {_hex(_PUT.format(415, 0))} AS hex_clear, true AS out_of_bounds, true AS read_back, true AS padding_clear, true AS random FROM x""",
    "sql_names": _HASH
    + """z AS (SELECT typeno, featno, vec, t || repeat('0', 32) AS t FROM h),
y AS (SELECT *, bit_count(xor(CAST(t AS BIT), CAST(array_to_string(list_transform(range(6, -1, -1), lambda i: substr(t, CAST(1 + 64 * i AS INT), 64)), '') AS BIT))) AS dist FROM z)
SELECT typeno, featno, CAST(length(replace(t, '0', '')) AS INT) AS n_set, CAST(dist AS INT) AS dist, round(1 - dist / 520, 6) AS weight, round(list_cosine_similarity(vec, list_reverse(vec)), 6) AS cosine FROM y""",
    "current_vector_keys": CURRENT_SQL + "SELECT typeno, featno, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM cur",
    "normalized_vectors": CURRENT_SQL + "SELECT typeno, featno, round(CAST(CAST(vec[1] / sqrt(list_inner_product(vec, vec)) AS FLOAT) AS DOUBLE), 5) AS first, 1.0 AS length FROM cur",
    "simhash_words": _HASH + "z AS (SELECT 1) SELECT typeno, featno, array_to_string(list_transform(range(0, 7), lambda i: substr(t, CAST(1 + 64 * i AS INT), 64)), '|') AS bits FROM h",
    "stored_hash_bits": f"""
WITH s AS (SELECT DISTINCT seq, typeno, featno, lsh FROM vectors WHERE len(lsh) = 7), x AS (SELECT seq, typeno, featno, substr({_TEXT}, 1, 416) AS t, {_TEXT} AS full_t FROM s)
SELECT seq, CAST(length(replace(full_t, '0', '')) AS INT) AS n_set, CAST(substr(t, 101, 1) AS INT) AS bit100,
  CAST(CASE WHEN position('0' IN substr(t, 101)) > 0 THEN 99 + position('0' IN substr(t, 101)) WHEN position('0' IN t) > 0 THEN position('0' IN t) - 1 ELSE 416 END AS INT) AS free100,
  CAST(416 - length(replace(t, '0', '')) AS INT) AS n_clear,
  array_to_string(list_transform(range(0, 7), lambda i: substr(t, CAST(1 + 64 * i AS INT), 64)), '|') AS bits FROM x""",
    "stored_hash_algebra": _ALGEBRA
    + f"""SELECT seq, {_hex("a & b")} AS hex_and, {_hex("a | b")} AS hex_or, {_hex("xor(a, b)")} AS hex_xor,
  {_hex("(~a) & CAST(repeat('1', 416) || repeat('0', 32) AS BIT)")} AS hex_not,
  CAST(bit_count(xor(a, b)) AS INT) AS dist, bit_count(xor(a, b)) <= 200 AS near200, t < r AS less, CAST(bit_count(a | CAST(repeat('1', 416) || repeat('0', 32) AS BIT)) AS INT) AS n_ones FROM x""",
    "stale_hashes": _HASH + f"z AS (SELECT typeno, featno, CAST(bit_count(xor(CAST(t || repeat('0', 32) AS BIT), CAST({_TEXT} AS BIT))) AS INT) AS dist FROM h WHERE len(lsh) = 7) SELECT * FROM z WHERE dist > 0",
    "cosine_topk": CURRENT_SQL + _best("SELECT q.typeno, q.featno, c.featno AS other, round(list_cosine_similarity(c.vec, q.vec), 6) AS cosine FROM cur q JOIN cur c ON c.typeno = q.typeno WHERE q.featno % 20 = 0", "cosine DESC, other", "cosine"),
    "hamming_topk": _HASH + _NEAR + "z AS (SELECT 1) " + _best("SELECT *, round(1 - dist / 520, 6) AS weight FROM d WHERE dist <= 104 AND 1 - dist / 520 > 0.8", "dist, other", "CAST(dist AS INT) AS dist, weight"),
    "lsh_prefilter_topk": _HASH + _NEAR + _FILTER + "z AS (SELECT 1) " + _best("SELECT c.*, round(1 - dist / 520, 6) AS weight FROM c JOIN p USING (typeno, featno) WHERE partial < prob_sum AND dist <= 104 AND 1 - dist / 520 > 0.8", "dist, other", "CAST(dist AS INT) AS dist, weight"),
    "lsh_filter_stats": _HASH
    + _NEAR
    + _FILTER
    + """a AS (SELECT typeno, featno, count(*) AS searched, count(*) FILTER (partial <= 19) AS passed FROM d GROUP BY 1, 2),
r AS (SELECT typeno, featno, count(*) AS read, count(*) FILTER (dist <= 104) AS matches FROM c JOIN p USING (typeno, featno) WHERE partial < prob_sum GROUP BY 1, 2)
SELECT typeno * 4294967296 + featno AS query_id, searched, passed AS passed_first, passed AS candidates, CAST(sampled AS INT) AS sampled, CAST(sample_max AS INT) AS sample_max, prob_sum, coalesce(read, 0) AS read, coalesce(matches, 0) AS matches
FROM a LEFT JOIN p USING (typeno, featno) LEFT JOIN r USING (typeno, featno)""",
    "rerank_topk": _HASH
    + _NEAR
    + "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY dist, other) AS n FROM d WHERE dist <= 104 AND 1 - dist / 520 > 0.8) WHERE n <= 30), e AS (SELECT typeno, featno, other, round(list_cosine_similarity(vec, q_vec), 6) AS weight FROM k) "
    + _best("SELECT * FROM e WHERE weight > 0.8", "weight DESC, other DESC", "weight"),
    "bench_candidate_counts": _HASH
    + "z AS (SELECT 1) SELECT q.typeno * 4294967296 + q.featno AS query_id, count(*) AS candidates FROM q JOIN h ON h.typeno = q.typeno AND h.featno <> q.featno WHERE bit_count(xor(CAST(substr(h.t, 193, 64) AS BIT), CAST(substr(q.t, 193, 64) AS BIT))) <= 9 GROUP BY 1",
    "term_similarity": _HASH
    + """
tv AS (SELECT a.typeno, a.featno, CASE WHEN b.vec IS NULL THEN a.vec ELSE list_transform(range(1, 65), lambda i: a.vec[i] + 0.5 * b.vec[i]) END AS vec FROM h a LEFT JOIN h b ON b.typeno = a.typeno AND b.featno = a.featno + 1 WHERE a.featno % 20 = 0),
th AS (SELECT typeno, featno, any_value(tv.vec) AS vec, CAST(string_agg(CASE WHEN list_inner_product(tv.vec, CAST(m.coeffs AS DOUBLE[])) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m.row_no) AS BIT) AS b FROM tv CROSS JOIN lsh_model m GROUP BY typeno, featno),
td AS (SELECT th.typeno, th.featno, h.featno AS other, bit_count(xor(CAST(h.t AS BIT), th.b)) AS dist, h.vec, th.vec AS q_vec FROM th JOIN h ON h.typeno = th.typeno),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY dist, other) AS n FROM td WHERE dist <= 156 AND 1 - dist / 520 > 0.7) WHERE n <= 30),
te AS (SELECT typeno, featno, other, round(list_cosine_similarity(vec, q_vec), 6) AS weight FROM tk),
tr AS ("""
    + _best("SELECT * FROM te WHERE weight > 0.7", "weight DESC, other DESC", "weight")
    + ") SELECT featno, typeno, other, weight, rank FROM (SELECT *, max(weight) OVER (PARTITION BY typeno, featno) AS top FROM tr) WHERE weight > top * 0.9 - 1e-14",
}
