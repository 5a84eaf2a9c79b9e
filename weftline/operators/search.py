"""Similarity search over packed hashes: full scan, multi-stage filter, exact re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import filter_benches
from weftline.functions import bits as B
from weftline.functions import vec as V
from weftline.operators.lshmodel import LshModel, hash_vectors

#: Most ranks of the hash stage.
MAX_RANKS = 256
#: Queries in one broadcast; more are searched in blocks.
BLOCK = 20_000


@dataclass(frozen=True)
class Limits:
    """Distances that follow from a least weight and a recall factor."""

    bits: int
    words: int
    benches: int
    simdist: int
    prob: int

    @property
    def rel(self) -> int:
        return self.prob // self.words

    def max_sum(self, stage: int) -> int:
        """Largest running sum after the benches ``0 .. stage``."""
        return int((stage + 1) * self.rel - stage * (self.prob - self.simdist) / (2 * self.words))


def limits(bits: int, min_sim: float, factor: float) -> Limits:
    words = B.n_words(bits)
    simdist = V.distance_of(min_sim, bits)
    prob = min(bits, int((1.0 + factor) * simdist + 1e-9))
    return Limits(bits, words, filter_benches(words), simdist, prob)


def ranks_kept(k: int, real_weights: bool) -> int:
    n = min(MAX_RANKS, 2 * k + 10) if real_weights else k
    if not 1 <= k <= MAX_RANKS:
        raise ValueError(f"the number of results must be 1 to {MAX_RANKS}")
    return n


def _top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each query, with their rank; Spark limits groups before and after the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(vectors: DataFrame, queries: DataFrame, n: int, condition: Column, keep: list[Column]) -> DataFrame:
    """Rows of ``vectors`` and queries of their type that meet ``condition`` over ``w*`` and ``q*``.

    Queries are broadcast in blocks of :data:`BLOCK` and hashed by type; vectors stream past them without shuffle.
    """
    q = queries.select("query_id", "typeno", *B.wide("lsh", n, "q"))
    v = vectors.select("typeno", F.col("featno"), *B.wide("lsh", n, "w"))
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = v.join(F.broadcast(part), "typeno").where(condition).select("query_id", "typeno", "featno", *keep)
        out = found if out is None else out.unionByName(found)
    return out


def _dist(n: int) -> Column:
    return B.distance_wide([f"w{i}" for i in range(n)], [f"q{i}" for i in range(n)])


def _bench(lim: Limits) -> tuple[Column, Column]:
    """Conditions of the filter benches in their order, and the running sum after the last."""
    parts = [F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(lim.benches)]
    ok, total = parts[0] <= lim.rel, parts[0]
    for i, p in enumerate(parts[1:], 1):
        total = total + p
        ok = ok & (p <= lim.rel) & (total <= lim.max_sum(i))
    return ok, total


def search(vectors: DataFrame, queries: DataFrame, *, bits: int, k: int, min_sim: float, factor: float = 0.8, prefilter: bool = False, ranks: int | None = None) -> DataFrame:
    """Nearest hashes of each query: ``(query_id, typeno, featno, dist, weight, rank)`` (F1).

    ``vectors`` has ``(typeno, featno, lsh)``, ``queries`` ``(query_id, typeno, lsh)``; a query meets vectors of its
    type only. Results have a distance within that of ``min_sim`` and a weight above ``min_sim``, at most ``k`` of
    them, by distance, then ``featno``. The full scan is exact; with ``prefilter`` the first words are tested before
    the rest, with limits that ``factor`` widens, and a sample of the best tightens them (F4-F6).

    A null ``lsh`` matches nothing; missing words count as zeros.
    """
    if not 1 <= k <= MAX_RANKS:
        raise ValueError(f"the number of results must be 1 to {MAX_RANKS}")
    ranks = ranks or k
    lim = limits(bits, min_sim, factor)
    vectors, queries = vectors.where(F.col("lsh").isNotNull()), queries.where(F.col("lsh").isNotNull())
    if prefilter:
        near = _tightened(candidates(vectors, queries, lim), lim, ranks).where(F.col("dist") <= lim.simdist)
    else:
        v = vectors.select("typeno", "featno", F.array(*B.words_of("lsh", lim.words)).alias("words"))
        q = queries.select("typeno", "query_id", F.array(*B.words_of("lsh", lim.words)).alias("words"))
        near = _tiles(v, q, lim.simdist, "dist", ranks)
    found = _top(near.select("query_id", "typeno", "featno", "dist"), ranks, "dist", "featno")
    found = found.withColumn("weight", V.weight_of("dist", bits))
    return found.where((F.col("rank") <= ranks) & (F.col("weight") > min_sim))


def candidates(vectors: DataFrame, queries: DataFrame, lim: Limits) -> DataFrame:
    """What passes the filter benches, with the partial and the full distance."""
    ok, total = _bench(lim)
    return _pairs(vectors, queries, lim.words, ok, [total.alias("partial"), _dist(lim.words).alias("dist")])


def _sample_limit(found: DataFrame, lim: Limits, ranks: int) -> DataFrame:
    """``(query_id, sampled, sample_max, prob_sum)`` from the candidates with the best partial distances."""
    m = min(MAX_RANKS, 2 * ranks + 10)
    best = _top(found, m, "partial", "featno").groupBy("query_id").agg(F.sort_array(F.collect_list("dist")).alias("d"))
    last = F.when(F.size("d") > ranks, F.get("d", F.lit(ranks))).otherwise(F.lit(0))
    last = F.when(last == 0, F.lit(lim.simdist)).otherwise(last)
    if lim.simdist:
        p = F.floor(last * F.lit(lim.prob / lim.simdist) + 1)
        prob_sum = F.floor((lim.benches * p - (lim.benches - 1) * (p - lim.simdist)) / F.lit(float(lim.words)))
    else:
        prob_sum = F.lit(1)  # only equal hashes pass
    return best.select("query_id", F.size("d").alias("sampled"), F.element_at("d", -1).alias("sample_max"), prob_sum.cast("int").alias("prob_sum"))


def _tightened(found: DataFrame, lim: Limits, ranks: int) -> DataFrame:
    limit = _sample_limit(found, lim, ranks).select("query_id", "prob_sum")
    return found.join(limit, "query_id").where(F.col("partial") < F.col("prob_sum")).drop("prob_sum")


def search_stats(vectors: DataFrame, queries: DataFrame, *, bits: int, k: int, min_sim: float, factor: float) -> DataFrame:
    """Counters of a filtered search for each query (F8).

    ``(query_id, searched, passed_first, candidates, sampled, sample_max, prob_sum, read, matches)``; a query that
    nothing passes for has zeros and nulls.
    """
    lim = limits(bits, min_sim, factor)
    vectors, queries = vectors.where(F.col("lsh").isNotNull()), queries.where(F.col("lsh").isNotNull())
    first = F.bit_count(F.col("w0").bitwiseXOR(F.col("q0"))) <= lim.rel
    ok, _ = _bench(lim)
    seen = _pairs(vectors, queries, lim.words, F.lit(True), [first.alias("a"), ok.alias("b")]).groupBy("query_id").agg(F.count("*").alias("searched"), F.count_if("a").alias("passed_first"), F.count_if("b").alias("candidates"))
    found = candidates(vectors, queries, lim)
    limit = _sample_limit(found, lim, k)
    read = found.join(limit.select("query_id", "prob_sum"), "query_id").where(F.col("partial") < F.col("prob_sum"))
    read = read.groupBy("query_id").agg(F.count("*").alias("read"), F.count_if(F.col("dist") <= lim.simdist).alias("matches"))
    out = seen.join(limit, "query_id", "left").join(read, "query_id", "left")
    return out.select("query_id", "searched", "passed_first", "candidates", "sampled", "sample_max", "prob_sum", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("matches", F.lit(0)).alias("matches"))


def reranked(vectors: DataFrame, queries: DataFrame, *, bits: int, k: int, min_sim: float, factor: float = 0.8, prefilter: bool = False, lsh_min_sim: float | None = None) -> DataFrame:
    """The hash search with ``min(256, 2k + 10)`` ranks, re-ranked by exact cosines: ``(query_id, typeno, featno, weight, rank)`` (F2).

    Vectors are fetched for the survivors only. Results follow descending cosine, then descending ``featno``, at
    most ``k`` with a cosine above ``min_sim``. ``lsh_min_sim`` sets the limit of the hash stage apart, since the
    weight of a hash is only a proxy of the cosine.
    """
    if not 0 <= min_sim <= 1:
        raise ValueError("the least similarity must be 0 to 1")
    stage = search(vectors, queries, bits=bits, k=k, min_sim=min_sim if lsh_min_sim is None else lsh_min_sim, factor=factor, prefilter=prefilter, ranks=ranks_kept(k, True))
    stage = stage.select("query_id", "typeno", "featno")
    near = stage.join(vectors.select("typeno", "featno", "vec"), ["typeno", "featno"]).join(queries.select("query_id", F.col("vec").alias("q_vec")), "query_id")
    exact = near.select("query_id", "typeno", "featno", F.round(V.cosine("vec", "q_vec"), 6).alias("weight"))
    return _top(exact.where(F.col("weight") > min_sim), k, F.desc("weight"), F.desc("featno"))


def _tiles(vectors: DataFrame, queries: DataFrame, limit: int, name: str, k: int | None = None) -> DataFrame:
    """Distances up to ``limit`` of all vectors of a query's type: ``(query_id, typeno, featno, <name> INT)``.

    Both have ``words``. As in :func:`exact_topk` each pair of blocks is one task's: words are laid side by side and
    differences counted for tiles that fit the cache. So many words are counted for all as take unrelated hashes over
    the limit; the others only where the limit isn't passed yet, so that nothing is lost. With ``k`` a tile gives a query's ``k`` nearest only, ties to the smaller
    ``featno``.
    """
    schema = pa.schema([("query_id", pa.int64()), ("typeno", pa.int32()), ("featno", pa.int32()), (name, pa.int32())])

    def words(column: pa.ChunkedArray) -> np.ndarray:
        return np.ascontiguousarray(np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1).T.astype(np.int64)).view(np.uint64)

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        feat, ids = np.asarray(vectors["featno"]), np.asarray(queries["q_id"])
        order = np.argsort(feat, kind="stable")
        feat, x, y = feat[order], words(vectors["vec"])[:, order], words(queries["q_vec"])
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        block = max(1, (1 << 16) // len(feat))
        dense = min(len(x), limit // 32 + 4)
        xor, ones, dist = (np.empty((block, len(feat)), dtype=t) for t in (np.uint64, np.uint8, np.uint16))
        for s in range(0, len(ids), block):
            part = slice(0, min(block, len(ids) - s))
            dist[part] = 0
            for w in range(dense):
                np.bitwise_xor(y[w, s : s + block, None], x[w], out=xor[part])
                np.bitwise_count(xor[part], out=ones[part])
                np.add(dist[part], ones[part], out=dist[part])
            row, col = np.nonzero(dist[part] <= limit)
            got = dist[row, col].astype(np.int64)
            for w in range(dense, len(x)):
                got += np.bitwise_count(y[w, s + row] ^ x[w, col])
            near = got <= limit
            row, col, got = row[near], col[near], got[near]
            if k is not None and len(row):
                by = np.lexsort((col, got, row))
                row, col, got = row[by], col[by], got[by]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, got = row[best], col[best], got[best]
            out.append((ids[s + row], feat[col], got))
        q, f, d = (np.concatenate(p) for p in zip(*out, strict=True))
        typ = np.full(len(q), vectors["typeno"][0].as_py(), np.int32)
        return pa.table([pa.array(q.astype(np.int64)), pa.array(typ), pa.array(f.astype(np.int32)), pa.array(d.astype(np.int32))], schema=schema)

    grouped = _block_pairs(vectors.select("typeno", "featno", F.col("words").alias("vec")), queries.select("typeno", "query_id", F.col("words").alias("vec")))
    return grouped.applyInArrow(run, f"query_id bigint, typeno int, featno int, {name} int")


#: Vectors and queries of a tile of the brute-force search.
TILE_VECTORS, TILE_QUERIES = 8192, 2048


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int) -> DataFrame:
    """The ``k`` most similar vectors of each query by brute force: ``(query_id, typeno, featno, cosine, rank)``.

    Cosines have 6 digits; ties go to the smaller ``featno``. The vectors and the queries of a type are cut into
    blocks by hash; each pair of blocks is one matrix product in one task, of which only a query's best rows go on.
    A type's size sets its number of blocks, so that tiles stay small whatever it holds.
    """
    found = _block_pairs(vectors, queries).applyInArrow(_tile(k), "query_id bigint, typeno int, featno int, cosine double")
    return _top(found, k, F.desc("cosine"), "featno")


def _block_pairs(vectors: DataFrame, queries: DataFrame):
    """Vectors and queries of a type in blocks by hash, each pair of blocks a cogroup of ``vec`` and ``q_id, q_vec``."""
    v_blocks = _blocks(vectors, TILE_VECTORS, "vb")
    q_blocks = _blocks(queries, TILE_QUERIES, "qb")
    v = vectors.select("typeno", "featno", "vec").join(F.broadcast(v_blocks), "typeno").join(F.broadcast(q_blocks), "typeno")
    v = v.select("typeno", "featno", "vec", F.pmod(F.xxhash64("featno"), F.col("vb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"))
    q = queries.select("typeno", "query_id", "vec").join(F.broadcast(v_blocks), "typeno").join(F.broadcast(q_blocks), "typeno")
    q = q.select(F.col("typeno").alias("q_type"), F.col("query_id").alias("q_id"), F.col("vec").alias("q_vec"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("q_i"), F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("q_j"))
    return v.groupBy("typeno", "i", "j").cogroup(q.groupBy("q_type", "q_i", "q_j"))


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of each type: one row for each type, small enough to broadcast as types are a dimension."""
    return df.groupBy("typeno").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _unit(np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), -1))


def _tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("typeno", pa.int32()), ("featno", pa.int32()), ("cosine", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        feat, ids = np.asarray(vectors["featno"]), np.asarray(queries["q_id"])
        x, y = _matrix(vectors["vec"]), _matrix(queries["q_vec"])
        out = []
        for s in range(0, len(y), 256):
            cos = np.round(y[s : s + 256] @ x.T, 6)
            if len(feat) > k:
                row, col = np.nonzero(cos >= np.partition(cos, -k, axis=1)[:, -k, None])
            else:
                row, col = np.divmod(np.arange(cos.size), len(feat))
            got = cos[row, col]
            order = np.lexsort((feat[col], -got, row))
            row, col, got = row[order], col[order], got[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((ids[s + row[best]], feat[col[best]], got[best]))
        q, f, c = (np.concatenate(p) for p in zip(*out, strict=True))
        typ = np.full(len(q), vectors["typeno"][0].as_py(), np.int32)
        return pa.table([pa.array(q), pa.array(typ), pa.array(f.astype(np.int32)), pa.array(c)], schema=schema)

    return run


def bench_pairs(vectors: DataFrame, queries: DataFrame, *, bits: int, word: int, dist: int) -> DataFrame:
    """Candidate pairs of one word: ``(query_id, typeno, featno, word_dist)`` for vectors of the query's type whose word
    differs in at most ``dist * 64 / bits`` bits (F10).

    The query itself is left out; a pair is given in both directions if both ask. A query's own rows only are made:
    with every vector asking, their number grows with the square of a group of near vectors.
    """
    n = B.n_words(bits)
    most = dist * 64 // bits
    w = F.get("lsh", F.lit(word % n)).alias("word")
    v = vectors.where(F.col("lsh").isNotNull()).select("typeno", "featno", F.array(w).alias("words"))
    q = queries.where(F.col("lsh").isNotNull()).select("typeno", "query_id", F.col("featno").alias("self"), F.array(w).alias("words"))
    found = _tiles(v, q, most, "word_dist")
    own = queries.select("query_id", F.col("featno").alias("self"))
    return found.join(own, "query_id").where(F.col("featno") != F.col("self")).select("query_id", "typeno", "featno", "word_dist")


def bench_candidates(vectors: DataFrame, queries: DataFrame, *, bits: int, word: int, dist: int) -> DataFrame:
    """How many candidates each query has by one word: ``(query_id, candidates BIGINT)``."""
    return bench_pairs(vectors, queries, bits=bits, word=word, dist=dist).groupBy("query_id").agg(F.count("*").alias("candidates"))


def combined_vectors(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """The weighted sum of each query's terms: ``(query_id, vec ARRAY<DOUBLE>)``.

    ``terms`` has ``(query_id, typeno, featno, term_weight)``. Terms without a vector add nothing; a query without
    any known term has no row.
    """
    known = terms.join(vectors.select("typeno", "featno", "vec"), ["typeno", "featno"])
    parts = known.select("query_id", "term_weight", F.posexplode("vec").alias("pos", "x"))
    sums = parts.groupBy("query_id", "pos").agg(F.sum(F.col("term_weight") * F.col("x").cast("double")).alias("x"))
    listed = sums.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return listed.select("query_id", F.transform("p", lambda s: s["x"]).alias("vec"))


def similar_terms(terms: DataFrame, targets: DataFrame, vectors: DataFrame, model: LshModel, *, k: int, min_sim: float, recall: float, min_norm: float, prefilter: bool = False) -> DataFrame:
    """Features similar to a weighted combination of terms: ``(query_id, typeno, featno, weight, rank)``.

    ``targets`` has ``(query_id, typeno)``, the type searched. Results below ``min_norm`` of a query's best weight
    are cut.
    """
    asked = combined_vectors(terms, vectors).join(targets, "query_id")
    queries = hash_vectors(asked, model)
    found = reranked(vectors, queries, bits=model.total_bits, k=k, min_sim=min_sim, factor=recall, prefilter=prefilter)
    best = F.max("weight").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).where(F.col("weight") > F.col("best") * min_norm - 10 * np.finfo(float).eps).drop("best")
