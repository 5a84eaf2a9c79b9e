import math

import numpy as np
import pytest

from weftline.functions import vec as V
from weftline.operators import lshmodel, search
from weftline.operators.upsert import current_vectors

SCHEMA = "typeno int, featno int, vec array<float>, query_id bigint, rank int"


@pytest.fixture(scope="module")
def model():
    return lshmodel.create_model(64, 32, 13, seed=3)


@pytest.fixture(scope="module")
def planted():
    """Unrelated vectors and, for every tenth, five near ones."""
    r = np.random.default_rng(5)
    base = r.standard_normal((600, 64))
    rows = [base]
    for i in range(0, 600, 10):
        rows.append(base[i] + r.standard_normal((5, 64)) * r.uniform(0.05, 0.4, (5, 1)))
    return np.vstack(rows).astype(np.float32)


@pytest.fixture(scope="module")
def frame(spark, model, planted):
    rows = [(1 + i % 2, i, [float(v) for v in x], 5, 6) for i, x in enumerate(planted)]
    return lshmodel.hash_vectors(spark.createDataFrame(rows, SCHEMA), model).select("typeno", "featno", "vec", "lsh").cache()


def asked(frame):
    return frame.where("featno % 10 = 0").withColumn("query_id", frame.featno.cast("bigint"))


def test_model_shape_and_seed(model):
    base = lshmodel.base_matrix(64, 32)
    assert base.shape == (32, 64) and np.allclose(base[0, :2], 0.5) and np.allclose(base[0, 2:], -1 / 62)
    assert model.total_bits == 416 and model.words == 7
    assert model.equals(lshmodel.create_model(64, 32, 13, seed=3)) and not model.equals(lshmodel.create_model(64, 32, 13, seed=4))
    with pytest.raises(ValueError):
        lshmodel.base_matrix(10, 20)


def test_hash_is_free_of_scale_and_round_trips(spark, model, planted):
    assert (model.hash(planted) == model.hash(planted * 1000)).all()
    back = lshmodel.from_frame(lshmodel.to_frame(spark, model))
    assert back.equals(model)
    with pytest.raises(ValueError):
        model.bits(planted[:, :10])


def test_hash_of_unusable_vectors_is_null(spark, model):
    bad = [None, [], [1.0] * 63, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64]
    rows = [(1, i, v, 1, 1) for i, v in enumerate(bad)]
    assert lshmodel.hash_vectors(spark.createDataFrame(rows, SCHEMA), model).where("lsh is not null").count() == 0


def test_angles(model, planted):
    bits = model.bits(planted)
    u = planted / np.linalg.norm(planted, axis=1, keepdims=True)
    near = [(i, 600 + i // 10 * 5) for i in range(0, 600, 10)]
    share = np.array([(bits[a] != bits[b]).mean() for a, b in near])
    angle = np.array([math.acos(min(1.0, float(u[a] @ u[b]))) / math.pi for a, b in near])
    assert abs((share - angle).mean()) < 0.02


def brute(frame, k, simdist):
    rows = frame.collect()
    h = {r.featno: "".join(format(w & (2**64 - 1), "064b") for w in r.lsh) for r in rows}
    t = {r.featno: r.typeno for r in rows}
    out = {}
    for q in h:
        if q % 10 == 0:
            d = sorted((sum(a != b for a, b in zip(h[q], h[f], strict=True)), f) for f in h if t[f] == t[q])
            out[q] = [(f, n) for n, f in d if n <= simdist and 1 - n / 520 > 0.8][:k]
    return out


def test_full_scan_is_exact(frame):
    got = {}
    for r in search.search(frame, asked(frame), bits=416, k=4, min_sim=0.8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.featno, r.dist))
    want = brute(frame, 4, 104)
    assert got == {q: v for q, v in want.items() if v}


def test_prefilter_keeps_most(frame):
    full = {(r.query_id, r.featno) for r in search.search(frame, asked(frame), bits=416, k=6, min_sim=0.8).collect()}
    some = {(r.query_id, r.featno) for r in search.search(frame, asked(frame), bits=416, k=6, min_sim=0.8, factor=0.88, prefilter=True).collect()}
    assert len(full & some) / len(full) > 0.97


def test_rerank_finds_near_vectors(frame, planted):
    u = planted / np.linalg.norm(planted, axis=1, keepdims=True)
    rows = search.reranked(frame, asked(frame), bits=416, k=10, min_sim=0.9, lsh_min_sim=0.8).collect()
    got = {(r.query_id, r.featno) for r in rows}
    want = {(q, f) for q in range(0, len(u), 10) for f in range(len(u)) if f % 2 == q % 2 and round(float(u[q] @ u[f]), 6) > 0.9}
    assert len(got & want) / len(want) > 0.97 and got <= want
    assert all(r.rank == 1 for r in rows if r.query_id == r.featno)


def test_exact_topk(frame, planted):
    u = planted.astype(np.float64) / np.linalg.norm(planted.astype(np.float64), axis=1, keepdims=True)
    got = {}
    for r in search.exact_topk(frame, asked(frame), k=3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.featno)
    for q, found in got.items():
        c = sorted((-round(float(u[q] @ u[f]), 6), f) for f in range(len(u)) if f % 2 == q % 2)
        assert found == [f for _, f in c[:3]]


def test_limits():
    lim = search.limits(2048, 0.9, 0.88)
    assert (lim.simdist, lim.prob, lim.rel, lim.benches) == (255, 479, 14, 4) or lim.simdist == 256
    assert search.limits(416, 0.8, 0.88).simdist == 104 and search.limits(416, 1.0, 0.5).simdist == 0
    assert search.ranks_kept(10, True) == 30 and search.ranks_kept(200, True) == 256 and search.ranks_kept(7, False) == 7
    for k in (0, 257):
        with pytest.raises(ValueError):
            search.ranks_kept(k, False)


def test_equal_hashes_pass_at_weight_one(frame):
    one = search.limits(416, 1.0, 0.5)
    found = search._tightened(search.candidates(frame, asked(frame), one), one, 5).where("dist <= 0")
    assert {(r.query_id, r.featno) for r in found.collect()} >= {(q, q) for q in range(0, 600, 10)}


def test_empty(spark, frame):
    none = frame.limit(0)
    q = asked(frame)
    assert search.search(none, q, bits=416, k=3, min_sim=0.8).count() == 0
    assert search.search(frame, q.limit(0), bits=416, k=3, min_sim=0.8, prefilter=True).count() == 0
    assert search.exact_topk(none, q, k=3).count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine("a", "b").alias("c"), V.norm("a").alias("n"), V.normalize("a").alias("u")).collect()
    assert abs(rows[0].c - 1) < 1e-12 and rows[0].n == 5 and np.allclose(rows[0].u, [0.6, 0.8])
    assert rows[1].c == 0 and rows[1].u is None and rows[2].c is None and rows[3].c is None
    assert V.distance_of(0.9, 2048) in (255, 256) and V.distance_of(-5, 64) == 64


def test_current_vectors(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, 1, 1, v), (3, 1, 1, None), (2, 1, 1, v), (1, 1, 2, v), (2, 1, 2, [0.5] * 64), (2, 1, 2, [0.5] * 64), (1, None, 3, v), (1, 1, 4, [0.0] * 64), (1, 1, 5, [float("nan")] * 64), (1, 1, 6, [None] * 64), (None, 1, 7, v)]
    df = spark.createDataFrame(rows, "seq bigint, typeno int, featno int, vec array<float>")
    got = {r.featno: r.vec[1] for r in current_vectors(df, 64).collect()}
    assert got == {2: 0.5, 7: 0.0}
