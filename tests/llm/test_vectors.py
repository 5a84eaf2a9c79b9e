import numpy as np
import pytest

from weftline.llm import cells as C
from weftline.llm import clusters as K
from weftline.llm import neighbours as N
from weftline.config import create_config
from weftline.llm.components import connected_components
from weftline.operators.lshmodel import create_model, to_frame

SCHEMA = "seq bigint, typeno int, featno int, vec array<float>, lsh array<bigint>, stored_at timestamp, cell int, own boolean, rank int, medoid int, vec_ string, h1 int"


@pytest.fixture(scope="module")
def model(spark, sf):
    return spark.read.parquet(f"{sf}/lsh_model.parquet")


def frame(spark, rows):
    """Rows ``(seq, typeno, featno, vec)`` with the other columns, some of clashing names."""
    return spark.createDataFrame([(s, t, f, None if v is None else [None if x is None else float(x) for x in v], None, None, 1, True, 2, 3, "x", 4) for s, t, f, v in rows], SCHEMA)


def groups(seed, sizes, types=(1, 2), alone=150, spread=0.3):
    """Groups of vectors near a common one, in each type, and unrelated vectors; shuffled numbers and lengths."""
    r = np.random.default_rng(seed)
    rows, no = [], iter(r.permutation(100_000)[:20_000])
    for t in types:
        for size in sizes:
            c = r.standard_normal(64)
            c /= np.linalg.norm(c)
            for _ in range(size):
                x = c + r.standard_normal(64) * spread / 8
                rows.append((len(rows), t, int(next(no)), x * r.choice([1e-4, 1, 50])))
        rows.extend((len(rows) + i, t, int(next(no)), r.standard_normal(64)) for i in range(alone))
    return rows


def unit_rows(rows):
    by = {}
    for s, t, f, v in rows:
        by.setdefault(t, {})[f] = np.asarray(v, dtype=np.float32).astype(np.float64)
    return {t: (np.array(sorted(d)), np.stack([d[f] / np.linalg.norm(d[f]) for f in sorted(d)])) for t, d in by.items()}


def brute_clusters(rows):
    out = {}
    for t, (ids, x) in unit_rows(rows).items():
        near = x @ x.T >= 0.8
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            out[t, int(ids[i])] = int(ids[np.argmax(near[i])])
    return out


def brute_nearest(rows, k, least):
    out = {}
    for t, (ids, x) in unit_rows(rows).items():
        cos = np.round(x @ x.T, 6)
        np.fill_diagonal(cos, -9)
        for i in range(len(ids)):
            out[t, int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -cos[i]))[:k] if cos[i, j] >= least and j != i]
    return out


def found_clusters(spark, rows, model):
    return {(r.typeno, r.featno): r.cluster_featno for r in K.clusters(frame(spark, rows), model).collect()}


def test_clusters_match_brute_force(spark, model):
    rows = groups(1, [2, 2, 3, 5, 8, 40, 200])
    want, got = brute_clusters(rows), found_clusters(spark, rows, model)
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.98 and set(got) <= set(want)


def test_clusters_over_many_cells(spark, model, monkeypatch):
    """Small cells, so that a large group spans several and is joined through shared vectors."""
    rows = groups(2, [2, 3, 400, 30], types=(7,), alone=100)
    fit = K.fit_cells
    monkeypatch.setattr(K, "fit_cells", lambda df, **kw: fit(df, cell=60))
    want, got = brute_clusters(rows), found_clusters(spark, rows, model)
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.97


def test_a_third_are_copies(spark, model):
    rows = groups(3, [2, 4, 9], types=(1,), alone=40)
    v = rows[0][3]
    rows += [(9000 + i, 1, 200_000 + i, v) for i in range(300)]
    lone = np.random.default_rng(8).standard_normal(64)
    rows += [(9900 + i, 2, 5 + i, lone) for i in range(40)] + [(9990, 3, 1, lone)]
    assert found_clusters(spark, rows, model) == brute_clusters(rows)
    got = {}
    for r in N.nearest(frame(spark, rows), k=10, least=0.8).collect():
        got.setdefault((r.typeno, r.featno), {})[r.rank] = r.other
    want = {k: v for k, v in brute_nearest(rows, 10, 0.8).items() if v}
    assert {k: [d[i] for i in sorted(d)] for k, d in got.items()} == want


def test_current_vectors_and_bad_input(spark, model):
    good = np.ones(64)
    rows = [
        (5, 1, 1, good), (9, 1, 1, None), (5, 1, 2, good), (9, 1, 2, good * 2), (9, 1, 2, good * 2), (1, 1, 3, good), (None, 1, 3, None),
        (1, 1, 4, []), (1, 1, 5, np.zeros(64)), (1, 1, 6, [float("nan")] * 64), (1, 1, 7, [float("inf")] + [1.0] * 63), (1, 1, 8, [None] + [1.0] * 63), (1, 1, 9, np.ones(63)), (1, None, 10, good), (1, 1, None, good),
        (2, 2, 1, good), (1, 1, 11, good * 1e-30), (1, 1, 12, good * 1e30),
    ]
    got = {(r.typeno, r.featno) for r in C.current_vectors(frame(spark, rows), C.usual_dim(frame(spark, rows))).collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (1, 11), (1, 12)}
    assert found_clusters(spark, rows, model) == {(1, 2): 2, (1, 3): 2, (1, 11): 2, (1, 12): 2}
    near = N.nearest(frame(spark, rows), k=2)
    assert {(r.featno, r.other) for r in near.collect()} == {(2, 3), (2, 11), (3, 2), (3, 11), (11, 2), (11, 3), (12, 2), (12, 3)}
    assert {tuple(r) for r in N.similar_pairs(near).collect()} == {(1, 2, 3), (1, 2, 11), (1, 3, 11), (1, 2, 12), (1, 3, 12)}


def test_empty(spark, model):
    none = frame(spark, [])
    assert K.clusters(none, model).count() == 0 and N.nearest(none).count() == 0 and K.described(K.clusters(none, model)).count() == 0
    one = frame(spark, [(1, 1, 1, np.ones(64))])
    assert K.clusters(one, model).count() == 0 and N.nearest(one).count() == 0


def test_described(spark, model):
    rows = groups(4, [6, 3], types=(1,), alone=5)
    found = K.clusters(frame(spark, rows), model)
    d = K.described(found, 2).collect()
    assert sorted(r.size for r in d) == [3, 3, 6, 6] and all(r.sim == 1.0 for r in d if r["rank"] == 1)
    assert {r.cluster_featno for r in d} == set(brute_clusters(rows).values())


def test_nearest_recall(spark):
    rows = groups(6, [3, 12, 60, 300], types=(1, 4), alone=200)
    for least, probes, margin in ((0.8, N.PROBES, N.MARGIN), (-1.0, 64, 0.6)):
        want = brute_nearest(rows, 10, least)
        got = {}
        for r in N.nearest(frame(spark, rows), k=10, least=least, probes=probes, margin=margin).collect():
            got.setdefault((r.typeno, r.featno), set()).add(r.other)
        hit = sum(len(got.get(k, set()) & set(v)) for k, v in want.items())
        assert hit / sum(map(len, want.values())) > 0.98
    some = N.nearest(frame(spark, rows), k=3, every=20)
    assert {r.featno for r in some.select("featno").distinct().collect()} == {f for _, _, f, _ in rows if f % 20 == 0}


def test_bounds_of_the_codes():
    r = np.random.default_rng(2)
    x = C.units(r.standard_normal((400, 64)) + 1.5)
    codes = N.Codes(x, N.rotation(64))
    est, err = codes.estimate(x[:100])
    off = np.abs(est - x[:100] @ x.T)
    assert (off <= err).mean() > 0.93 and np.abs((est - x[:100] @ x.T).mean()) < 0.01


def test_split_cells_give_the_same(spark, monkeypatch):
    rows = groups(7, [100], types=(1,), alone=80)
    whole = {tuple(r) for r in N.nearest(frame(spark, rows), least=0.8).select("featno", "other", "rank").collect()}
    fit = N.fit_cells
    monkeypatch.setattr(N, "fit_cells", lambda df, **kw: fit(df, largest=40))
    assert {tuple(r) for r in N.nearest(frame(spark, rows), least=0.8).select("featno", "other", "rank").collect()} == whole


def test_band_links_against_all_pairs():
    r = np.random.default_rng(3)
    x = C.units(np.repeat(r.standard_normal((30, 64)), 8, axis=0) + r.standard_normal((240, 64)) * 0.25)
    w = C.units(r.standard_normal((416, 64)))
    links = K.band_links(x, K.direction_sets(x, w), 832, 0.8)
    label = K.components(len(x), links)
    near = x @ x.T >= 0.8
    assert near[links[:, 0], links[:, 1]].all()
    assert (label == np.repeat(np.arange(30) * 8, 8)).mean() > 0.99


def test_split_loose():
    """A chain of directions: only neighbours are near; the middle one is the most central."""
    x = np.stack([[np.cos(a), np.sin(a)] for a in np.deg2rad([0, 30, 60, 90, 120])])
    links = np.array([[0, 1], [1, 2], [2, 3], [3, 4]])
    assert list(K.split_loose(x, links, 0.8)) == [0, 2, 2, 2, 4]
    chain = np.stack([[np.cos(a), np.sin(a)] for a in np.deg2rad(np.arange(8) * 30)])
    assert (K.split_loose(chain, np.stack([np.arange(7), np.arange(1, 8)], axis=1), 0.8) >= 0).all()


def test_medoid_is_the_most_central(spark, model, monkeypatch):
    """In one cell and over several, whatever links were found first."""
    for cell in (1200, 30):
        r = np.random.default_rng(12)
        c = r.standard_normal(64)
        x = c + r.standard_normal((60, 64)) * np.linspace(0.4, 0.02, 60)[:, None]
        rows = [(i, 1, i + 1, v) for i, v in enumerate(x)] + [(900 + i, 1, 900 + i, r.standard_normal(64)) for i in range(60)]
        fit = C.fit_cells
        monkeypatch.setattr(K, "fit_cells", lambda df, **kw: fit(df, cell=cell, **kw))
        u = unit_rows(rows)[1][1][:60]
        assert ((u @ u.T) >= 0.8).all()
        got = {(q.medoid, q.cluster_featno) for q in K.clusters(frame(spark, rows), model).where("featno <= 60").collect()}
        assert got == {(int(np.argmax(np.round((u @ u.T).mean(axis=1), 6))) + 1, 1)}


@pytest.mark.parametrize("dim", [16, 64, 300])
def test_any_number_of_components(spark, dim):
    r = np.random.default_rng(dim)
    x = np.repeat(C.units(r.standard_normal((60, dim))) * dim**0.5, 3, axis=0) + r.standard_normal((180, dim)) * 0.2
    rows = [(i, 1, i, v) for i, v in enumerate(x)] + [(500 + i, 1, 500 + i, r.standard_normal(dim - 1)) for i in range(20)]
    good = rows[:180]
    conf = create_config(f"vecdim={dim}")
    m = to_frame(spark, create_model(dim, conf.bits, conf.variations))
    assert found_clusters(spark, rows, m) == brute_clusters(good)
    got = {}
    for q in N.nearest(frame(spark, rows), k=4).collect():
        got.setdefault((q.typeno, q.featno), {})[q.rank] = q.other
    assert {k: [d[i] for i in sorted(d)] for k, d in got.items()} == brute_nearest(good, 4, -1.0)


def test_model_without_directions(spark):
    with pytest.raises(ValueError):
        K.clusters(frame(spark, [(1, 1, 1, np.ones(64))]), spark.createDataFrame([(0, None), (1, [0.0] * 64)], "row_no int, coeffs array<double>"))


def test_copies_ask_for_the_first_of_their_group(spark):
    """Only numbers divisible by 20 ask: some do by themselves, some through a copy of a smaller number."""
    rows = groups(13, [12, 5], types=(1,), alone=60)
    v, w = rows[0][3], rows[1][3]
    rows += [(7000, 1, 200_001, v), (7001, 1, 200_020, v), (7002, 1, 200_040, w)]
    want = {k: x for k, x in brute_nearest(rows, 5, -1.0).items() if k[1] % 20 == 0}
    got = {}
    for q in N.nearest(frame(spark, rows), k=5, every=20).collect():
        got.setdefault((q.typeno, q.featno), {})[q.rank] = q.other
    assert {k: [d[i] for i in sorted(d)] for k, d in got.items()} == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (102, 101), (7, 7), (None, 3), (200, 500)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100, 102: 100, 200: 200, 500: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("block", [1 << 15, 700])
def test_one_dense_group_over_many_cells(spark, monkeypatch, block):
    """A group of similar vectors in far more cells than a query visits, in one block and in several."""
    rows = groups(9, [1500, 4], types=(1,), alone=300, spread=0.2)
    fit = N.fit_cells
    monkeypatch.setattr(N, "fit_cells", lambda df, **kw: fit(df, cell=30))
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    want = {k: v for k, v in brute_nearest(rows, 10, 0.8).items() if v}
    got = {}
    for r in N.nearest(frame(spark, rows), least=0.8).collect():
        got.setdefault((r.typeno, r.featno), {})[r.rank] = r.other
    assert {k: [d[i] for i in sorted(d)] for k, d in got.items()} == want


@pytest.mark.parametrize("operator, sample", [("clusters", 60_000), ("nearest", 500)])
def test_cells_beside_many_copies(spark, model, monkeypatch, operator, sample):
    """A third of a type are copies of one vector: they neither fill the sample nor draw centroids."""
    r = np.random.default_rng(10)
    rows = groups(10, [60, 5, 3], types=(1,), alone=700)
    near = [(20_000 + i, 1, 300_000 + i, rows[0][3] / np.linalg.norm(rows[0][3]) + r.standard_normal(64) * 0.02) for i in range(60)]
    rows += near + [(30_000 + i, 1, 400_000 + i, rows[0][3]) for i in range(400)]
    fit, fitted, seen, units = C.fit_cells, [], [], C.units
    where = K if operator == "clusters" else N
    monkeypatch.setattr(where, "fit_cells", lambda df, **kw: fitted.append(fit(df, cell=30, sample=sample, **kw)) or fitted[-1])
    monkeypatch.setattr(C, "units", lambda v: seen.append(len(v)) or units(v))
    if operator == "clusters":
        want, got = brute_clusters(rows), found_clusters(spark, rows, model)
        assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.98
    else:
        want = brute_nearest(rows, 10, 0.8)
        got = {(x.typeno, x.featno, x.other) for x in N.nearest(frame(spark, rows), least=0.8).collect()}
        assert got == {(*k, o) for k, v in want.items() for o in v}
    c = fitted[0].centroids[1]
    assert len(c) > 8 and len(np.unique(np.round(c, 6), axis=0)) == len(c) and 400 < sum(seen) <= sample


def test_nearest_of_unrelated_vectors_over_many_cells(spark, monkeypatch):
    """A type of far more cells than probes: the ten best of unrelated vectors lie anywhere."""
    rows = groups(11, [3], types=(1,), alone=2000)
    fit = N.fit_cells
    monkeypatch.setattr(N, "fit_cells", lambda df, **kw: fit(df, cell=8))
    want = {k: v for k, v in brute_nearest(rows, 10, -1.0).items() if k[1] % 20 == 0}
    got = {}
    for r in N.nearest(frame(spark, rows), every=20, probes=64, margin=0.6).collect():
        got.setdefault((r.typeno, r.featno), {})[r.rank] = r.other
    assert {k: [d[i] for i in sorted(d)] for k, d in got.items()} == want


def test_the_end_of_a_chain_is_kept(spark, model):
    """Only neighbours of a chain a-b-c-d are similar: b takes a and c, and d, similar to c, is listed alone."""
    x = np.stack([[np.cos(a), np.sin(a)] for a in np.deg2rad([0, 30, 60, 90])])
    assert list(K.split_loose(x, np.array([[0, 1], [1, 2], [2, 3]]), 0.8)) == [1, 1, 1, 3]
    rows = [(i, 1, 10 + i, np.r_[v, np.zeros(62)]) for i, v in enumerate(x)] + [(9, 1, 20, np.r_[np.zeros(63), 1])]
    got = {(r.featno, r.cluster_featno, r.medoid) for r in K.clusters(frame(spark, rows), model).collect()}
    assert got == {(10, 10, 11), (11, 10, 11), (12, 10, 11), (13, 13, 13)}


@pytest.mark.parametrize("block", [1 << 15, 100])
def test_links_outside_the_visited_cells(spark, model, monkeypatch, block):
    """Pairs at the threshold whose vectors share no cell, in one block and in several: the exact pass links them."""
    r = np.random.default_rng(14)
    rows = groups(14, [150, 3], types=(1, 2), alone=100)
    for i in range(60):
        a, b = C.units(r.standard_normal((2, 64)))
        b = C.units((b - a * (a @ b))[None])[0]
        rows += [(9000 + 2 * i, 1, 200_000 + 2 * i, a), (9001 + 2 * i, 1, 200_001 + 2 * i, 0.801 * a + (1 - 0.801**2) ** 0.5 * b)]
    fit = C.fit_cells
    monkeypatch.setattr(K, "fit_cells", lambda df, **kw: fit(df, cell=20, **kw))
    monkeypatch.setattr(K, "BLOCK", block, raising=False)
    got = {(q.typeno, q.featno): q.cluster_featno for q in K.clusters(frame(spark, rows), model, probes=1, margin=0.0).collect()}
    assert got == brute_clusters(rows)


@pytest.mark.parametrize("block", [1 << 15, 12])
def test_loose_components_are_split_by_all_links(spark, monkeypatch, block):
    """Components whose members aren't all similar, in one task and in a step at a time, as if all links were known."""
    r = np.random.default_rng(15)
    x = np.repeat(C.units(r.standard_normal((4, 16))), 25, axis=0) + r.standard_normal((100, 16)) * 0.12
    rows = [(i, 1, i, v) for i, v in enumerate(x)]
    u = unit_rows(rows)[1][1]
    links = np.stack(np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.8, 1)), axis=1)
    medoid = K.split_loose(u, links, 0.8)
    assert len(np.unique(medoid)) > 6 and 20 < np.bincount(K.components(100, links)).max() < 50
    fit = C.fit_cells
    monkeypatch.setattr(K, "fit_cells", lambda df, **kw: fit(df, cell=20, **kw))
    monkeypatch.setattr(K, "BLOCK", block, raising=False)
    conf = create_config("vecdim=16")
    got = {q.featno: q.medoid for q in K.clusters(frame(spark, rows), to_frame(spark, create_model(16, conf.bits, conf.variations))).collect()}
    assert got == {i: int(m) for i, m in enumerate(medoid) if m >= 0}
