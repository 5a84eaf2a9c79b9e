import datetime as dt
import random

import pytest

from weftline.operators.hierarchy import current_edges, descendants, resolve

ROWS = "redirect_id bigint, src string, dst string, declared_at timestamp, page string, ptr string, depth int"


def walk(parent):
    out = {}
    for p in parent:
        way, seen = [p], {p}
        while way[-1] in parent:
            nxt = parent[way[-1]]
            way.append(nxt)
            if nxt in seen:
                way = None
                break
            seen.add(nxt)
        out[p] = ("", -1, None) if way is None else (way[-1], len(way) - 1, way)
    return out


def forest(seed, n=400):
    r = random.Random(seed)
    parent = {}
    for i in range(n):
        if r.random() < 0.9:
            parent[f"n{i}"] = "root" if r.random() < 0.3 else f"n{r.randrange(i + 1, i + 12)}"
    for k, size in enumerate((2, 3, 7, 40)):  # rings and what leads into them
        for i in range(size):
            parent[f"r{k}_{i}"] = f"r{k}_{(i + 1) % size}"
        for i in range(25):
            parent[f"l{k}_{i}"] = f"l{k}_{i + 1}" if i < 24 else f"r{k}_0"
    return parent


@pytest.mark.parametrize(("seed", "split"), [(1, 8), (3, 1000), (4, 1)])
def test_forests_with_rings(spark, seed, split):
    parent = forest(seed)
    edges = spark.createDataFrame(list(parent.items()), "page string, ptr string")
    want = walk(parent)
    rows = resolve(edges, split=split, paths=True).collect()
    assert {r.page: (r.root, r.depth) for r in rows} == {p: w[:2] for p, w in want.items()}
    assert len(rows) == len(want)
    assert {r.page: r.path for r in rows} == {p: w[2] for p, w in want.items()}


def test_long_chain_and_large_ring(spark):
    parent = {f"c{i:05d}": f"c{i + 1:05d}" for i in range(3000)} | {f"q{i}": f"q{(i + 1) % 1500}" for i in range(1500)}
    got = {r.page: (r.root, r.depth) for r in resolve(spark.createDataFrame(list(parent.items()), "page string, ptr string")).collect()}
    assert got["c00000"] == ("c03000", 3000) and got["c02999"] == ("c03000", 1) and got["q7"] == ("", -1)
    assert len(got) == 4500


def test_descendants(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x")], "page string, ptr string")
    got = {tuple(r) for r in descendants(resolve(edges, paths=True)).collect()}
    assert got == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("c", "d", 1)}


def test_current_edges(spark):
    t = dt.datetime
    rows = [
        (1, "a", "b", t(2024, 1, 2)), (2, "a", "c", t(2024, 1, 1)), (1, "a", "b", t(2024, 1, 2)),  # the later one, not the larger id
        (3, "a", "a", t(2025, 1, 1)), (4, "a", None, t(2025, 1, 1)), (5, None, "b", t(2025, 1, 1)),
        (6, "d", "e", t(2024, 1, 1)), (7, "d", "f", t(2024, 1, 1)), (8, "g", "h", None), (9, "g", "i", t(2020, 1, 1)), (10, "j", "k", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ROWS)
    got = {r.page: r.ptr for r in current_edges(df, "src", "dst", "declared_at", "redirect_id").collect()}
    assert got == {"a": "b", "d": "f", "g": "i", "j": "k"}


def test_empty(spark):
    none = spark.createDataFrame([], "page string, ptr string")
    assert resolve(none).count() == 0 and descendants(resolve(none, paths=True)).count() == 0
