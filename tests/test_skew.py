import random
from collections import Counter, defaultdict

from weftline.operators.skew import heavy_pages, page_stats, suspects

SCHEMA = "link_id bigint, src string, dst string, cnt bigint, page string, salt int, n bigint, side string, hot boolean"


def links(seed=1, n=4000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        src = "hub" if r.random() < 0.33 else r.choice([None, *[f"s{k}" for k in range(900)]])
        dst = "hub" if r.random() < 0.4 else r.choice([None, *[f"d{k}" for k in range(300)]])
        rows.append((i, src, dst, r.choice([None, 0, 3, 2**62]), "x", 1, 2, "y", True))
    return rows + r.sample(rows, 500) + [(None, "hub", "hub", 1, "x", 1, 2, "y", True)]


def test_page_stats_match_brute_force(spark):
    rows = links()
    want = defaultdict(lambda: [0, set(), None])
    for i, src, dst, cnt in {r[:4] for r in rows if r[0] is not None}:
        for side, page, other in (("src", src, dst), ("dst", dst, src)):
            if page is not None:
                w = want[side, page]
                w[0] += 1
                if other is not None:
                    w[1].add(other)
                if cnt is not None:
                    w[2] = (w[2] or 0) + cnt
    got = {(r.side, r.page): (r.n_rows, r.partners, r.cnt_sum) for r in page_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (n, len(p), s) for k, (n, p, s) in want.items()}


def test_heavy_pages(spark):
    rows = links(2)
    ids = {r[0] for r in rows if r[0] is not None}
    count = Counter()
    for i, src, dst, _ in {r[:4] for r in rows if r[0] is not None}:
        count.update((s, p) for s, p in (("src", src), ("dst", dst)) if p is not None)
    want = {k: n for k, n in count.items() if n * 100 >= len(ids)}
    got = {(r.side, r.page): r.n for r in heavy_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and ("dst", "hub") in got


def test_threshold_is_inclusive(spark):
    rows = [(i, "a" if i == 0 else f"s{i}", None, 1, None, None, None, None, None) for i in range(100)]
    assert heavy_pages(spark.createDataFrame(rows, SCHEMA)).count() == 100
    rows.append((100, None, None, 1, None, None, None, None, None))
    assert heavy_pages(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert heavy_pages(none).count() == 0 and page_stats(none).count() == 0


def test_suspects_are_few_and_hold_the_hot_pages(spark):
    found = {(r.side, r.page) for r in suspects(spark.createDataFrame(links(3), SCHEMA)).collect()}
    assert {("src", "hub"), ("dst", "hub")} <= found and len(found) <= 400
