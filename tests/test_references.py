import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.references import orphan_references, orphans_by_period

LINKS = "link_id bigint, src string, dst string, cnt bigint, seen_at timestamp_ntz, loaded_at timestamp_ntz, side string, page string"
DEFS = "page_id bigint, name string, defined boolean, defined_at timestamp_ntz, removed_at timestamp_ntz, rng int, salt string"


def day(n, us=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, microseconds=us)


def run(links, defs, **kw):
    return orphan_references(links, defs, ref_id="link_id", sides=["src", "dst"], ts="seen_at", key="name", valid="defined", holds_from="defined_at", holds_to="removed_at", **kw)


def brute(links, defs):
    out = set()
    for i, src, dst, _, seen, *_ in links:
        for side, page in (("src", src), ("dst", dst)):
            if page is None:
                continue
            held = seen is not None and any(d[2] and d[1] == page and d[3] is not None and d[3] <= seen and (d[4] is None or d[4] > seen) for d in defs)
            if not held:
                out.add((i, side))
    return out


def random_tables(seed, n=3000):
    r = random.Random(seed)
    names = [f"p{i}" for i in range(120)] + ["P1", "p1 ", "", "é", "é", "ж"]
    defs = []
    for i in range(400):
        a = r.randrange(0, 200)
        b = r.choice([None, a, a + r.randrange(-3, 90)])
        defs.append((i, r.choice([*names, None]), r.choice([True, True, True, False, None]), None if r.random() < 0.03 else day(a, r.choice([0, 1])), None if b is None else day(b), 1, "x"))
    links = []
    for i in range(n):
        seen = None if r.random() < 0.02 else day(r.randrange(0, 220), r.choice([0, 1, -1]))
        hot = r.random() < 0.35
        links.append((i, r.choice([*names, None]), "p7" if hot else r.choice([*names, None]), r.choice([None, 0, 5]), seen, None, "s", "t"))
    return links + r.sample(links, min(100, n)), defs + r.sample(defs, 30)


@pytest.mark.parametrize("rows_per_range", [50_000, 150])
def test_random_tables(spark, rows_per_range):
    links, defs = random_tables(rows_per_range)
    out = run(spark.createDataFrame(links, LINKS), spark.createDataFrame(defs, DEFS), rows_per_range=rows_per_range).collect()
    got = [(r.ref_id, r.side) for r in out]
    assert len(got) == len(set(got))
    assert set(got) == brute(links, defs)
    assert all((r.period is None) == (links[r.ref_id][4] is None) for r in out)


def test_boundaries(spark):
    defs = [(1, "a", True, day(31), day(60), 1, ""), (2, "a", True, day(60), day(61), 1, ""), (3, "b", True, day(40), day(40), 1, ""), (4, "c", True, day(0), day(1), 1, ""), (5, "c", True, day(5), None, 1, "")]
    times = {1: ("a", day(31)), 2: ("a", day(31, -1)), 3: ("a", day(60)), 4: ("a", day(61, -1)), 5: ("a", day(61)), 6: ("b", day(40)), 7: ("c", day(1)), 8: ("c", day(5)), 9: ("c", day(9000))}
    links = [(i, p, None, 1, t, t, "", "") for i, (p, t) in times.items()]
    got = {r.ref_id for r in run(spark.createDataFrame(links, LINKS), spark.createDataFrame(defs, DEFS)).collect()}
    assert got == {2, 5, 6, 7}


def test_empty_tables(spark):
    links, defs = random_tables(5, 40)
    none_l, none_d = spark.createDataFrame([], LINKS), spark.createDataFrame([], DEFS)
    assert run(none_l, none_d).count() == 0
    assert run(none_l, spark.createDataFrame(defs, DEFS)).count() == 0
    got = run(spark.createDataFrame(links, LINKS), none_d)
    assert {(r.ref_id, r.side) for r in got.collect()} == brute(links, [])


def test_counts_by_period(spark):
    links, defs = random_tables(9)
    found = run(spark.createDataFrame(links, LINKS), spark.createDataFrame(defs, DEFS))
    rows = orphans_by_period(found).collect()
    assert sum(r.orphans for r in rows) == len(brute(links, defs))
    assert found.where(F.col("period").isNull()).count() == sum(r.orphans for r in rows if r.month is None)


def test_large_ids_beside_a_null(spark):
    """Ids above 2**53 stay apart in a range that also holds a null id; a null id is listed once for each key."""
    big = 2**60
    links = [(big + i, "gone", None, 1, day(1), day(1), "", "") for i in range(4)] + [(None, p, None, 1, day(1), day(1), "", "") for p in ("gone", "gone", "lost")]
    got = run(spark.createDataFrame(links, LINKS), spark.createDataFrame([], DEFS)).collect()
    assert sorted((r.ref_id or 0, r.side, r.page) for r in got) == [(0, "src", "gone"), (0, "src", "lost"), *((big + i, "src", "gone") for i in range(4))]
