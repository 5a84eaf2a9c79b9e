import math

import pytest

from weftline.operators import pageweight as P
from weftline.sources import linkfile

EDGES = "src string, dst string, cnt bigint"


def test_golden_pagerank(spark):
    links = [("A", x) for x in "BCD"] + [("B", x) for x in "ACD"] + [("C", x) for x in "ABD"] + [("D", x) for x in "ABCE"]
    edges = spark.createDataFrame([(a, b, 1) for a, b in links], EDGES)
    pages = spark.createDataFrame([(p,) for p in "ABCDE"], "page string")
    got = {r.page: r.weight for r in P.pagerank(edges, pages, iterations=30).collect()}
    want = {"A": 0.143994, "B": 0.143994, "C": 0.144, "D": 0.152406, "E": 0.0623895}
    assert all(abs(got[p] - w) < 1e-4 for p, w in want.items()) and abs(sum(got.values()) - 0.6468) < 1e-3


def parsed(spark, tmp_path, text):
    (tmp_path / "links.txt").write_text(text, encoding="utf-8")
    rules = linkfile.read_rules(spark, str(tmp_path / "links.txt"))
    return rules, *linkfile.graph(linkfile.rule_targets(rules))


def test_link_file(spark, tmp_path):
    rules, pages, edges, moved = parsed(spark, tmp_path, "* A = B C ;\n* B = -> C ;\n* C =\n A A\tB ;\n* é_1 = A ;")
    assert {r.page for r in pages.collect()} == {"A", "C", "é_1"}
    assert {(r.src, r.dst): r.cnt for r in edges.collect()} == {("A", "B"): 1, ("A", "C"): 1, ("C", "A"): 2, ("C", "B"): 1, ("é_1", "A"): 1}
    assert [tuple(r) for r in moved.collect()] == [("B", "C")]
    reduced = {(r.src, r.dst): r.cnt for r in P.reduced_graph(edges, pages, moved).collect()}
    assert reduced == {("A", "C"): 2, ("C", "A"): 2, ("C", "C"): 1, ("é_1", "A"): 1}
    assert [tuple(r) for r in P.redirect_lines(pages, moved).collect()] == [("B", "C")]


def test_link_file_problems(spark, tmp_path):
    rules, pages, edges, moved = parsed(spark, tmp_path, "* A = B ; * = C ; A = B ; * X = B! ; * D = -> -> E ; * F = -> ; * D = -> G ; * H = -> H ; * I = - > J ;  \n")
    assert {r.problem for r in rules.collect()} == {None, "no name", "not a declaration", "illegal character"}
    assert {r.page for r in pages.collect()} == {"A"} and [tuple(r) for r in moved.collect()] == [("D", "G")]


def test_link_file_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "ж", 1)], EDGES)
    moved = spark.createDataFrame([("x", "a")], "page string, ptr string")
    linkfile.rule_text(edges, moved).write.text(str(tmp_path / "out"))
    _, e, m = linkfile.graph(linkfile.rule_targets(linkfile.read_rules(spark, str(tmp_path / "out"))))
    assert sorted(map(tuple, e.collect())) == [("a", "b", 3), ("b", "ж", 1)] and [tuple(r) for r in m.collect()] == [("x", "a")]


def test_weights_and_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B", 5), ("C", "B", 1), ("B", "A", 1)], EDGES)
    pages = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "page string")
    none = spark.createDataFrame([], "page string, ptr string")
    got = {r.page: r.weight for r in P.page_weights(edges, pages, none, rank=False).collect()}
    assert got == {"A": 1 / 3, "B": 2 / 3, "C": 0}
    log = {r.page: r.weight for r in P.page_weights(edges, pages, none, rank=False, log=True).collect()}
    assert abs(log["B"] - math.log10(3)) < 1e-12
    norm = P.page_weights(edges, pages, none, rank=False, log=True, norm=100)
    assert {r.page: r.weight for r in norm.collect()} == {"A": 63, "B": 100, "C": 0}
    linkfile.write_weights(norm, str(tmp_path / "w"))
    linkfile.write_redirects(spark.createDataFrame([("x", "A")], "page string, ptr string"), str(tmp_path / "r"))
    lines = sorted(line for p in (tmp_path / "w").glob("*.csv") for line in p.read_text().splitlines())
    assert lines == ["A\t63", "B\t100", "C\t0"]
    assert [line for p in (tmp_path / "r").glob("*.csv") for line in p.read_text().splitlines()] == ["x\tA"]


def test_empty_graph(spark):
    edges, pages, moved = spark.createDataFrame([], EDGES), spark.createDataFrame([], "page string"), spark.createDataFrame([], "page string, ptr string")
    assert P.page_weights(edges, pages, moved).count() == 0
    one = spark.createDataFrame([("A",)], "page string")
    assert [(r.page, round(r.weight, 6)) for r in P.page_weights(edges, one, moved).collect()] == [("A", 0.15)]


@pytest.mark.parametrize("bad", [(None, "B", 1), ("A", None, 1), ("A", "B", 0), ("A", "B", None)])
def test_links_that_do_not_count(spark, bad):
    df = spark.createDataFrame([bad, ("A", "B", 2), ("A", "B", 3)], EDGES)
    assert [tuple(r) for r in P.link_counts(df).collect()] == [("A", "B", 5)]
