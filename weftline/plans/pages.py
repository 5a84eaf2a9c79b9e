"""Queries over the link graph: page weights and link files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import hierarchy, pageweight
from weftline.session import shared_path, table
from weftline.sources import linkfile


def _edges(spark, sf_dir):
    return pageweight.link_counts(table(spark, sf_dir, "links").select("link_id", "src", "dst", "cnt").distinct())


def _pages(spark, sf_dir):
    """Pages that a row defines at any time."""
    return table(spark, sf_dir, "pagedefs").where(F.col("defined") & F.col("name").isNotNull()).select(F.col("name").alias("page")).distinct()


def _redirects(spark, sf_dir):
    return hierarchy.current_edges(table(spark, sf_dir, "redirects"), "src", "dst", "declared_at", "redirect_id")


def link_counts(spark, sf_dir):
    return _edges(spark, sf_dir)


def redirect_targets(spark, sf_dir):
    return pageweight.resolve_redirects(_edges(spark, sf_dir), _pages(spark, sf_dir), _redirects(spark, sf_dir)).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def reduced_graph(spark, sf_dir):
    return pageweight.reduced_graph(_edges(spark, sf_dir), _pages(spark, sf_dir), _redirects(spark, sf_dir))


def redirect_lines(spark, sf_dir):
    return pageweight.redirect_lines(_pages(spark, sf_dir), _redirects(spark, sf_dir))


def inlink_weight(spark, sf_dir):
    out = pageweight.page_weights(_edges(spark, sf_dir), _pages(spark, sf_dir), _redirects(spark, sf_dir), rank=False)
    return out.select("page", F.round("weight", 9).alias("weight"))


def _ranked(spark, sf_dir, **options):
    return pageweight.page_weights(_edges(spark, sf_dir), _pages(spark, sf_dir), _redirects(spark, sf_dir), **options)


def pagerank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("page", F.round("weight", 9).alias("weight"))


def pagerank_log(spark, sf_dir):
    return _ranked(spark, sf_dir, log=True).select("page", F.round("weight", 6).alias("weight"))


def pagerank_norm(spark, sf_dir):
    return _ranked(spark, sf_dir, log=True, norm=1000)


def _legal(name):
    return F.col(name).rlike(f"^{linkfile._NAME}+$")


def link_file_graph(spark, sf_dir):
    """Edges written as a link file, one occurrence for each link, and read back."""
    path = shared_path(spark, "links")
    ok = table(spark, sf_dir, "links").where("src is not null and dst is not null").select("link_id", "src", "dst").distinct()
    counts = ok.where(_legal("src") & _legal("dst")).groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    linkfile.rule_text(counts, _redirects(spark, sf_dir).where(_legal("page") & _legal("ptr"))).write.text(path)
    _, edges, moved = linkfile.graph(linkfile.rule_targets(linkfile.read_rules(spark, path)))
    return edges.unionByName(moved.select(F.col("page").alias("src"), F.col("ptr").alias("dst"), F.lit(-1).cast("bigint").alias("cnt")))


def weight_files(spark, sf_dir):
    """The command on a link file, its weights and redirects read back: in-link weights of the names that the file can hold."""
    src, out, moved = (shared_path(spark, k) for k in ("links", "weights", "redirects"))
    ok = table(spark, sf_dir, "links").where("src is not null and dst is not null").select("link_id", "src", "dst").distinct()
    counts = ok.where(_legal("src") & _legal("dst")).groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    linkfile.rule_text(counts, _redirects(spark, sf_dir).where(_legal("page") & _legal("ptr"))).write.text(src)
    cli.main(["pageweight", "--inlinks", "-r", moved, src, out])
    weights = spark.read.schema("page string, weight double").option("sep", "\t").csv(out).select("page", F.round("weight", 9).alias("weight"), F.lit(None).cast("string").alias("ptr"))
    return weights.unionByName(spark.read.schema("page string, ptr string").option("sep", "\t").csv(moved).withColumn("weight", F.lit(None).cast("double")))


QUERIES = {f.__name__: f for f in (link_counts, redirect_targets, reduced_graph, redirect_lines, inlink_weight, pagerank, pagerank_log, pagerank_norm, link_file_graph, weight_files)}

_BASE = """
l AS (SELECT DISTINCT link_id, src, dst, cnt FROM links),
e AS (SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS cnt FROM l WHERE src IS NOT NULL AND dst IS NOT NULL AND cnt > 0 GROUP BY src, dst),
p AS (SELECT DISTINCT name AS page FROM pagedefs WHERE defined AND name IS NOT NULL),
r AS (SELECT page, ptr FROM (SELECT src AS page, dst AS ptr, row_number() OVER (PARTITION BY src ORDER BY declared_at DESC NULLS LAST, redirect_id DESC NULLS LAST, dst DESC) AS rn
      FROM redirects WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) WHERE rn = 1),
m AS (SELECT e.src, CASE WHEN e.dst IN (SELECT page FROM p) THEN e.dst WHEN r.ptr IN (SELECT page FROM p) THEN r.ptr ELSE e.dst END AS dst, e.cnt FROM e LEFT JOIN r ON e.dst = r.page),
t AS (SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS cnt FROM m GROUP BY src, dst),
g AS (SELECT src, dst, cnt FROM t WHERE src IN (SELECT page FROM p) AND dst IN (SELECT page FROM p)),
n AS (SELECT count(*) AS n FROM p)
"""
_RANK = (
    "WITH RECURSIVE "
    + _BASE.strip()
    + """,
w AS (SELECT src, dst, cnt / sum(cnt) OVER (PARTITION BY src) AS share FROM g),
v AS (SELECT page, 1.0::DOUBLE / (SELECT n FROM n) AS weight, 0 AS i FROM p
      UNION ALL
      SELECT x.page, 0.85 * sum(x.got) + 0.15 / (SELECT n FROM n), any_value(x.i) + 1
      FROM (SELECT w.dst AS page, v.weight * w.share AS got, v.i FROM v JOIN w ON w.src = v.page UNION ALL SELECT page, 0, i FROM v) x WHERE x.i < 32 GROUP BY x.page),
f AS (SELECT page, weight FROM v WHERE i = 32)
"""
)

ORACLE = {
    "link_counts": "WITH " + _BASE + "SELECT * FROM e",
    "redirect_targets": "WITH " + _BASE + "SELECT * FROM t",
    "reduced_graph": "WITH " + _BASE + "SELECT * FROM g",
    "redirect_lines": "WITH " + _BASE + "SELECT page, ptr FROM r WHERE page NOT IN (SELECT page FROM p) AND ptr IN (SELECT page FROM p)",
    "inlink_weight": "WITH " + _BASE + "SELECT p.page, round(count(DISTINCT g.src) / (SELECT n FROM n), 9) AS weight FROM p LEFT JOIN g ON g.dst = p.page GROUP BY p.page",
    "pagerank": _RANK + "SELECT page, round(weight, 9) AS weight FROM f",
    "pagerank_log": _RANK + "SELECT page, round(log10(weight * (SELECT n FROM n) + 1), 6) AS weight FROM f",
    "pagerank_norm": _RANK + ", q AS (SELECT page, log10(weight * (SELECT n FROM n) + 1) AS weight FROM f) SELECT page, CAST(floor(greatest(weight, 0) / (SELECT max(weight) FROM q) * 1000) AS BIGINT) AS weight FROM q",
    "weight_files": r"""
WITH a AS (SELECT DISTINCT link_id, src, dst FROM links WHERE regexp_full_match(src, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') AND regexp_full_match(dst, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')),
r AS (SELECT page, ptr FROM (SELECT src AS page, dst AS ptr, row_number() OVER (PARTITION BY src ORDER BY declared_at DESC NULLS LAST, redirect_id DESC NULLS LAST, dst DESC) AS rn
      FROM redirects WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) WHERE rn = 1 AND regexp_full_match(page, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') AND regexp_full_match(ptr, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')),
p AS (SELECT DISTINCT src AS page FROM a),
m AS (SELECT DISTINCT a.src, CASE WHEN a.dst IN (SELECT page FROM p) THEN a.dst ELSE r.ptr END AS dst FROM a LEFT JOIN r ON r.page = a.dst)
SELECT p.page, round(count(m.src) / (SELECT count(*) FROM p), 9) AS weight, NULL AS ptr FROM p LEFT JOIN m ON m.dst = p.page GROUP BY p.page
UNION ALL SELECT page, NULL, ptr FROM r WHERE page NOT IN (SELECT page FROM p) AND ptr IN (SELECT page FROM p)""",
    "link_file_graph": r"""
WITH a AS (SELECT DISTINCT link_id, src, dst FROM links WHERE regexp_full_match(src, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') AND regexp_full_match(dst, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')),
r AS (SELECT page, ptr FROM (SELECT src AS page, dst AS ptr, row_number() OVER (PARTITION BY src ORDER BY declared_at DESC NULLS LAST, redirect_id DESC NULLS LAST, dst DESC) AS rn
      FROM redirects WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) WHERE rn = 1)
SELECT src, dst, count(*) AS cnt FROM a GROUP BY src, dst
UNION ALL SELECT page, ptr, -1 FROM r WHERE regexp_full_match(page, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') AND regexp_full_match(ptr, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')""",
}
