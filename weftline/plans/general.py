"""Queries over the link graph tables: orphan references, heavy keys, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import hierarchy, references, skew
from weftline.session import table


def _orphans(spark, sf_dir):
    return references.orphan_references(
        table(spark, sf_dir, "links"),
        table(spark, sf_dir, "pagedefs"),
        ref_id="link_id",
        sides=["src", "dst"],
        ts="seen_at",
        key="name",
        valid="defined",
        holds_from="defined_at",
        holds_to="removed_at",
    )


def p2_found(spark, sf_dir):
    return _orphans(spark, sf_dir).select(F.col("ref_id").alias("link_id"), "side")


def p2_orphans_by_month(spark, sf_dir):
    return references.orphans_by_period(_orphans(spark, sf_dir))


def p3_found(spark, sf_dir):
    return skew.heavy_pages(table(spark, sf_dir, "links")).select("side", "page")


def p3_page_stats(spark, sf_dir):
    return skew.page_stats(table(spark, sf_dir, "links"))


def _edges(spark, sf_dir):
    return hierarchy.current_edges(table(spark, sf_dir, "redirects"), "src", "dst", "declared_at", "redirect_id")


def p4_found(spark, sf_dir):
    return hierarchy.resolve(_edges(spark, sf_dir)).select("page", "root", "depth")


def p4_paths(spark, sf_dir):
    return hierarchy.resolve(_edges(spark, sf_dir), paths=True).select("page", "root", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendants(spark, sf_dir):
    return hierarchy.descendants(hierarchy.resolve(_edges(spark, sf_dir), paths=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphans_by_month, p3_found, p3_page_stats, p4_found, p4_paths, p4_descendants)}

_REFS = """
WITH l AS (SELECT DISTINCT link_id, src, dst, seen_at FROM links),
r AS (SELECT link_id, 'src' AS side, src AS page, seen_at FROM l WHERE src IS NOT NULL
      UNION ALL SELECT link_id, 'dst', dst, seen_at FROM l WHERE dst IS NOT NULL),
o AS (SELECT DISTINCT link_id, side, page, seen_at FROM r WHERE NOT EXISTS (
      SELECT 1 FROM pagedefs p WHERE p.defined AND p.name = r.page AND p.defined_at <= r.seen_at
      AND (p.removed_at IS NULL OR p.removed_at > r.seen_at)))
"""

_SIDES = """
WITH l AS (SELECT DISTINCT link_id, src, dst, cnt FROM links WHERE link_id IS NOT NULL),
s AS (SELECT 'src' AS side, src AS page, dst AS partner, cnt, link_id FROM l WHERE src IS NOT NULL
      UNION ALL SELECT 'dst', dst, src, cnt, link_id FROM l WHERE dst IS NOT NULL)
"""

_WALK = """
WITH RECURSIVE e AS (SELECT page, ptr FROM (
      SELECT src AS page, dst AS ptr, row_number() OVER (PARTITION BY src ORDER BY declared_at DESC NULLS LAST, redirect_id DESC NULLS LAST, dst DESC) AS rn
      FROM redirects WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) WHERE rn = 1),
w AS (SELECT page, ptr, 1 AS steps, [page, ptr] AS way, false AS ring FROM e
      UNION ALL
      SELECT w.page, e.ptr, w.steps + 1, list_append(w.way, e.ptr), list_contains(w.way, e.ptr) FROM w JOIN e ON w.ptr = e.page WHERE NOT w.ring),
g AS (SELECT page, bool_or(ring) AS ring, arg_max(ptr, steps) AS root, max(steps) AS depth, arg_max(way, steps) AS way FROM w GROUP BY page)
"""

ORACLE = {
    "p2_found": _REFS + "SELECT link_id, side FROM o",
    "p2_orphans_by_month": _REFS + "SELECT side, strftime(seen_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT page) AS pages FROM o GROUP BY 1, 2",
    "p3_found": _SIDES + "SELECT side, page FROM s GROUP BY side, page HAVING count(DISTINCT link_id) * 100 >= (SELECT count(DISTINCT link_id) FROM links)",
    "p3_page_stats": _SIDES + "SELECT side, page, count(*) AS n_rows, count(DISTINCT partner) AS partners, CAST(sum(cnt) AS DECIMAL(38,0)) AS cnt_sum FROM s GROUP BY side, page",
    "p4_found": _WALK + "SELECT page, CASE WHEN ring THEN '' ELSE root END AS root, CASE WHEN ring THEN -1 ELSE depth END AS depth FROM g",
    "p4_paths": _WALK + "SELECT page, CASE WHEN ring THEN '' ELSE root END AS root, CASE WHEN ring THEN -1 ELSE depth END AS depth, CASE WHEN NOT ring THEN array_to_string(way, ' > ') END AS path FROM g",
    "p4_descendants": _WALK + "SELECT w.ptr AS page, w.page AS descendant, w.steps FROM w JOIN g ON w.page = g.page WHERE NOT g.ring",
}
