"""Parent-child rows to full hierarchies: root, depth, path and descendants of every node, rings told apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Cut

#: One node in so many is a splitter. The longest walk between splitters grows with the logarithm of the nodes.
SPLIT = 8


def current_edges(rows: DataFrame, child: str, parent: str, at: str, row_id: str) -> DataFrame:
    """The edge of each child that counts: ``(page, ptr)``.

    Rows with a null side or with both sides equal are ignored and override nothing; of the others that with the
    latest ``at`` counts, ties go to the larger ``row_id``, then to the larger parent (byte order). A null ``at`` is
    older than any other.
    """
    ok = rows.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent)))
    newest = F.struct(F.col(at).alias("a"), F.col(row_id).alias("b"), F.col(parent).alias("c"))
    return ok.groupBy(F.col(child).alias("page")).agg(F.max(newest).alias("m")).select("page", F.col("m.c").alias("ptr"))


def is_splitter(page: Column, split: int = SPLIT) -> Column:
    return F.pmod(F.xxhash64(page), F.lit(split)) == 0


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Pointers followed in a round: a walk grows by one more than this many times.
JUMPS = 3


def _walk(cut: Cut, state: DataFrame, paths: bool) -> DataFrame:
    """Follows the pointers of unfinished rows until each is finished or known to end in a ring.

    ``state`` is ``(page, ptr, dist, done[, seg])``; a row is done if its pointer is a terminal. Returns the finished
    and unfinished rows with ``ring``.

    A round follows :data:`JUMPS` pointers, each as long as the walks of the round before, so that walks grow
    fourfold. An unfinished row has walked ``steps`` steps without meeting a terminal. Were it not bound for a ring,
    at least half as many rows would have been unfinished a round before; fewer of them mean that all are.
    """
    kept = cut.keep(state)
    done, active = [kept.where("done")], kept.where(~F.col("done"))
    steps, n = 1, active.count()
    while n:
        names = ["ptr", "dist", "done", *(["seg"] if paths else [])]
        known = _union([*done, active]).select(F.col("page").alias("at"), *[F.col(c).alias(f"n_{c}") for c in names])
        moved = active
        for _ in range(JUMPS):
            # finished rows wait under a key of their own, which spreads them and matches nothing
            key = F.when(F.col("done"), F.concat(F.lit("\0"), "page")).otherwise(F.col("ptr"))
            joined = moved.withColumn("key", key).join(known, F.col("key") == F.col("at"), "left")
            on = ~F.col("done") & F.col("at").isNotNull()
            moved = joined.select(
                "page",
                F.when(on, F.col("n_ptr")).otherwise(F.col("ptr")).alias("ptr"),
                F.when(on, F.col("dist") + F.col("n_dist")).otherwise(F.col("dist")).alias("dist"),
                # a pointer to a row that was left out before is bound for a ring; it is left out as well
                F.when(on, F.col("n_done")).when(F.col("done"), True).alias("done"),
                *([F.when(on, F.concat("seg", "n_seg")).otherwise(F.col("seg")).alias("seg")] if paths else []),
            ).where(F.col("done").isNotNull())
        kept = cut.keep(moved)
        done.append(kept.where("done"))
        active = kept.where(~F.col("done"))
        before, n, steps = n, active.count(), steps * (JUMPS + 1)
        if n and before < steps // 2:
            break
    return _union([*(d.withColumn("ring", F.lit(False)) for d in done), active.withColumn("ring", F.lit(True))])


def resolve(edges: DataFrame, *, paths: bool = False, split: int = SPLIT) -> DataFrame:
    """Root and depth of every page with an edge ``(page, ptr)``; each page has one edge.

    Returns ``(page, root, depth INT[, path ARRAY<STRING>])``. ``root`` is the last page reached, ``depth`` the steps
    to it, ``path`` the pages from the page to its root, both included. Pages on a ring or leading into one have
    the root ``''``, depth -1 and a null path. An empty table gives an empty result.

    Method. A hash chooses splitters. Every page walks to the next splitter or root; walks grow fourfold in a round,
    and only rows that haven't arrived are moved, a share that falls with each round. The splitters alone, one page in
    ``split``, form the reduced graph, which is solved in the same way with roots as terminals; then each page takes
    root, depth and path from its splitter. Rings without splitter are what the first walk can't finish, rings with
    splitters what the second can't. Rounds grow with the logarithm of the longest walk.
    """
    cut = Cut(edges.sparkSession, "walk")
    seg = ["seg"] if paths else []
    e = edges.select("page", "ptr")
    pages = e.select(F.col("page").alias("at"), F.lit(True).alias("inner"))
    # a page without edge is a root; hot roots stand on the larger side, which AQE may split
    linked = e.join(pages, F.col("ptr") == F.col("at"), "left").withColumn("at_root", F.col("inner").isNull())
    first = cut.keep(linked.select("page", "ptr", F.lit(1).alias("dist"), "at_root", (F.col("at_root") | is_splitter(F.col("ptr"), split)).alias("done"), *([F.array("ptr").alias("seg")] if paths else [])))
    roots = first.where("at_root").select(F.col("ptr").alias("root_page")).distinct()
    near = _walk(cut, first.drop("at_root"), paths)
    near = cut.keep(near.join(roots, F.col("ptr") == F.col("root_page"), "left").withColumn("at_root", F.col("root_page").isNotNull()).drop("root_page"))

    # the reduced graph: splitters with an edge, without those that found no terminal or point to such
    own = near.where(is_splitter(F.col("page"), split))
    lost = own.where("ring").select(F.col("page").alias("lost_page"))
    start = own.where(~F.col("ring")).join(lost, F.col("ptr") == F.col("lost_page"), "left_anti").withColumn("done", F.col("at_root"))
    far = _walk(cut, start.select("page", "ptr", "dist", "done"), False).where(~F.col("ring"))
    if paths:  # rings are set aside first, so that no path is carried round them
        sound = far.select("page")
        far = _walk(cut, start.join(sound, "page", "left_semi").select("page", "ptr", "dist", "done", "seg"), True)
    solved = far.select(F.col("page").alias("at"), F.col("ptr").alias("root"), F.col("dist").alias("more"), *[F.col(c).alias("then") for c in seg])

    plain, no_path = ~F.col("ring"), F.lit(None).cast("array<string>").alias("path")
    direct = near.where(plain & F.col("at_root")).select("page", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *[F.concat(F.array("page"), c).alias("path") for c in seg])
    via = near.where(plain & ~F.col("at_root")).join(solved, F.col("ptr") == F.col("at"), "left")
    via = via.select(
        "page",
        F.coalesce("root", F.lit("")).alias("root"),
        F.when(F.col("root").isNull(), F.lit(-1)).otherwise(F.col("dist") + F.col("more")).alias("depth"),
        *[F.when(F.col("root").isNotNull(), F.concat(F.array("page"), c, "then")).alias("path") for c in seg],
    )
    rings = near.where("ring").select("page", F.lit("").alias("root"), F.lit(-1).alias("depth"), *[no_path for _ in seg])
    return _union([direct, via, rings])


def descendants(resolved: DataFrame) -> DataFrame:
    """All pages below each page: ``(page, descendant, steps INT)``, one row for each pair, from paths.

    Rows and not lists, since a root may have any number of pages below it. Pages on rings have no row.
    """
    up = resolved.where(F.col("path").isNotNull()).select(F.col("page").alias("descendant"), F.posexplode("path").alias("steps", "page"))
    return up.where(F.col("steps") > 0).select("page", "descendant", "steps")
