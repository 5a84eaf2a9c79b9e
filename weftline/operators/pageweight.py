"""Page weights of a link graph: redirects, in-link counts, PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.upsert import dense_numbers
from weftline.session import Cut

DAMPING, ITERATIONS = 0.85, 32


def link_counts(links: DataFrame) -> DataFrame:
    """Edges with their multiplicity: ``(src, dst, cnt)``; null ends and counts below 1 are left out."""
    ok = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("cnt") > 0))
    return ok.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def resolve_redirects(edges: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Edges whose undefined target has a redirect to a defined page point there, one step at most.

    ``pages`` has the defined names, ``redirects`` one row ``(page, ptr)`` for each source.
    """
    defined = pages.select(F.col("page").alias("dst"), F.lit(True).alias("known")).distinct()
    usable = redirects.join(pages.select(F.col("page").alias("ptr")).distinct(), "ptr", "left_semi").join(pages.select("page"), "page", "left_anti")
    to = usable.select(F.col("page").alias("dst"), "ptr")
    out = edges.join(defined, "dst", "left").join(to, "dst", "left")
    return out.select("src", F.when(F.col("known"), F.col("dst")).otherwise(F.coalesce("ptr", "dst")).alias("dst"), "cnt")


def reduced_graph(edges: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Edges between defined pages after redirects, counts summed anew (P5)."""
    moved = resolve_redirects(edges, pages, redirects).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
    known = pages.select("page").distinct()
    return moved.join(known.withColumnRenamed("page", "src"), "src", "left_semi").join(known.withColumnRenamed("page", "dst"), "dst", "left_semi")


def redirect_lines(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Redirects from an undefined to a defined page: ``(page, ptr)``."""
    known = pages.select("page").distinct()
    return redirects.join(known, "page", "left_anti").join(known.withColumnRenamed("page", "ptr"), "ptr", "left_semi").select("page", "ptr")


def inlink_weights(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct pages that link to a page, divided by the number of pages: ``(page, weight)``."""
    n = pages.select("page").distinct().count()
    count = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("n"))
    return pages.select("page").distinct().join(count, "page", "left").select("page", (F.coalesce("n", F.lit(0)) / F.lit(n)).alias("weight"))


def pagerank(edges: DataFrame, pages: DataFrame, *, iterations: int = ITERATIONS, damping: float = DAMPING, cut_every: int = 4) -> DataFrame:
    """``(page, weight)`` after a fixed number of rounds, from equal weights.

    A page passes its weight on in proportion to the counts of its links. What a page without links holds isn't
    passed on, so that the sum of weights falls. Pages are numbered densely. The edges lie partitioned by source; a
    round joins the weights with them where they lie and sums by target, with partial sums before the only shuffle,
    so that a page with very many links in is no hot spot. Every few rounds the weights are written to the shared
    folder; what an executor held of the edges is read again from there. An empty graph gives an empty result.
    """
    spark = edges.sparkSession
    cut = Cut(spark, "rank")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cut.keep(dense_numbers(cut, pages.select("page").distinct(), "page", [], 0, "id"))
    n = ids.count()
    if not n:
        return ids.select("page", F.lit(0.0).alias("weight"))
    out = edges.groupBy("src").agg(F.sum("cnt").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("cnt") / F.col("total")).alias("share"))
    named = shares.join(ids.select(F.col("page").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("page").alias("dst"), F.col("id").alias("d")), "dst")
    graph = cut.keep(named.select("s", "d", "share")).repartition(parts, "s").persist(StorageLevel.MEMORY_AND_DISK)
    rest = (1.0 - damping) / n
    by_id = ids.select("id").repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    graph.count(), by_id.count()  # their partitioning counts in later plans only once they are there
    base = by_id.select("id", F.lit(0.0).alias("got"))
    rank = by_id.select("id", F.lit(1.0 / n).alias("weight"))
    held = None
    for i in range(1, iterations + 1):
        # both sides lie partitioned by the page: no exchange but that of the sums
        sent = graph.join(rank.hint("shuffle_hash"), F.col("s") == F.col("id")).select(F.col("d").alias("id"), (F.col("weight") * F.col("share")).alias("got"))
        rank = sent.unionByName(base).groupBy("id").agg((F.sum("got") * damping + rest).alias("weight"))
        if i % cut_every == 0 and i < iterations:
            rank, old = cut.keep(rank), held
            if old is not None:
                cut.drop(old)
            held = rank
    out = cut.keep(rank.join(ids, "id").select("page", "weight"))
    graph.unpersist()
    by_id.unpersist()
    return out


def log_scaled(weights: DataFrame) -> DataFrame:
    """``log10(weight * pages + 1)``."""
    n = weights.count()
    return weights.withColumn("weight", F.log10(F.col("weight") * n + 1))


def normalized(weights: DataFrame, top: int) -> DataFrame:
    """Weights as integers from 0 to ``top``, which the largest gets (P9); all 0 if no weight is above 0."""
    most = weights.agg(F.max("weight")).first()[0] or 0.0
    part = F.greatest(F.col("weight"), F.lit(0.0)) / F.lit(most) * top if most > 0 else F.lit(0.0)
    return weights.withColumn("weight", F.floor(part).cast("bigint"))


def page_weights(edges: DataFrame, pages: DataFrame, redirects: DataFrame, *, rank: bool = True, iterations: int = ITERATIONS, damping: float = DAMPING, log: bool = False, norm: int | None = None) -> DataFrame:
    """The whole run with its options (P10): reduced graph, PageRank or in-link weight, scale, normalisation."""
    cut = Cut(edges.sparkSession, "graph")
    graph = cut.keep(reduced_graph(edges, pages, redirects))
    weights = pagerank(graph, pages, iterations=iterations, damping=damping) if rank else inlink_weights(graph, pages)
    if log or norm is not None:
        weights = cut.keep(weights)
    weights = log_scaled(weights) if log else weights
    return normalized(weights, norm) if norm is not None else weights
