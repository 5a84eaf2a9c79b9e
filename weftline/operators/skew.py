"""Per-key results without long tasks: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results per heavy key. The salt is a hash of the row and not a random number: a task that runs again
#: after the loss of an executor then sends its rows to the same place.
SALTS = 64


def distinct_links(links: DataFrame) -> DataFrame:
    """Links by their content; rows delivered again count once. Rows without ``link_id`` are no links."""
    return links.where(F.col("link_id").isNotNull()).select("link_id", "src", "dst", "cnt").distinct()


def by_side(links: DataFrame) -> DataFrame:
    """One row for each link and side: ``(side, page, partner, cnt, link_id)``; rows without page are left out."""
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src").alias("page"), F.col("dst").alias("partner")),
        F.struct(F.lit("dst").alias("side"), F.col("dst").alias("page"), F.col("src").alias("partner")),
    )
    return links.select("link_id", "cnt", F.explode(sides).alias("s")).select("s.side", "s.page", "s.partner", "cnt", "link_id").where(F.col("page").isNotNull())


def suspects(links: DataFrame, share: int = 100, rows: int = 100_000) -> DataFrame:
    """Pages worth a salt: ``(side, page)``, at most ``4 * share`` of them.

    They are those with half the share of a sample of about ``rows`` rows. The sample decides only where rows are
    sent, never what is counted: a key that it misses is aggregated without salt.
    """
    n = links.count()
    some = by_side(links.sample(fraction=min(1.0, rows / max(1, n)), seed=7))
    drawn = min(n, rows)
    return some.groupBy("side", "page").count().where(F.col("count") * share * 2 >= F.lit(drawn)).orderBy(F.desc("count"), "side", "page").limit(4 * share).select("side", "page", F.lit(True).alias("hot"))


def salted(rows: DataFrame, hot: DataFrame, by: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` with a column ``salt``: a hash of the columns ``by`` for hot keys, 0 for all others.

    ``hot`` is broadcast; its size is bounded by :func:`suspects`.
    """
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return rows.join(F.broadcast(hot), ["side", "page"], "left").withColumn("salt", spread).drop("hot")


def heavy_pages(links: DataFrame, share: int = 100, salts: int = SALTS) -> DataFrame:
    """Pages that stand on a side in at least one in ``share`` of all distinct links: ``(side, page, n BIGINT)``.

    Null is no page; links whose sides are both null still count in the total; an empty table has no heavy pages.
    At most ``share`` pages per side can qualify, so the result may be broadcast.
    """
    known = links.where(F.col("link_id").isNotNull())
    total = known.agg(F.count_distinct("link_id")).first()[0]
    once = known.select("link_id", "src", "dst").distinct().withColumn("cnt", F.lit(None).cast("bigint"))
    rows = salted(by_side(once), suspects(known, share), ["link_id"], salts)
    partial = rows.groupBy("side", "page", "salt").agg(F.count("*").alias("n"))
    return partial.groupBy("side", "page").agg(F.sum("n").alias("n")).where(F.col("n") * share >= F.lit(total))


def page_stats(links: DataFrame, share: int = 100, salts: int = SALTS) -> DataFrame:
    """Rows, distinct partners and sum of ``cnt`` per side and page, without a long task for a heavy page.

    Returns ``(side, page, n_rows BIGINT, partners BIGINT, cnt_sum DECIMAL(38,0))``. Hot pages get a salt from the
    partner (rows without one from their link), so that the partial numbers of distinct partners add up. A null
    ``cnt`` adds nothing; a page with only null counts has a null sum. Null partners aren't partners.
    """
    rows = by_side(distinct_links(links))
    lone = F.when(F.col("partner").isNull(), F.col("link_id"))
    rows = salted(rows.withColumn("lone", lone), suspects(links, share), ["partner", "lone"], salts)
    # stage 1: one row for each key, salt and partner, then for each key and salt
    pairs = rows.groupBy("side", "page", "salt", "partner").agg(F.count("*").alias("n_rows"), F.sum(F.col("cnt").cast("decimal(38,0)")).alias("cnt_sum"))
    partial = pairs.groupBy("side", "page", "salt").agg(F.sum("n_rows").alias("n_rows"), F.count("partner").alias("partners"), F.sum("cnt_sum").alias("cnt_sum"))
    # stage 2: merge the salts of a key
    return partial.groupBy("side", "page").agg(F.sum("n_rows").alias("n_rows"), F.sum("partners").alias("partners"), F.sum("cnt_sum").cast("decimal(38,0)").alias("cnt_sum"))
