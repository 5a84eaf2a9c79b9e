"""Latest rows of keys and dense numbers for names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import Cut


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row of each key with the largest ``order`` columns: one aggregation with partial results, no window.

    Ties are broken by the values themselves, so that the result doesn't depend on the order of rows. Nulls order
    lowest; rows with a null key are left out.
    """
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    top = known.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("m"))
    return top.select(*keys, *[F.col(f"m.{v}").alias(v) for v in values])


def current_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(typeno, featno, vec)`` of the latest row of each key, if its vector is usable.

    Usable is a vector of ``dim`` finite components that aren't all zero; otherwise the key has no vector.
    """
    best = latest(vectors.select("typeno", "featno", "seq", "vec"), ["typeno", "featno"], ["seq"], ["seq", "vec"]).drop("seq")
    x = F.col("vec")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return best.where((F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0))


def dense_numbers(cut: Cut, names: DataFrame, name: str, order: list[str], start: int, out: str) -> DataFrame:
    """``names`` with the numbers ``start + 1, start + 2, ...`` in the order of ``order`` and ``name``.

    Rows are sorted into ranges and numbered within each; the ranges' sizes, one row for each partition, give the
    offsets. No task sees all rows.
    """
    parts = names.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = cut.keep(names.repartitionByRange(int(parts), *order, name).withColumn("pid", F.spark_partition_id()))
    sizes = sorted((r["pid"], r["count"]) for r in placed.groupBy("pid").count().collect())
    at, offsets = start, {}
    for pid, n in sizes:
        offsets[pid] = at
        at += n
    if not offsets:
        return placed.drop("pid").withColumn(out, F.lit(None).cast("int"))
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("pid")]
    within = F.row_number().over(Window.partitionBy("pid").orderBy(*order, name))
    return placed.withColumn(out, (shift + within).cast("int")).drop("pid")


def encode_names(cut: Cut, known: DataFrame, seen: DataFrame, name: str, number: str, order: str) -> DataFrame:
    """The dictionary ``(number, name)`` after a commit: known numbers stay, new names follow in first-seen order (T5)."""
    known = known.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(number).alias(number))
    new = seen.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("first_seen")).join(known, name, "left_anti")
    last = known.agg(F.max(number)).first()[0] or 0
    added = dense_numbers(cut, new, name, ["first_seen"], last, number)
    return known.select(number, name).unionByName(added.select(number, name))
