"""Orphan references: rows that point to records which did not exist when the reference was made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.bitmap import Bitmap
from weftline.session import Cut

#: Most partitions of the shuffle, unless the session has more; beyond it a task takes several ranges, one after the other.
MAX_TASKS = 20_000

_NEVER = np.iinfo(np.int64).max


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integers, 0 for nulls, and a mask of the nulls: an array with nulls would turn into floats."""
    return np.asarray(column.fill_null(0)).astype(np.int64), np.asarray(column.is_null())


def _micros(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 and a mask of the nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).view(pa.int64())
    null = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)).astype(np.int64), null


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each key with overlapping and touching ones joined, ordered by key and start."""
    keep = start < end
    order = np.lexsort((end[keep], start[keep], key[keep]))
    key, start, end = (a[keep][order] for a in (key, start, end))
    if not len(key):
        return key, start, end
    stamps = np.unique(np.r_[start, end])
    reach = np.maximum.accumulate(key * (len(stamps) + 1) + np.searchsorted(stamps, end)) - key * (len(stamps) + 1)
    new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > stamps[reach[:-1]])]
    at = np.flatnonzero(new)
    return key[at], start[at], stamps[reach[np.r_[at[1:] - 1, len(key) - 1]]]


def _covered(merged, key: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """Whether one of the key's intervals holds at ``ts`` (start inclusive, end exclusive)."""
    m_key, m_start, m_end = merged
    if not len(m_key):
        return np.zeros(len(key), dtype=bool)
    stamps = np.unique(np.r_[m_start, ts])
    width = len(stamps) + 1
    at = np.searchsorted(m_key * width + np.searchsorted(stamps, m_start), key * width + np.searchsorted(stamps, ts), side="right") - 1
    at0 = np.maximum(at, 0)
    return (at >= 0) & (m_key[at0] == key) & (ts < m_end[at0])


def _range_orphans(refs: pa.Table, defs: pa.Table) -> pa.Table:
    """The orphans of one key range: reference bits of each month AND NOT the parents' bits of that month."""
    out_schema = pa.schema([("ref_id", pa.int64()), ("side", pa.string()), ("page", pa.string()), ("period", pa.int32())])
    if not refs.num_rows:
        return out_schema.empty_table()
    n_defs = defs.num_rows
    names = pa.chunked_array([*defs["key"].chunks, *refs["key"].chunks], pa.string()).combine_chunks()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    codes = np.asarray(names.dictionary_encode().indices).astype(np.int64)  # the range's dictionary
    parent, ref = codes[:n_defs], codes[n_defs:]

    start, no_start = _micros(defs["holds_from"])
    end, no_end = _micros(defs["holds_to"])
    end[no_end] = _NEVER
    merged = _merged(parent[~no_start], start[~no_start], end[~no_start])

    ts, no_ts = _micros(refs["ts"])
    month = ts.astype("datetime64[us]").astype("datetime64[M]").astype(np.int64)
    orphan = no_ts.copy()  # nothing holds at an unknown time
    for m in np.unique(month[~no_ts]):
        rows = np.flatnonzero((month == m) & ~no_ts)
        lo, hi = (np.datetime64(int(k), "M").astype("datetime64[us]").astype(np.int64) for k in (m, m + 1))
        whole = Bitmap.of(merged[0][(merged[1] <= lo) & (merged[2] >= hi)])
        partly = Bitmap.of(merged[0][(merged[1] < hi) & (merged[2] > lo)]).and_not(whole)
        left = Bitmap.of(ref[rows]).and_not(whole)
        bits = np.zeros(len(names), dtype=np.int8)
        bits[left.and_not(partly).decode()] = 1  # no parent in the whole month
        bits[left.and_(partly).decode()] = 2  # a parent in part of it: the interval decides
        state = bits[ref[rows]]
        orphan[rows[state == 1]] = True
        check = rows[state == 2]
        orphan[check] = ~_covered(merged, ref[check], ts[check])

    hit = np.flatnonzero(orphan)
    ids, no_id = _numbers(refs["ref_id"])
    side = np.asarray(refs["side"])[hit]
    # references without an id are told apart by their keys
    keys = [ids[hit], no_id[hit], np.where(no_id, ref, 0)[hit], side]
    _, first = np.unique(np.rec.fromarrays(keys), return_index=True)
    hit = hit[np.sort(first)]
    found = refs.take(pa.array(hit))
    period = pa.array(month[hit].astype(np.int32), mask=no_ts[hit])
    return pa.table([found["ref_id"].cast(pa.int64()), found["side"].cast(pa.string()), found["key"].cast(pa.string()), period], schema=out_schema)


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_id: str,
    sides: list[str],
    ts: str,
    key: str,
    valid: str,
    holds_from: str,
    holds_to: str,
    rows_per_range: int = 50_000,
) -> DataFrame:
    """References of ``refs`` for which no valid row of ``parents`` holds at their time.

    Returns ``(ref_id BIGINT, side STRING, page STRING, period INT)``, each reference once; ``period`` is the month
    of ``ts`` counted from January 1970.

    Plan. Keys are hashed into ranges of about ``rows_per_range`` references; a range that a hot key makes larger is
    split by a salt of the reference and the range's few parents are repeated for each salt, so that no task holds
    an unbounded group. The sizes of ranges are counted first, with partial counts; those to be split are a written
    table that both sides are joined with (broadcast by Spark if it is small), and nothing is sent to the driver.
    References are shuffled once, into as many partitions as there are groups. In a range the keys are coded as integers by a dictionary,
    and for each month the bitmap of referenced codes AND NOT that of codes defined all month leaves the
    candidates; those defined for a part of the month are decided by their intervals.

    Edge cases. Null keys are no references. A null ``ref_id`` is a reference like others (repeats of it within one
    key merge). A reference without time is an orphan with a null period. Parents with ``valid`` null or false, a
    null key or a null start define nothing; a null end holds for ever; an end before the start holds never. Keys
    compare byte by byte. Repeated rows count once; empty inputs give an empty result; other columns are ignored.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"`{s}`").cast("string").alias("key")) for s in sides])
    # the filter keeps generated rows without a key from the shuffle
    long = refs.select(F.col(f"`{ref_id}`").cast("bigint").alias("ref_id"), F.col(f"`{ts}`").alias("ts"), F.explode(pairs).alias("p")).select("ref_id", "ts", "p.side", "p.key").where(F.col("key").isNotNull())
    defs = parents.where(F.col(f"`{valid}`") & F.col(f"`{key}`").isNotNull() & F.col(f"`{holds_from}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{holds_from}`").alias("holds_from"), F.col(f"`{holds_to}`").alias("holds_to")
    )
    spark = refs.sparkSession
    total = refs.count() * len(sides)
    ranges = max(1, -(-total // rows_per_range))
    of_key = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")

    cut = Cut(spark, "ranges")
    most = 2 * rows_per_range
    counts = long.groupBy(of_key.alias("rng")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = cut.keep(counts.select("rng", F.ceil(F.col("n") / most).cast("int").alias("salts")))

    def split(df: DataFrame) -> DataFrame:
        return df.withColumn("rng", of_key).join(hot, "rng", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    salted = split(long).withColumn("salt", F.pmod(F.xxhash64("ref_id", "side"), F.col("salts")).cast("int")).drop("salts")
    held = split(defs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    tasks = max(1, min(ranges, max(MAX_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    placed, beside = (df.repartition(tasks, "rng", "salt").groupBy("rng", "salt") for df in (salted, held))
    return placed.cogroup(beside).applyInArrow(_range_orphans, "ref_id bigint, side string, page string, period int")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per side and month: ``(side, month STRING, orphans BIGINT, pages BIGINT)``."""
    month = F.date_format(F.add_months(F.lit("1970-01-01").cast("date"), F.col("period")), "yyyy-MM")
    per_page = orphans.groupBy("side", month.alias("month"), "page").agg(F.count("*").alias("n"))
    return per_page.groupBy("side", "month").agg(F.sum("n").alias("orphans"), F.count("*").alias("pages"))
