"""The most similar vectors of every vector: randomly rotated one-bit codes, and an exact pass over what they leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.cells import blobs, distinct_vectors, fit_cells, in_tasks, matrix, routed, units
from weftline.session import Cut

#: Cells that a vector visits at most, and how much less similar their centroids may be than the nearest.
PROBES, MARGIN = 8, 0.12
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 1.9
#: Bits of a query's components.
QUERY_BITS = 4
_TILE = 1 << 19
#: Vectors of a type in a block of the exact pass, and more than single precision can move a cosine there.
BLOCK, SLACK = 1 << 15, 2e-5


def rotation(dim: int, seed: int = 20_24) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the vectors of a cell, relative to their mean, and what the estimate needs besides.

    For a residual of length ``norm`` with the rotated unit direction ``u``, the code is the signs of ``u`` and
    ``fit`` the inner product of ``u`` with the code's own unit vector. The inner product with another vector is
    estimated from the code by dividing by ``fit``; its error stays within ``bound`` times both lengths, but for a
    small share of cases.
    """

    def __init__(self, unit: np.ndarray, turn: np.ndarray, width: float = WIDTH):
        dim = unit.shape[1]
        self.unit, self.turn, self.dim = unit, turn, dim
        self.center = unit.mean(axis=0)
        rest = unit - self.center
        self.norm = np.linalg.norm(rest, axis=1)
        u = (rest / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn
        self.bits = _pack(u > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float32)
        fit = np.maximum(np.abs(u).sum(axis=1) / np.sqrt(dim), 1e-6)
        self.scale = (self.norm / fit / np.sqrt(dim)).astype(np.float32)
        self.bound = (self.norm * np.sqrt(np.maximum(0, 1 - fit**2)) / fit * width / np.sqrt(max(1, dim - 1))).astype(np.float32)
        self.offset = unit @ self.center

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of the queries with all vectors, and the bounds of their errors."""
        rest = q - self.center
        v = rest @ self.turn
        low = v.min(axis=1)
        step = np.maximum((v.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
        level = np.rint((v - low[:, None]) / step[:, None]).astype(np.uint8)
        hits = np.zeros((len(q), len(self.bits)), dtype=np.int16)
        for b in range(QUERY_BITS):
            plane = _pack((level >> b) & 1 > 0)
            for w in range(plane.shape[1]):
                hits += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(np.int16) << b
        at_ones = low.astype(np.float32)[:, None] * self.ones + step.astype(np.float32)[:, None] * hits
        dot = (2 * at_ones - v.sum(axis=1).astype(np.float32)[:, None]) * self.scale
        base = (q @ self.center).astype(np.float32)[:, None] + (self.offset - self.center @ self.center).astype(np.float32)
        length = np.linalg.norm(rest, axis=1)
        # rounding a component moves it by half a step at most: a small term beside the code's own error
        rounding = (step * np.sqrt(self.dim / 12)).astype(np.float32)[:, None] * self.scale * 2
        return base + dot, length.astype(np.float32)[:, None] * self.bound + rounding + 1e-6

    def search(self, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query row, vector row, cosine to 6 digits)`` of the ``k`` most similar vectors of each query.

        The bounds choose what is ranked by exact inner products: all vectors that may reach both ``least`` and the
        k-th best lower bound. Ties go to the smaller id; a vector isn't its own neighbour.
        """
        out = []
        block = max(1, _TILE // max(1, len(ids)))
        for s in range(0, len(q), block):
            est, err = self.estimate(q[s : s + block])
            est[q_ids[s : s + block, None] == ids[None, :]] = -9.0
            upper = est + err
            maybe = upper >= least
            many = np.flatnonzero(maybe.sum(axis=1) > k)
            if len(many) and len(ids) > k:
                floor = np.partition((est - err)[many], -k, axis=1)[:, -k]
                maybe[many] &= upper[many] >= floor[:, None]
            row, col = np.nonzero(maybe)
            if not len(row):
                continue
            row, col, cos = _ranked(q[s : s + block], self.unit, ids, row, col, k, least)
            out.append((s + row, col, cos))
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _ranked(q: np.ndarray, unit: np.ndarray, ids: np.ndarray, row: np.ndarray, col: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs ``(row, col)`` the ``k`` best of each row, by exact cosines."""
    cos = np.empty(len(row))
    for a in range(0, len(row), _TILE >> 2):
        part = slice(a, a + (_TILE >> 2))
        cos[part] = np.einsum("ij,ij->i", q[row[part]], unit[col[part]])
    cos = np.round(cos, 6)
    good = cos >= least
    row, col, cos = row[good], col[good], cos[good]
    order = np.lexsort((ids[col], -cos, row))
    row, col, cos = row[order], col[order], cos[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], col[top], cos[top]


def exact_search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, unit: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :meth:`Codes.search`, of all vectors: ``floor`` is a cosine that the ``k``-th best of each query reaches.

    ``ids`` ascend. Products in single precision choose what is ranked: all that reach ``floor`` within ``SLACK``.
    """
    x, y = q.astype(np.float32), unit.astype(np.float32)
    limit = (np.maximum(floor, least) - SLACK).astype(np.float32)
    itself = np.searchsorted(ids, q_ids)
    known = ids[np.minimum(itself, len(ids) - 1)] == q_ids if len(ids) else np.zeros(len(q), dtype=bool)
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    block = max(1, 4 * _TILE // max(1, len(ids)))
    for s in range(0, len(q) if len(ids) else 0, block):
        sims = x[s : s + block] @ y.T
        own = np.flatnonzero(known[s : s + block])
        sims[own, itself[s + own]] = -9
        maybe = sims >= limit[s : s + block, None]
        many = np.flatnonzero(np.count_nonzero(maybe, axis=1) > 8 * k)
        if len(many) and len(ids) > k:
            maybe[many] &= sims[many] >= np.partition(sims[many], -k, axis=1)[:, -k, None] - np.float32(SLACK)
        row, col = np.nonzero(maybe)
        row, col, cos = _ranked(q[s : s + block], unit, ids, row, col, k, least)
        out.append((s + row, col, cos))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[1] % 64
    if pad:
        bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


FOUND = "typeno int, featno int, other int, cosine double"


def _cell_search(k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        own = np.asarray(table["own"])
        feat = np.asarray(table["featno"])
        unit = units(blobs(table["vec"]))
        typeno = int(table["typeno"][0].as_py())
        schema = pa.schema([("typeno", pa.int32()), ("featno", pa.int32()), ("other", pa.int32()), ("cosine", pa.float64())])
        asks = np.flatnonzero(np.asarray(table["asks"]))
        if not own.any() or not len(asks):
            return schema.empty_table()
        ids = feat[own]
        row, col, cos = Codes(unit[own], rotation(unit.shape[1])).search(unit[asks], feat[asks], ids, k, least)
        return pa.table([pa.array(np.full(len(row), typeno, np.int32)), pa.array(feat[asks][row].astype(np.int32)), pa.array(ids[col].astype(np.int32)), pa.array(cos)], schema=schema)

    return run


def _block_search(k: int, least: float):
    schema = pa.schema([("typeno", pa.int32()), ("featno", pa.int32()), ("other", pa.int32()), ("cosine", pa.float64())])

    def run(table: pa.Table, floors: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        feat = np.asarray(table["featno"])
        order = np.argsort(feat)
        feat, block, ask = (np.asarray(table[c])[order] for c in ("featno", "block", "asks"))
        unit = units(blobs(table["vec"])[order])
        floor = np.full(len(feat), least)
        floor[np.searchsorted(feat, np.asarray(floors["featno"]))] = np.asarray(floors["floor"])
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        out = []
        for x, y in {(a, b), (b, a)}:
            asks, held = np.flatnonzero((block == x) & ask), np.flatnonzero(block == y)
            row, col, cos = exact_search(unit[asks], feat[asks], floor[asks], unit[held], feat[held], k, least)
            out.append((feat[asks][row], feat[held][col], cos))
        own, other, cos = (np.concatenate(c) for c in zip(*out, strict=True))
        typeno = np.full(len(own), table["typeno"][0].as_py(), np.int32)
        return pa.table([pa.array(typeno), pa.array(own.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(cos)], schema=schema)

    return run


def _packed(batches):
    for batch in batches:
        raw = np.ascontiguousarray(matrix(batch.column("vec")), dtype=np.float32) if batch.num_rows else np.empty((0, 0), np.float32)
        vec = pa.array([r.tobytes() for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("typeno", "featno", "asks")), vec], ["typeno", "featno", "asks", "vec"])


def completed(found: DataFrame, single: DataFrame, k: int, least: float) -> DataFrame:
    """The best of all vectors of the type, given some of the similar ones that ``found`` has of each query.

    The ``k``-th best of ``found`` is a lower bound of the true one. Each type is divided into blocks by hash, and
    each pair of blocks is multiplied in one task, so that no task grows with a type; few pairs reach the bounds.
    """
    sizes = single.groupBy("typeno").count().where(F.col("count") > BLOCK).collect()  # at most one for each BLOCK vectors
    blocks = F.lit(1)
    if sizes:
        blocks = F.coalesce(F.create_map(*[F.lit(x) for r in sizes for x in (r["typeno"], -(-r["count"] // BLOCK))])[F.col("typeno")], blocks)

    def paired(df):
        there = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("featno"), F.col("blocks")).cast("int"))
        there = there.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        return there.withColumns({"a": F.least("block", "with"), "b": F.greatest("block", "with")}).drop("blocks", "with")

    best = F.sort_array(F.collect_list("cosine"), asc=False)
    floors = found.groupBy("typeno", "featno").agg(F.get(best, F.lit(k - 1)).alias("floor")).where(F.col("floor").isNotNull())
    packed = single.select("typeno", "featno", "asks", "vec").mapInArrow(_packed, "typeno int, featno int, asks boolean, vec binary")
    keys = ("typeno", "a", "b")
    return paired(packed).groupBy(*keys).cogroup(paired(floors).groupBy(*keys)).applyInArrow(_block_search(k, least), FOUND)


def nearest(vectors: DataFrame, *, k: int = 10, least: float = -1.0, every: int = 1, probes: int = PROBES, margin: float = MARGIN, dim: int | None = None) -> DataFrame:
    """The ``k`` most similar vectors of the same type: ``(typeno, featno, other, cosine, rank)``.

    Queries are the current vectors whose ``featno`` is divisible by ``every``; all are searched. Only pairs of a
    cosine of at least ``least`` are given. Cosines are rounded to 6 digits; ties go to the smaller ``featno``.
    Vectors have ``dim`` components, by default as many as most of them have.

    Method. Vectors are kept in cells round centroids. Within a cell they are coded by the signs of their randomly
    rotated residuals. A query visits the near cells; there packed bits and a few scalars give estimates with error
    bounds, and the vectors that the bounds can't rule out are ranked by exact cosines. The ``k``-th best of these
    bounds the true one from below; an exact pass over all vectors of the type then ranks whatever reaches that bound.
    So ``probes`` and ``margin`` decide how sharp the bound is, never what is found.

    Plan. One shuffle brings each vector to the cells that it visits, one merges the results of a query's cells. A
    cell too large for a task is split into parts that all its queries visit. The exact pass sends each vector once
    for each block of its type; its products grow with the square of a type. Exact copies are set aside first: one
    of a group is indexed, and the others are put in beside it, so that a large group makes no large cell.

    Edge cases. See :func:`current_vectors` for keys, repeats and unusable vectors. A type with one vector has no
    rows. An empty table gives an empty result; other columns are ignored.
    """
    cut = Cut(vectors.sparkSession, "vec")
    _, same, single = distinct_vectors(cut, vectors, dim, every)
    cells = fit_cells(single)
    found = in_tasks(routed(single, cells, probes=probes, margin=margin), cells).applyInArrow(_cell_search(k, least), FOUND)
    found = _with_copies(completed(found, single, k, least), same, k, every)
    best = Window.partitionBy("typeno", "featno").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _with_copies(found: DataFrame, same: DataFrame, k: int, every: int) -> DataFrame:
    """Puts copies beside the vector that stood for them, as neighbours and as queries.

    Of a group only its ``k + 1`` smallest members can be among anyone's ``k`` best, so no list grows with the group.
    """
    order = Window.partitionBy("typeno", "rep").orderBy("featno")
    few = same.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("typeno", F.col("rep").alias("other"), F.col("featno").alias("copy"))
    wide = found.join(few, ["typeno", "other"], "left").select("typeno", "featno", F.coalesce("copy", "other").alias("other"), "cosine")
    best = Window.partitionBy("typeno", "featno").orderBy(F.desc("cosine"), "other")
    wide = wide.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    # every member of a group asks as its first does, and has the group's smallest members at cosine 1
    members = same.where(F.col("featno") % every == 0).select("typeno", F.col("rep"), F.col("featno").alias("member"))
    asked = wide.join(members, (wide.typeno == members.typeno) & (wide.featno == members.rep), "left").select(wide.typeno, F.coalesce("member", wide.featno).alias("featno"), "other", "cosine")
    within = members.join(few.withColumnRenamed("other", "rep"), ["typeno", "rep"]).where(F.col("member") != F.col("copy")).select("typeno", F.col("member").alias("featno"), F.col("copy").alias("other"), F.lit(1.0).alias("cosine"))
    return asked.where(F.col("featno") % every == 0).unionByName(within)


def similar_pairs(near: DataFrame) -> DataFrame:
    """Pairs of which at least one is among the best of the other: ``(typeno, featno_a, featno_b)``, each once."""
    return near.select("typeno", F.least("featno", "other").alias("featno_a"), F.greatest("featno", "other").alias("featno_b")).distinct()
