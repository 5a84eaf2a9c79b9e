"""Current vectors and their cells: groups of near vectors of a type, small enough for one task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Cut

#: Vectors that a cell should hold, and the most centroids over all types (with them the broadcast is bounded).
CELL, MAX_CENTROIDS = 1200, 16_384
#: Vectors sampled to place the centroids. The sample decides where vectors are sent; every vector is indexed.
SAMPLE = 60_000
#: Products of vectors and centroids held at once: blocks of rows are cut so that no matrix grows with both.
_PRODUCTS = 1 << 22


def usual_dim(vectors: DataFrame) -> int:
    """The number of components that most vectors have, the larger of equals; 0 if there are no vectors."""
    sizes = vectors.where(F.size("vec") > 0).groupBy(F.size("vec").alias("dim")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return row["dim"] if row else 0


def current_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """The current vector of each key: ``(typeno, featno, vec ARRAY<FLOAT>, h1 BIGINT, h2 BIGINT)``.

    Of several rows of a key that with the highest ``seq`` counts (a null ``seq`` is the lowest; of rows with one
    ``seq`` the largest vector). If its ``vec`` is null, of another length, all zeros, or holds a component that is
    null or not finite, the key has no vector, whatever older rows hold. Rows with a null key are ignored. ``h1``
    and ``h2`` are hashes of the vector, by which exact copies are found.
    """
    x = F.col("vec")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0)
    newest = F.max(F.struct(F.col("seq"), F.when(usable, x).alias("vec"))).alias("m")
    keyed = vectors.where(F.col("typeno").isNotNull() & F.col("featno").isNotNull())
    best = keyed.groupBy("typeno", "featno").agg(newest).select("typeno", "featno", "m.vec").where(F.col("vec").isNotNull())
    return best.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def copies(current: DataFrame) -> DataFrame:
    """Exact copies within a type: ``(typeno, featno, rep)`` for each vector of a group of two or more.

    ``rep`` is the smallest ``featno`` of the group. Only hashes are shuffled. Groups are counted before they are
    joined, with partial counts in each task, so that a large group doesn't gather in one.
    """
    groups = current.groupBy("typeno", "h1", "h2").agg(F.min("featno").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return current.select("typeno", "featno", "h1", "h2").join(groups, ["typeno", "h1", "h2"]).select("typeno", "featno", "rep")


@dataclass
class Cells:
    """Centroids of each type; cell numbers run over all types."""

    first: dict[int, int]
    centroids: dict[int, np.ndarray]
    parts: np.ndarray  # how often a cell is split because it would be too large

    def route(self, typeno: int, unit: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, cell, primary)`` of the cells near each vector, its nearest first."""
        c = self.centroids.get(typeno)
        if c is None:  # a type without a sampled vector: one cell for all such types would mix them, so it has none
            return np.arange(len(unit)), np.full(len(unit), -1 - typeno), np.ones(len(unit), bool)
        k, block = min(probes, len(c)), max(1, _PRODUCTS // len(c))
        rows, cells, firsts = [], [], []
        for s in range(0, len(unit), block):
            sims = unit[s : s + block] @ c.T
            top = np.argpartition(sims, len(c) - k, axis=1)[:, len(c) - k :] if k < len(c) else np.tile(np.arange(len(c)), (len(sims), 1))
            near = np.take_along_axis(sims, top, 1)
            order = np.lexsort((top, -near), axis=1)
            top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
            row, at = np.nonzero(near >= near[:, :1] - margin)
            rows.append(s + row)
            cells.append(self.first[typeno] + top[row, at])
            firsts.append(at == 0)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(firsts)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = np.array(x, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very long and very short vectors
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, without a Python object for each."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten()).reshape(len(column), -1)


def blobs(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a binary column of packed float32 vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The most similar centroid of each row."""
    block = max(1, _PRODUCTS // len(c))
    return np.concatenate([np.argmax(x[s : s + block] @ c.T, axis=1) for s in range(0, len(x), block)])


def _fit(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spread starting rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        at = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    c = c[np.bincount(_nearest(x, c), minlength=k) > 0]
    # several centroids on one point would take up the probes of all vectors near it
    return c[np.sort(np.unique(np.round(c, 6), axis=0, return_index=True)[1])]


def fit_cells(single: DataFrame, *, cell: int = CELL, sample: int = SAMPLE, largest: int = 4 * CELL) -> Cells:
    """Places centroids on a bounded sample of the vectors without copies, by a hash of their keys."""
    n = single.count()
    # a little less than the bound, so that the limit, which takes any rows, doesn't come into play
    share = 1.0 if n <= sample else 0.97 * sample / n
    chosen = F.pmod(F.xxhash64("typeno", "featno"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    drawn = single.where(chosen).select("typeno", "featno", "vec").limit(sample).toPandas().sort_values(["typeno", "featno"])
    scale = n / max(1, len(drawn))
    total = max(1, min(MAX_CENTROIDS, -(-n // cell)))
    first, centroids, parts = {}, {}, []
    for typeno, rows in drawn.groupby("typeno"):
        x = units(np.stack(rows["vec"].to_list()))
        k = max(1, min(round(total * len(x) / len(drawn)), len(x) // 4))
        first[int(typeno)] = len(parts)
        c = centroids[int(typeno)] = _fit(x, k) if k > 1 else x.mean(axis=0, keepdims=True)
        sizes = np.bincount(_nearest(x, c), minlength=len(c)) * scale
        parts.extend(np.maximum(1, np.ceil(sizes / largest)).astype(int))
    return Cells(first, centroids, np.array(parts, dtype=int))


ROUTED = "cell int, part int, typeno int, featno int, own boolean, asks boolean, vec binary"
_ROUTED = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("typeno", pa.int32()), ("featno", pa.int32()), ("own", pa.bool_()), ("asks", pa.bool_()), ("vec", pa.binary())])


def routed(single: DataFrame, cells: Cells, *, probes: int, margin: float) -> DataFrame:
    """Each vector in its own cell and in the near ones, as ``(cell, part, typeno, featno, own, asks, vec)``.

    A vector is stored (``own``) in one part of its nearest cell. One whose ``asks`` is true also visits all parts of
    up to ``probes`` cells whose centroid is at most ``margin`` less similar than the nearest. ``vec`` holds float32
    components.
    """
    packed = single.sparkSession.sparkContext.broadcast(cells)

    def send(batches):
        cells = packed.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.ascontiguousarray(matrix(batch.column("vec")), dtype=np.float32)
            unit = units(raw)
            types, feats, asks = (np.asarray(batch.column(c)) for c in ("typeno", "featno", "asks"))
            out = []
            for t in np.unique(types):
                at = np.flatnonzero(types == t)
                row, cell, own = cells.route(int(t), unit[at], probes, margin)
                goes = own | asks[at[row]]
                row, cell, own = row[goes], cell[goes], own[goes]
                n_parts = np.where(cell >= 0, cells.parts[np.maximum(cell, 0)], 1)
                rep = np.repeat(np.arange(len(row)), n_parts)
                part = np.arange(len(rep)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                idx = at[row[rep]]
                home = (feats[idx].astype(np.int64) * 2654435761 >> 7) % n_parts[rep]
                mine = own[rep] & (home == part)
                stay = mine | asks[idx]
                out.append(tuple(c[stay] for c in (cell[rep], part, types[idx], feats[idx], mine, asks[idx], idx)))
            *cols, idx = (np.concatenate(c) for c in zip(*out, strict=True))
            width = raw.shape[1] * 4
            ends = np.arange(len(raw) + 1, dtype=np.int32) * width
            vec = pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).take(pa.array(idx))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _ROUTED.types, strict=False)), vec], schema=_ROUTED)

    return single.select("typeno", "featno", "vec", "asks").mapInArrow(send, ROUTED)


def in_tasks(routed: DataFrame, cells: Cells, waves: int = 4):
    """The routed vectors grouped by cell, cells spread over some tasks for each core rather than by their bytes.

    The work of a cell grows faster than its bytes, by which adaptive execution would merge them.
    """
    cores = routed.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(int(cells.parts.sum()) + len(cells.first), waves * cores))
    return routed.repartition(tasks, "cell", "part", "typeno").groupBy("cell", "part", "typeno")


def distinct_vectors(cut: Cut, vectors: DataFrame, dim: int | None, every: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current vectors (written), groups of copies (written), and the vectors without copies but the first of each group.

    ``dim`` None takes the number of components that most vectors have. The last table's ``asks`` tells vectors of
    which a copy has a ``featno`` divisible by ``every``.
    """
    dim = usual_dim(vectors) if dim is None else dim
    current = cut.keep(current_vectors(vectors, dim))
    same = cut.keep(copies(current))
    others = same.where(F.col("featno") != F.col("rep")).select("typeno", "featno")
    single = current.join(others, ["typeno", "featno"], "left_anti")
    if every == 1:
        return current, same, single.withColumn("asks", F.lit(True))
    asked = same.where(F.col("featno") % every == 0).select("typeno", F.col("rep").alias("featno"), F.lit(True).alias("by_copy")).distinct()
    single = single.join(asked, ["typeno", "featno"], "left").withColumn("asks", F.coalesce("by_copy", F.col("featno") % every == 0))
    return current, same, single.drop("by_copy")
