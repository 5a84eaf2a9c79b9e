"""Random-hyperplane models and the hashing of vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LshModel:
    """One matrix of ``bits * variations`` rows: bit r of a hash is 1 if row r times the vector is 0 or more."""

    matrix: np.ndarray

    @property
    def dim(self) -> int:
        return self.matrix.shape[1]

    @property
    def total_bits(self) -> int:
        return self.matrix.shape[0]

    @property
    def words(self) -> int:
        return -(-self.total_bits // 64)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Bits of the rows of ``x``, in double precision and on the vectors as they are."""
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors have {x.shape[1]} components, the model {self.dim}")
        return np.asarray(x, dtype=np.float64) @ self.matrix.T >= 0

    def hash(self, x: np.ndarray) -> np.ndarray:
        """Words of the rows of ``x``: most significant bit first, the last word left-aligned."""
        return pack(self.bits(x))

    def equals(self, other: "LshModel", tol: float = 1e-11) -> bool:
        return self.matrix.shape == other.matrix.shape and bool(np.allclose(self.matrix, other.matrix, rtol=0, atol=tol))


def pack(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[1] % 64
    padded = np.pad(bits, ((0, 0), (0, pad))) if pad else bits
    return np.packbits(padded, axis=1).view(">i8").astype(np.int64)


def base_matrix(dim: int, bits: int) -> np.ndarray:
    """Row r weighs its own block of columns by 1/length and all others by -1/(dim - length) (H1)."""
    if dim < bits:
        raise ValueError("the dimension must not be smaller than the number of bits")
    edge = [int(r * (dim / bits)) for r in range(bits)] + [dim]
    out = np.empty((bits, dim))
    for r in range(bits):
        lo, hi = edge[r], edge[r + 1]
        out[r] = -1.0 / (dim - (hi - lo)) if hi - lo < dim else 0.0
        out[r, lo:hi] = 1.0 / (hi - lo)
    return out


def create_model(dim: int, bits: int, variations: int, seed: int = 1) -> LshModel:
    """A seeded model: the base matrix under ``variations`` random rotations, multiplied once and for all (H1-H3)."""
    rng = np.random.default_rng(seed)
    base, parts = base_matrix(dim, bits), []
    for _ in range(variations):
        turn = rng.uniform(-1, 1, (dim, dim))
        while np.linalg.matrix_rank(turn) < dim:
            turn = rng.uniform(-1, 1, (dim, dim))
        parts.append(base @ turn)
    return LshModel(np.vstack(parts))


def to_frame(spark: SparkSession, model: LshModel) -> DataFrame:
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(model.matrix)]
    return spark.createDataFrame(rows, "row_no int, coeffs array<double>")


def from_frame(model: DataFrame) -> LshModel:
    """The model of a table ``(row_no, coeffs)``; its size is that of a matrix, fixed when the store is made."""
    rows = model.where(F.col("row_no").isNotNull()).orderBy("row_no").select("coeffs").collect()
    if not rows:
        raise ValueError("the model has no rows")
    if len({len(r[0] or []) for r in rows}) != 1:
        raise ValueError("the rows of the model differ in length")
    return LshModel(np.array([[float(v) for v in r[0]] for r in rows]))


def hash_vectors(df: DataFrame, model: LshModel, vec: str = "vec", out: str = "lsh") -> DataFrame:
    """``df`` with the words of ``vec`` in ``out``: one matrix product for each Arrow batch.

    The column is null where the vector is null, of another size or holds a null, NaN or infinite component.
    """
    packed = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<bigint>")
    def words(col: pd.Series) -> pd.Series:
        model, res = packed.value, [None] * len(col)
        rows, at = [], []
        for i, v in enumerate(col):
            if v is not None and len(v) == model.dim:
                v = np.asarray(v, dtype=np.float64)
                if np.isfinite(v).all():
                    rows.append(v)
                    at.append(i)
        if rows:
            for i, w in zip(at, model.hash(np.stack(rows)), strict=True):
                res[i] = w
        return pd.Series(res, dtype=object)

    return df.withColumn(out, words(F.col(vec)))
