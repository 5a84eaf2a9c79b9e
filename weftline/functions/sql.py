"""Names for SQL: bit and vector functions as SQL functions, which the optimizer expands, and the hash of a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.operators.lshmodel import LshModel

_WORDS = "ARRAY<BIGINT>"
_VECTOR = "ARRAY<DOUBLE>"

#: name, parameters, result and body of each SQL function
FUNCTIONS = {
    "bits_set": (f"a {_WORDS}", "INT", "aggregate(a, 0, (n, w) -> n + bit_count(w))"),
    "hamming": (f"a {_WORDS}, b {_WORDS}", "INT", "aggregate(zip_with(a, b, (p, q) -> coalesce(p, 0L) ^ coalesce(q, 0L)), 0, (n, w) -> n + bit_count(w))"),
    "lsh_weight": ("dist INT, bits INT", "DOUBLE", "1D - dist / (1.25D * bits)"),
    "vec_dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, p) -> s + p) END"),
    "vec_cosine": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "CASE WHEN size(a) <> size(b) THEN NULL WHEN vec_dot(a, a) * vec_dot(b, b) > 0 THEN vec_dot(a, b) / sqrt(vec_dot(a, a)) / sqrt(vec_dot(b, b)) ELSE 0D END"),
}


def register(spark: SparkSession, model: LshModel | None = None) -> list[str]:
    """Makes the functions known to the session as temporary ones; with a model also ``simhash(vector)``."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    if model is None:
        return list(FUNCTIONS)

    @F.pandas_udf("array<bigint>")
    def simhash(col: pd.Series) -> pd.Series:
        ok = [v is not None and len(v) == model.dim and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()) for v in col]
        out: list = [None] * len(col)
        rows = [np.asarray(v, dtype=np.float64) for v, k in zip(col, ok, strict=True) if k]
        for i, w in zip(np.flatnonzero(ok), model.hash(np.stack(rows)) if rows else [], strict=True):
            out[i] = w
        return pd.Series(out, dtype=object)

    spark.udf.register("simhash", simhash)
    return [*FUNCTIONS, "simhash"]
