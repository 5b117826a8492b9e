"""Functions over tensors for SQL: register(spark), then
SELECT t.* FROM tensors, LATERAL tensor_cells(data, dtype) t; SELECT tensor_entropy(data, dtype) FROM tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="idx long, x double")
class TensorCells:
    """The elements of a chunk, a row each, with their place in it."""

    def eval(self, data: bytes, dtype: str) -> Iterator[tuple[int, float]]:
        if data is not None:
            yield from enumerate(np.frombuffer(data, dtype).astype(float).tolist())


def _entropy(data: bytes | None, dtype: str) -> float | None:
    if data is None:
        return None
    a = np.frombuffer(data, dtype)
    if a.dtype.kind == "f":
        if a.size < 2 or a.min() == a.max():
            return 0.0
        counts = np.histogram(a.astype(float), min(256, max(8, int(a.size**0.5))))[0]
    else:
        counts = np.unique(a, return_counts=True)[1]
    p = counts[counts > 0] / a.size
    return float(max(0.0, -(p * np.log2(p)).sum()))


def register(spark: SparkSession) -> None:
    @F.pandas_udf("double")
    def tensor_entropy(data: pd.Series, dtype: pd.Series) -> pd.Series:
        return pd.Series([_entropy(d, t) for d, t in zip(data, dtype)], dtype="float64")

    @F.pandas_udf("binary")
    def pack_codes(codes: pd.Series, width: pd.Series) -> pd.Series:
        from loomspan.codec.bits import pack

        return pd.Series([None if c is None else pack(np.asarray(c), int(w)) for c, w in zip(codes, width)])

    @F.pandas_udf("array<long>")
    def unpack_codes(data: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
        from loomspan.codec.bits import unpack

        return pd.Series([None if d is None else unpack(d, int(w), int(k)) for d, w, k in zip(data, width, n)])

    spark.udtf.register("tensor_cells", TensorCells)
    for f in (tensor_entropy, pack_codes, unpack_codes):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
