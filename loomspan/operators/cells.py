"""Tensors as rows: one per element, with coordinates from the flat index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many rows of parameters at most are sent to every task.
FEW = 10_000


def array_cells(df: DataFrame, key: str, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per element of an array column: key, dim, x."""
    return df.select(key, *keep, F.posexplode(array).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def column_tensors(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns as one-dimensional tensors: tensor_name, x. One pass over df; only the columns named are read."""
    pairs = F.array(*[F.struct(F.lit(c).alias("tensor_name"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("t")).select(*keep, "t.*")


def beside(cells: DataFrame, parameters: DataFrame, keys: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """cells joined to parameters, which has one row per group.

    A join by key sends all cells of a group to one task, and a tensor is one group. So parameters are computed at once, and
    up to few rows of them are broadcast: cells stay where they are, however large a group is. More groups are joined by key,
    where AQE splits one that is hot.
    """
    if not keys:
        return cells.crossJoin(F.broadcast(parameters))
    rows = parameters.limit(few + 1).toArrow()
    if rows.num_rows <= few:
        parameters = F.broadcast(cells.sparkSession.createDataFrame(rows, parameters.schema))
    return cells.join(parameters, keys, how)


def coordinate(idx: Column, shape: list[int], axis: int) -> Column:
    """Coordinate along an axis (negative axes from the end) of a flat index in C order."""
    axis = axis if axis >= 0 else axis + len(shape)
    if not 0 <= axis < len(shape):
        raise ValueError(f"no axis {axis} in {shape}")
    stride = 1
    for n in shape[axis + 1 :]:
        stride *= n
    return F.pmod(F.floor(idx / F.lit(stride)), F.lit(shape[axis]))


def strided(df: DataFrame, idx: str, size: int, most: int) -> DataFrame:
    """Every k-th element, the least k with at most most of them: the same sample on every run."""
    step = max(1, -(-size // most))
    return df.filter(F.pmod(F.col(idx), F.lit(step)) == 0) if step > 1 else df
