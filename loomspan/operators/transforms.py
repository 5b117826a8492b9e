"""Invertible transforms of cells: channel normalization, differences, sparse form, principal components, pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.cells import beside


def channel_params(cells: DataFrame, channel: list[str], x: str = "x") -> DataFrame:
    """scale and zero of each channel in single precision: its largest magnitude and 0 if it crosses zero, else its range and least."""
    r = cells.groupBy(*channel).agg(F.min(F.col(x).cast("float")).alias("lo"), F.max(F.col(x).cast("float")).alias("hi"))
    crosses = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    scale = F.when(crosses, F.greatest(F.abs("lo"), F.abs("hi"))).otherwise((F.col("hi") - F.col("lo")).cast("float"))
    return r.select(*channel, F.when(scale > 0, scale).otherwise(F.lit(1.0).cast("float")).alias("scale"), F.when(crosses, F.lit(0.0).cast("float")).otherwise(F.col("lo")).alias("zero"))


def normalize(cells: DataFrame, channel: list[str], x: str = "x") -> DataFrame:
    """cells with scale, zero and y = (x - zero) / scale, each step rounded to single precision."""
    j = beside(cells, channel_params(cells, channel, x), channel)
    return j.withColumn("y", ((F.col(x).cast("float") - F.col("zero")).cast("float") / F.col("scale")).cast("float"))


def denormalize(cells: DataFrame, y: str = "y") -> DataFrame:
    return cells.withColumn("x", ((F.col(y) * F.col("scale")).cast("float") + F.col("zero")).cast("float"))


def difference(df: DataFrame, group: list[str], order: list[str], x: str = "x") -> DataFrame:
    """delta: each value less the one before it in its group, 0 for the first; anchor: the group's first value."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("delta", F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0))).withColumn("anchor", F.first(x).over(w))


def accumulate(df: DataFrame, group: list[str], order: list[str], delta: str = "delta", anchor: str = "anchor") -> DataFrame:
    """The inverse: restored = anchor plus the running sum of the differences."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("restored", F.col(anchor) + F.sum(delta).over(w))


def sparse(cells: DataFrame, x: str = "x") -> DataFrame:
    """Only the cells that are not zero."""
    return cells.filter(F.col(x) != 0)


def index_steps(coo: DataFrame, tensor: list[str], idx: str = "idx") -> DataFrame:
    """step: the index less the one before it in the tensor; the index itself for the first."""
    w = W.partitionBy(*tensor).orderBy(idx)
    return coo.withColumn("step", F.col(idx) - F.coalesce(F.lag(idx).over(w), F.lit(0)))


def dense(coo: DataFrame, sizes: DataFrame, tensor: list[str], idx: str = "idx", x: str = "x") -> DataFrame:
    """The inverse of sparse: a row per index below the tensor's size, 0 where there was none."""
    full = sizes.select(*tensor, F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias(idx))
    return full.join(coo, [*tensor, idx], "left").withColumn(x, F.coalesce(x, F.lit(0.0)))


@dataclass
class Components:
    """Principal components of rows of one width."""

    mean: np.ndarray
    axes: np.ndarray
    ratio: np.ndarray

    @property
    def k(self) -> int:
        return len(self.axes)


def fit_components(df: DataFrame, array: str, threshold: float = 0.95) -> Components:
    """The fewest components that explain threshold of the variance of an array column.

    The d x d moments are summed by the executors, in one pass with a row of d + d * d sums per task, so any number of rows
    will do; d is the width of a row. All rows are shifted by one of them first, as squares of large cells would cancel. Only
    the d + d * d sums and the eigenvectors are the driver's.
    """
    shift = np.array(df.select(F.col(array).cast("array<double>")).first()[0])
    d = len(shift)

    def moments(batches):
        import pandas as pd

        s, ss, n = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b[array].to_numpy()).astype(float) - shift
            s, ss, n = s + m.sum(0), ss + m.T @ m, n + len(m)
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select(array).mapInPandas(moments, "n long, s array<double>, ss array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "v"))
    sums = np.array([r["v"] for r in flat.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    n = parts.agg(F.sum("n")).first()[0]
    mean = sums[:d] / n
    cov = sums[d:].reshape(d, d) / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(cov)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
    ratio = value / value.sum() if value.sum() > 0 else np.eye(1, d)[0]
    k = min(d, int(np.searchsorted(np.cumsum(ratio), threshold - 1e-12)) + 1)
    return Components(mean + shift, vector[:k], ratio[:k])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def project(df: DataFrame, array: str, c: Components) -> DataFrame:
    """scores: a row's coordinates along the components."""
    centred = F.zip_with(array, F.lit([float(v) for v in c.mean]), lambda p, q: p.cast("double") - q)
    axes = F.array(*[F.lit(a.tolist()) for a in c.axes])
    return df.withColumn("_centred", centred).withColumn("scores", F.transform(axes, lambda a: _dot(a, F.col("_centred")))).drop("_centred")


def restore(df: DataFrame, c: Components) -> DataFrame:
    """restored: the mean and the components, each times its score, added up."""
    axes = F.array(*[F.lit(a.tolist()) for a in c.axes])
    each = F.arrays_zip(F.col("scores").alias("s"), axes.alias("a"))
    back = F.aggregate(each, F.lit([float(v) for v in c.mean]), lambda acc, x: F.zip_with(acc, x["a"], lambda p, q: p + q * x["s"]))
    return df.withColumn("restored", back)


def effective_rank(df: DataFrame, array: str) -> float:
    """exp of the entropy of the normalized singular values of the centred rows; 1 for a constant."""
    c = fit_components(df, array, 1.0)
    s = np.sqrt(c.ratio[c.ratio > 0])
    p = s / s.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


@dataclass
class Step:
    """A named pair of functions from DataFrame to DataFrame, one the inverse of the other."""

    name: str
    forward: Callable[[DataFrame], DataFrame]
    inverse: Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Steps in order; inverse runs them backwards. Names are unique."""

    steps: list[Step] = field(default_factory=list)

    def add(self, name: str, forward: Callable[[DataFrame], DataFrame], inverse: Callable[[DataFrame], DataFrame]) -> Pipeline:
        if any(s.name == name for s in self.steps):
            raise ValueError(f"there is a step {name} already")
        return Pipeline([*self.steps, Step(name, forward, inverse)])

    def forward(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s.forward)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            df = df.transform(s.inverse)
        return df
