"""Quantizers over cells: a layout says which cells share parameters, a policy how they are found."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import affine
from loomspan.operators.cells import beside
from loomspan.operators.profile import percentiles


@dataclass(frozen=True)
class Layout:
    """Cells share parameters per tensor, per channel along an axis, or per block of slices along it."""

    granularity: str = "per_tensor"
    channel: str | None = None
    block_size: int = 128

    def keys(self, tensor: list[str]) -> list[tuple[str, Column]]:
        named = [(k, F.col(k)) for k in tensor]
        if self.granularity == "per_tensor":
            return named
        if not self.channel:
            raise ValueError(f"{self.granularity} needs the column of the channel")
        if self.granularity == "per_channel":
            return [*named, (self.channel, F.col(self.channel))]
        if self.granularity != "blockwise":
            raise ValueError(f"no such granularity: {self.granularity}")
        return [*named, ("block", F.floor(F.col(self.channel) / F.lit(self.block_size)))]


class Ranges(Protocol):
    """What finds the range of values of each group; any object with this method is a policy."""

    def ranges(self, cells: DataFrame, keys: list[str], x: str, mode: str) -> DataFrame:
        """keys, lo, hi: a row per group."""


@dataclass(frozen=True)
class Policy:
    """Least and largest value of a group, or percentiles that leave out its tails."""

    kind: str = "minmax"
    percentile: float = 99.9

    def ranges(self, cells: DataFrame, keys: list[str], x: str, mode: str) -> DataFrame:
        if self.kind == "minmax":
            return cells.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        if self.kind != "percentile" or not 0 < self.percentile <= 100:
            raise ValueError(f"no such policy: {self}")
        if mode == affine.SYMMETRIC:
            p = percentiles(cells.withColumn("_abs", F.abs(x)), keys, "_abs", [self.percentile / 100])
            return p.select(*keys, (-F.col("p0")).alias("lo"), F.col("p0").alias("hi"))
        tail = (100 - self.percentile) / 200
        return percentiles(cells, keys, x, [tail, 1 - tail]).withColumnsRenamed({"p0": "lo", "p1": "hi"})


def calibrate(cells: DataFrame, tensor: list[str], bits: int, mode: str = affine.SYMMETRIC, layout: Layout = Layout(), policy: Ranges = Policy(), x: str = "x") -> DataFrame:
    """Parameters of each group: its keys, lo, hi, scale, zero."""
    keys = layout.keys(tensor)
    named = cells.withColumns(dict(keys))
    r = policy.ranges(named, [k for k, _ in keys], x, mode)
    return r.withColumn("p", affine.params(F.col("lo"), F.col("hi"), bits, mode)).select("*", "p.scale", "p.zero").drop("p")


def _joined(cells: DataFrame, parameters: DataFrame, tensor: list[str], layout: Layout) -> DataFrame:
    keys = layout.keys(tensor)
    return beside(cells.withColumns(dict(keys)), parameters.drop("lo", "hi"), [k for k, _ in keys])


def quantize(cells: DataFrame, tensor: list[str], bits: int, mode: str = affine.SYMMETRIC, layout: Layout = Layout(), policy: Ranges = Policy(), x: str = "x") -> DataFrame:
    """cells with scale, zero, the code q and the value y that it stands for.

    Parameters are joined to the cells by group. Cells are the large side and are not shuffled while the parameters
    are few enough to be broadcast (cells.FEW), for which they are computed at once; else the join is by group, which AQE
    splits if one is hot.
    """
    q = Uniform(bits, mode, layout)
    return q.dequantize(q.quantize(cells, tensor, calibrate(cells, tensor, bits, mode, layout, policy, x), x))


@dataclass(frozen=True)
class Calibrator:
    """Settings under which parameters are found, as one object: calibrate(cells, tensor) gives keys, lo, hi, scale, zero."""

    bits: int = 8
    mode: str = affine.SYMMETRIC
    layout: Layout = Layout()
    policy: Ranges = Policy()

    def calibrate(self, cells: DataFrame, tensor: list[str], x: str = "x") -> DataFrame:
        return calibrate(cells, tensor, self.bits, self.mode, self.layout, self.policy, x)


@dataclass(frozen=True)
class Uniform:
    """Codes of cells under parameters that were found before, on these cells or on others, and back."""

    bits: int = 8
    mode: str = affine.SYMMETRIC
    layout: Layout = Layout()

    def quantize(self, cells: DataFrame, tensor: list[str], parameters: DataFrame, x: str = "x") -> DataFrame:
        """cells with scale, zero and the code q. A cell whose group has no parameters is left out, as it has no code."""
        j = _joined(cells, parameters, tensor, self.layout)
        return j.withColumn("q", affine.quantize(F.col(x), F.col("scale"), F.col("zero"), self.bits, self.mode))

    def dequantize(self, codes: DataFrame) -> DataFrame:
        """codes (q, scale, zero) with y, the values that they stand for."""
        return codes.withColumn("y", affine.dequantize(F.col("q"), F.col("scale"), F.col("zero")))
