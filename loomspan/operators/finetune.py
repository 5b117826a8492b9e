"""A fine-tuned model as its difference from its base: sets of tensors, statistics, routes, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import affine
from loomspan.operators.cells import beside

#: Differences nearer to zero than this count as none.
TINY = 1e-7


def membership(base: DataFrame, tuned: DataFrame, name: str = "tensor_name") -> DataFrame:
    """Each tensor name once, with membership: shared, added or removed."""
    b = base.select(name).distinct().withColumn("_b", F.lit(True))
    t = tuned.select(name).distinct().withColumn("_t", F.lit(True))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("shared")
    return b.join(t, name, "full_outer").select(name, kind.alias("membership"))


def differences(base: DataFrame, tuned: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """d = tuned - base in single precision, for the cells of shared tensors: a join on the cell, shuffled on both sides alike."""
    b = base.select(*keys, F.col(x).cast("float").alias("_b"))
    return tuned.select(*keys, F.col(x).cast("float").alias("_t")).join(b, keys).select(*keys, (F.col("_t") - F.col("_b")).cast("float").alias("d"), F.col("_b").alias("base"))


def analyze(diff: DataFrame, keys: list[str], two_d: Column, bits: int = 2, d: str = "d") -> DataFrame:
    """Statistics of each tensor's difference, its route and bits.

    zero if nothing is left; the sign with a scale per row for a large matrix of even magnitudes; sparse if most differences
    are none; exact if it is small; quantized otherwise.
    """
    a = F.abs(F.col(d).cast("double"))
    s = diff.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((a < TINY).cast("double")).alias("share_none"), F.max(a).alias("max_abs"), F.avg(a).alias("mean_abs"), F.stddev_pop(a).alias("std_abs"))
    even = (F.col("mean_abs") >= 1e-10) & (F.col("std_abs") / F.greatest(F.col("mean_abs"), F.lit(1e-300)) < 2.0)
    route = (
        F.when(F.col("max_abs") < 1e-8, "zero")
        .when((F.col("n") >= 1024) & two_d & even, "sign_scale")
        .when((F.col("share_none") > 0.85) & (F.col("n") >= 512), "sparse")
        .when(F.col("n") < 512, "lossless")
        .otherwise("quantize")
    )
    s = s.withColumn("route", route)
    width = F.when(F.col("route") == "sign_scale", 1).when(F.col("route") == "sparse", min(bits + 2, 8)).when(F.col("route") == "quantize", bits).otherwise(0)
    return s.withColumn("bits", width)


def sign_scale(diff: DataFrame, row: list[str], d: str = "d") -> DataFrame:
    """Of each row: scale, its mean magnitude, and how many of its signs are not negative."""
    return diff.groupBy(*row).agg(F.avg(F.abs(F.col(d).cast("double"))).alias("scale"), F.count_if(F.col(d) >= 0).alias("up"), F.count("*").alias("n"))


def approximate(diff: DataFrame, row: list[str], tensor: list[str], route: str, bits: int = 2, d: str = "d") -> DataFrame:
    """diff with approx, the difference as the route would keep it."""
    if route == "zero":
        return diff.withColumn("approx", F.lit(0.0))
    if route == "lossless":
        return diff.withColumn("approx", F.col(d).cast("double"))
    if route == "sign_scale":
        s = sign_scale(diff, row, d).select(*row, "scale")
        return beside(diff, s, row).withColumn("approx", F.when(F.col(d) >= 0, F.col("scale")).otherwise(-F.col("scale"))).drop("scale")
    keep = F.abs(F.col(d)) >= TINY if route == "sparse" else F.lit(True)
    width = min(bits + 2, 8) if route == "sparse" else bits
    group = tensor if route == "sparse" else row
    r = diff.filter(keep).groupBy(*group).agg(F.min(d).alias("lo"), F.max(d).alias("hi")).withColumn("p", affine.params(F.col("lo"), F.col("hi"), width)).select(*group, "p.*")
    q = affine.quantize(F.col(d), F.col("scale"), F.col("zero"), width)
    return beside(diff, r, group, "left").withColumn("approx", F.when(keep, affine.dequantize(q, F.col("scale"), F.col("zero"))).otherwise(0.0)).drop("scale", "zero")


def apply(approximated: DataFrame) -> DataFrame:
    """tuned: base plus the kept difference, in single precision."""
    return approximated.withColumn("tuned", (F.col("base").cast("float") + F.col("approx").cast("float")).cast("float"))


def missing_records(manifest: DataFrame, records: DataFrame, name: str = "tensor_name") -> DataFrame:
    """Names in a manifest without a record."""
    return manifest.select(name).join(records.select(name), name, "left_anti")
