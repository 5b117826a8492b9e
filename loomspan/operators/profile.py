"""Statistics of tensors: moments, sparsity, entropy, exact percentiles, error measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.cells import beside

#: Values nearer to zero than this count as zero.
TINY = 1e-6
#: Above so many values of a group, percentiles are narrowed down by counting instead of gathered.
GATHERED, BINS = 1_000_000, 1024


def profile(cells: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Count, mean, population deviation, least, largest and near-zero values of each group, in one aggregation."""
    v = F.col(x)
    near = F.abs(v) < TINY
    return cells.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.count_if(near).alias("near_zero"),
        F.avg(near.cast("double")).alias("sparsity"),
    )


def gaussian(cells: DataFrame, keys: list[str], x: str = "x", most_skew: float = 0.5, kurtosis: tuple[float, float] = (2.0, 4.5)) -> DataFrame:
    """Whether each group looks normal: skewness and kurtosis (3 for a normal) within limits, 16 values or more."""
    out = cells.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    ok = (F.col("n") >= 16) & (F.col("std") > 1e-12) & (F.abs("skew") <= most_skew) & F.col("kurt").between(*kurtosis)
    return out.withColumn("near_gaussian", F.coalesce(ok, F.lit(False)))


def value_entropy(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Shannon entropy of symbols, in bits each (bits) and in all (total_bits)."""
    counts = df.groupBy(*keys, symbol).agg(F.count("*").alias("c"))
    return _entropy(counts, keys)


def _entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    # with N = sum c: -sum(c / N log2(c / N)) = log2 N - sum(c log2 c) / N, without a second pass for N
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("symbols"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    bits = F.greatest(F.lit(0.0), F.log2("n") - F.col("s") / F.col("n"))
    return out.select(*keys, "n", "symbols", bits.alias("bits"), (bits * F.col("n")).alias("total_bits"))


def histogram_entropy(cells: DataFrame, keys: list[str], x: str = "x", most_bins: int = 256, least_bins: int = 8) -> DataFrame:
    """Entropy of real values over equal bins from least to largest: sqrt(n) of them, within limits; 0 for a constant."""
    r = cells.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    r = r.withColumn("bins", F.least(F.lit(most_bins), F.greatest(F.lit(least_bins), F.floor(F.sqrt("n")))))
    j = beside(cells, r.select(*keys, "lo", "hi", "bins"), keys)
    at = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counts = j.withColumn("bin", F.when(F.col("hi") > F.col("lo"), at).otherwise(0)).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    return _entropy(counts, keys).select(*keys, "n", "bits")


def percentiles(cells: DataFrame, keys: list[str], x: str, at: list[float], gathered: int = GATHERED) -> DataFrame:
    """Exact percentiles (0 to 1) with linear interpolation: keys, then p0, p1, ... in the order of at.

    The built-in aggregate keeps all of a group's values in one task. So groups of over gathered values are narrowed down
    instead: each round counts the values of a group within BINS parts of what is left around each wanted rank,
    until that is few values or one. A round sends BINS counts a group, task and range. What is left of the ranks, a few rows
    per gathered values at most, is broadcast: the cells of a large group stay where they are.
    """
    sizes = cells.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    large = _kept(sizes.filter(F.col("n") > gathered))
    # one aggregate for all, as each keeps the counts of all values
    wanted = F.expr(f"percentile({x}, array({', '.join(f'{p!r}D' for p in at)}))").alias("_p")
    none = large.isEmpty()
    few = cells if none else _meet(cells, large.select(*keys), keys, how="left_anti")
    out = few.groupBy(*keys).agg(wanted).select(*keys, *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(len(at))])
    if none:
        return out
    narrowed = _narrowed(cells.filter(F.col(x).isNotNull()), large, keys, x, at, gathered)
    return out.unionByName(narrowed) if keys else narrowed


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _meet(df: DataFrame, small: DataFrame, keys: list[str], also: Column | None = None, how: str = "inner") -> DataFrame:
    """df joined to small by keys, of which nulls are equal, and by also; small is sent to every task."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True) if also is None else also)
    return df.join(F.broadcast(small.withColumnsRenamed(names)), on, how).drop(*names.values())


def _place(v: Column) -> Column:
    """The order of magnitude of a value, with its sign: never falls where values rise."""
    return F.when(v > 0, F.least(F.log2(v) + 1075, F.lit(2100.0))).when(v < 0, -F.least(F.log2(-v) + 1075, F.lit(2100.0))).otherwise(0.0)


def _narrowed(cells: DataFrame, large: DataFrame, keys: list[str], x: str, at: list[float], few: int) -> DataFrame:
    rank = [F.struct(F.lit(i).alias("_i"), F.floor((F.col("n") - 1) * p).alias("_k"), ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)).alias("_w")) for i, p in enumerate(at)]
    want = large.select(*keys, "n", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.array(*rank)).alias("_r")).select(*keys, "_lo", "_hi", "_r.*")
    want = want.withColumn("_up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_k", F.col("_k") + F.col("_up")).withColumn("_c", F.lit(1 << 62))
    span = [*keys, "_lo", "_hi"]
    values = cells.select(*keys, F.col(x).cast("double").alias("_v"))
    wide = (F.col("_c") > few) & (F.col("_hi") > F.col("_lo"))

    def inside(ranks: DataFrame) -> DataFrame:
        """The values within each range; ranks of the same range count them once."""
        return _meet(values, ranks.select(*span).distinct(), keys, F.expr("_v between _lo and _hi"))

    # parts of equal width and of equal magnitude by turns: one or the other shrinks any range, infinite or skewed
    for turn in range(12):
        want = _kept(want)
        todo = want.filter(wide)
        if todo.isEmpty():
            break
        v, lo, hi = (_place(F.col(c)) if turn % 2 else F.col(c) for c in ("_v", "_lo", "_hi"))
        part = F.when(hi > lo, F.least(F.lit(BINS - 1), F.floor((v - lo) / (hi - lo) * BINS))).otherwise(0)
        counts = inside(todo).groupBy(*span, part.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        counts = counts.withColumn("_before", F.sum("_c").over(W.partitionBy(*span).orderBy("_b")) - F.col("_c"))
        met = _meet(counts, todo.drop("_c"), span).filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))
        less = met.select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_i", (F.col("_k") - F.col("_before")).alias("_k"), "_w", "_up", "_c")
        want = want.filter(~wide).unionByName(less)
    left = inside(want).groupBy(*span, "_v").agg(F.count("*").alias("_c"))
    left = left.withColumn("_upto", F.sum("_c").over(W.partitionBy(*span).orderBy("_v")))
    got = _meet(left, want.drop("_c"), span).filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
    each = got.groupBy(*keys, "_i").agg(F.max(F.when(F.col("_up") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_up") == 1, F.col("_v"))).alias("_b"), F.max("_w").alias("_w"))
    a, b, w = F.col("_a"), F.coalesce("_b", "_a"), F.col("_w")
    far = (1 - w) * a + w * b  # one of them is infinite, or the step between them
    value = F.when((a == b) | (w == 0), a).when(F.abs(b - a) == float("inf"), far).otherwise(a + (b - a) * w)
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(f"p{i}") for i in range(len(at))])


def errors(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Of a against its copy b: mean squared, largest absolute and relative error, cosine (1 if either is all zero)."""
    d = F.abs(a - b)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.max(d).alias("max_abs"), F.max(F.abs(a)).alias("top"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    cosine = F.when((F.col("aa") == 0) | (F.col("bb") == 0), 1.0).otherwise(F.col("ab") / F.sqrt(F.when((F.col("aa") == 0) | (F.col("bb") == 0), 1.0).otherwise(F.col("aa") * F.col("bb"))))
    relative = F.col("max_abs") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))
    return out.select(*keys, "n", "mse", "max_abs", relative.alias("relative"), cosine.alias("cosine"))


def bundle_errors(per_tensor: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of a bundle from those of its tensors: mean of the squared, largest of the others, least cosine."""
    return per_tensor.groupBy(*keys).agg(F.avg("mse").alias("mse"), F.max("max_abs").alias("max_abs"), F.max("relative").alias("relative"), F.min("cosine").alias("cosine"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
