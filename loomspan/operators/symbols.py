"""Symbol streams: frequency tables, runs, sequences, and how bits and bytes are shared out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.cells import beside

TOTAL = 1 << 16


def frequencies(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*keys, F.col(symbol).alias("symbol")).agg(F.count("*").alias("c"))


def cumulative(freq: DataFrame, keys: list[str], f: str = "c") -> DataFrame:
    """before: the sum of the frequencies of lesser symbols. A window holds one table, as large as its alphabet."""
    return freq.withColumn("before", F.coalesce(F.sum(f).over(W.partitionBy(*keys).orderBy("symbol").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def normalized(freq: DataFrame, keys: list[str], total: int = TOTAL) -> DataFrame:
    """f: frequencies scaled to add up to total, each at least 1.

    Scaled down to whole numbers, 1 at least. What is missing goes one by one to the symbols in the order of their counts,
    largest first, ties by symbol, round and round; in closed form from a row number. Too much (more symbols at 1 than
    there is room for) comes off the largest f in passes over (f largest first, symbol): pass by pass each symbol above
    1 loses one. The number of whole passes is found by counting, so it is closed too: after r passes a symbol has
    max(1, f - r) left. Alphabets of over total symbols raise.
    """
    one = W.partitionBy(*keys)
    s = freq.withColumn("n", F.sum("c").over(one)).withColumn("k", F.count("*").over(one))
    s = s.withColumn("f0", F.when(F.col("k") > total, F.raise_error(F.lit("more symbols than the total")).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(F.col("c") * float(total) / F.col("n")))))
    s = s.withColumn("gap", F.lit(total) - F.sum("f0").over(one))
    s = s.withColumn("rank", F.row_number().over(one.orderBy(F.desc("c"), "symbol")) - 1)
    more = F.floor(F.col("gap") / F.col("k")) + F.when(F.col("rank") < F.pmod("gap", "k"), 1).otherwise(0)
    # over: sorted by f0, taking r whole passes removes sum(min(r, f0 - 1)); with the spare s = f0 - 1 in rising order, the
    # first place where the passes up to that spare remove enough fixes r, from what is already fully removed
    up = one.orderBy("f0", F.desc("symbol"))
    spare = F.col("f0") - 1
    s = s.withColumn("gone", F.coalesce(F.sum(spare).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left", F.count("*").over(up.rowsBetween(0, W.unboundedFollowing)))
    enough = F.when(F.col("gone") + F.col("left") * spare >= -F.col("gap"), F.struct(F.row_number().over(up).alias("at"), F.floor((-F.col("gap") - F.col("gone")) / F.col("left")).alias("r")))
    s = s.withColumn("e", enough).withColumn("r", F.coalesce(F.min("e").over(one)["r"], F.lit(0)))
    s = s.withColumn("rest", -F.col("gap") - F.sum(F.least(F.col("r"), spare)).over(one))
    after = F.greatest(F.lit(1), F.col("f0") - F.col("r"))
    last = F.row_number().over(one.orderBy(F.desc(F.when(after > 1, after)), "symbol"))
    less = after - F.when((last <= F.col("rest")) & (after > 1), 1).otherwise(0)
    f = F.when(F.col("gap") >= 0, F.col("f0") + more).otherwise(less)
    return s.select(*keys, "symbol", "c", f.cast("long").alias("f"))


def runs(df: DataFrame, keys: list[str], order: str, symbol: str) -> DataFrame:
    """Maximal runs of equal symbols in order: keys, run, symbol, start, length."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(symbol).over(w).eqNullSafe(F.col(symbol)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "run").agg(F.first(symbol).alias("symbol"), F.min(order).alias("start"), F.count("*").alias("length"))


def arithmetic(df: DataFrame, keys: list[str], idx: str, x: str) -> DataFrame:
    """Whether x = start + step * idx throughout each group, with the start and step of its two first cells."""
    ends = df.groupBy(*keys).agg(F.min_by(x, idx).alias("start"), F.min(idx).alias("i0"), F.max_by(x, idx).alias("end"), F.max(idx).alias("i1"))
    step = F.when(F.col("i1") > F.col("i0"), (F.col("end") - F.col("start")) / (F.col("i1") - F.col("i0"))).otherwise(F.lit(0.0))
    j = beside(df, ends.select(*keys, F.col("start").alias("_s"), "i0", step.alias("_step")), keys)
    ok = F.col(x) == F.col("_s") + (F.col(idx) - F.col("i0")) * F.col("_step")
    return j.groupBy(*keys).agg(F.first("_s").alias("start"), F.first("_step").alias("step"), F.count("*").alias("n"), F.bool_and(ok).alias("arithmetic"))


def allocate_bits(entropy: DataFrame, name: str, target: int, least: int = 2, most: int = 8) -> DataFrame:
    """bits of each tensor: least each, the rest of target * n shared by entropy, by largest remainder, most at most.

    What is left over goes one by one in the order of remainder, entropy and name, round and round past those that are full.
    The table has a row per tensor; the rounds are a bounded number of windows over it, as no tensor takes more than most.
    """
    everything = W.partitionBy(F.lit(0))
    e = entropy.select(F.col(name).alias("name"), F.greatest(F.col("bits"), F.lit(1e-9)).alias("h"))
    n = F.count("*").over(everything)
    share = F.col("h") / F.sum("h").over(everything) * (n * (target - least))
    e = e.withColumn("share", share).withColumn("extra", F.least(F.floor("share"), F.lit(most - least)))
    e = e.withColumn("turn", F.row_number().over(everything.orderBy(F.desc(F.col("share") - F.floor("share")), F.desc("h"), "name")))
    e = e.withColumn("over", F.least(n * (target - least), n * (most - least)) - F.sum("extra").over(everything))
    room = F.lit(most - least) - F.col("extra")
    e = e.withColumn("room", room)
    for _ in range(most - least):
        free = F.sum(F.when(F.col("room") > 0, 1).otherwise(0)).over(everything.orderBy("turn"))
        e = e.withColumn("gets", F.when((F.col("room") > 0) & (free <= F.col("over")), 1).otherwise(0))
        e = e.withColumn("over", F.col("over") - F.sum("gets").over(everything))
        e = e.withColumn("extra", F.col("extra") + F.col("gets")).withColumn("room", F.col("room") - F.col("gets"))
    return e.select(F.col("name").alias(name), "h", (F.col("extra") + least).cast("int").alias("bits"))


def share_bytes(df: DataFrame, keys: list[str], order: str, total: str) -> DataFrame:
    """share: total divided over a group's rows; the first ones take the remainder, a byte each."""
    one = W.partitionBy(*keys)
    n = F.count("*").over(one)
    return df.withColumn("share", (F.floor(F.col(total) / n) + F.when(F.row_number().over(one.orderBy(order)) <= F.pmod(F.col(total), n), 1).otherwise(0)).cast("long"))


def chunks(df: DataFrame, data: str, size: int) -> DataFrame:
    """A binary column cut to pieces: index and part; an empty value gives one empty part."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(data) - 1), F.lit(size))
    return df.select("*", F.posexplode(starts).alias("index", "_at")).withColumn("part", F.substring(F.col(data), F.col("_at") + 1, F.lit(size))).drop("_at", data)
