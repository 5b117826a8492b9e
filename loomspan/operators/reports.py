"""Benchmark rows: effective sizes, aggregates by group, comparison with a baseline, rankings, cohorts.

A row has: benchmark_name, tensor_name, tensor_type, model_id, model_revision, raw_bytes, compressed_bytes, container_bytes,
container_overhead_bytes, payload_bytes, metadata_bytes, header_bytes, zstd_raw_bytes, zstd_quantized_bytes,
compression_ratio, mse, max_abs_error, relative_error, cosine_similarity, encode_rate, decode_rate, exact_kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.codec.record import SIZE, dump
from loomspan.codec.streams import EXACT_KINDS

#: Kinds of exact storage in reports of other programs, and the thresholds of a regression.
FOREIGN_EXACT = ("raw", "const", "aseq", "bseq", "lossless")
EXACT = tuple(dict.fromkeys(EXACT_KINDS + FOREIGN_EXACT))
RATIO_DROP, ERROR_RISE, RATE_DROP = 0.05, 0.10, 0.10
#: Types that a summary shows of their own, and the size up to which exact rows are taken as stored one by one.
SPOTLIGHTS, TINY = ("mask", "bias", "mixed_precision"), 4096


def effective_bytes() -> Column:
    """Bytes in the container if known and not 0, else compressed ones."""
    return F.coalesce(F.nullif(F.col("container_bytes"), F.lit(0)), F.col("compressed_bytes"))


def overhead_bytes() -> Column:
    return F.coalesce(F.col("container_overhead_bytes"), F.coalesce("metadata_bytes", F.lit(0)) + F.coalesce("header_bytes", F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _measures() -> list[Column]:
    eff, over, raw = F.col("eff"), F.col("over"), F.col("raw_bytes")
    own = F.coalesce(ratio(raw, eff), F.lit(0.0))
    out = [
        F.count("*").alias("rows"),
        F.sum(raw).alias("raw_bytes_total"),
        F.sum(eff).alias("compressed_bytes_total"),
        F.sum("zstd_raw_bytes").alias("zstd_raw_bytes_total"),
        F.sum("zstd_quantized_bytes").alias("zstd_quantized_bytes_total"),
        F.coalesce(ratio(F.sum(raw), F.sum(eff)), F.lit(0.0)).alias("aggregate_compression_ratio"),
        ratio(F.sum(raw), F.sum("zstd_raw_bytes")).alias("aggregate_zstd_raw_ratio"),
        ratio(F.sum(raw), F.sum("zstd_quantized_bytes")).alias("aggregate_zstd_quantized_ratio"),
        F.max("max_abs_error").alias("max_abs_error_max"),
        F.max("relative_error").alias("relative_error_max"),
        F.percentile("cosine_similarity", 0.05).alias("p5_cosine_similarity"),
    ]
    for name, c in (
        ("compression_ratio", own),
        ("mse", F.col("mse")),
        ("cosine_similarity", F.col("cosine_similarity")),
        ("encode_rate", F.col("encode_rate")),
        ("decode_rate", F.col("decode_rate")),
        ("overhead_bytes", over),
    ):
        out += [F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}")]
    for other in ("raw", "quantized"):
        z = F.col(f"zstd_{other}_bytes")
        share = ratio(z - eff, z)
        out += [
            F.count_if(z - eff > 0).alias(f"wins_vs_zstd_{other}"),
            F.avg(z - eff).alias(f"mean_saved_vs_zstd_{other}"),
            F.median(z - eff).alias(f"median_saved_vs_zstd_{other}"),
            F.avg(share).alias(f"mean_share_saved_vs_zstd_{other}"),
            F.median(share).alias(f"median_share_saved_vs_zstd_{other}"),
        ]
    return out


def aggregates(results: DataFrame) -> DataFrame:
    """33 measures by model and revision, by tensor type, and over the run, in one pass of grouping sets.

    level says which: model, type or run. Rows without a model are synthetic.
    """
    r = results.withColumns({"eff": effective_bytes(), "over": overhead_bytes(), "model": F.coalesce(F.nullif("model_id", F.lit("")), F.lit("synthetic")), "revision": F.coalesce("model_revision", F.lit(""))})
    m, v, t = F.col("model"), F.col("revision"), F.col("tensor_type")
    level = F.when(F.grouping("model") == 0, "model").when(F.grouping("tensor_type") == 0, "type").otherwise("run")
    out = r.groupingSets([[m, v], [t], []], m, v, t).agg(level.alias("level"), *_measures())
    return out


def compare(baseline: DataFrame, current: DataFrame, ratio_drop: float = RATIO_DROP, error_rise: float = ERROR_RISE, rate_drop: float = RATE_DROP) -> DataFrame:
    """(benchmark_name, failure) of each threshold that a current row breaks, or of a current row that the baseline lacks."""
    cols = ("compression_ratio", "mse", "max_abs_error", "encode_rate", "decode_rate")
    b = baseline.select("benchmark_name", F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = current.select("benchmark_name", *cols).join(b, "benchmark_name", "left")
    both = F.col("_b")
    fails = [
        F.when(F.col("_b").isNull(), "missing baseline"),
        F.when(both & (F.col("compression_ratio") < F.col("b_compression_ratio") * (1.0 - ratio_drop)), "compression ratio"),
        F.when(both & (F.col("mse") > F.col("b_mse") * (1.0 + error_rise)), "mse"),
        F.when(both & (F.col("max_abs_error") > F.col("b_max_abs_error") * (1.0 + error_rise)), "max abs error"),
        F.when(both & (F.col("encode_rate") < F.col("b_encode_rate") * (1.0 - rate_drop)), "encode rate"),
        F.when(both & (F.col("decode_rate") < F.col("b_decode_rate") * (1.0 - rate_drop)), "decode rate"),
    ]
    return j.select("benchmark_name", F.explode(F.array_compact(F.array(*fails))).alias("failure"))


def worst_vs_quantized(results: DataFrame, k: int) -> DataFrame:
    """The k rows that lose most to the quantized baseline, then to the raw one, then by name."""
    e = results.filter("zstd_quantized_bytes is not null").withColumn("eff", effective_bytes())
    e = e.withColumn("loss_quantized", F.col("eff") - F.col("zstd_quantized_bytes")).withColumn("loss_raw", F.col("eff") - F.coalesce("zstd_raw_bytes", F.lit(0)))
    return e.orderBy(F.desc("loss_quantized"), F.desc("loss_raw"), "benchmark_name").limit(k)


def spotlight_deltas(baseline: DataFrame, current: DataFrame, types: list[str], k: int) -> DataFrame:
    """The k rows of these types that gained most bytes over the baseline."""
    b = baseline.select("benchmark_name", F.col("compressed_bytes").alias("before"))
    j = current.filter(F.col("tensor_type").isin(types)).join(b, "benchmark_name").withColumn("saved", F.col("before") - F.col("compressed_bytes"))
    return j.orderBy(F.desc("saved"), F.desc("tensor_type"), F.desc("benchmark_name")).limit(k)


def _json_length(text: Column) -> Column:
    """How long a text is as JSON in ASCII, without its quotes."""
    for characters, written in (("[\\x{10000}-\\x{10FFFF}]", "u" * 12), ("[^\\x00-\\x7F]", "u" * 6), ("[\"\\\\\\x08-\\x0A\\x0C\\x0D]", "uu"), ("[\\x00-\\x1F]", "u" * 6)):
        text = F.regexp_replace(text, characters, written)
    return F.length(text)


def stored_bytes() -> Column:
    """Bytes of a row's record in a container of its own: two segments, their metadata with these lengths, the payload."""
    payload, meta, raw = (F.coalesce(F.col(c), F.lit(0)) for c in ("payload_bytes", "metadata_bytes", "raw_bytes"))
    record = {"chunk_count": 1, "chunk_lengths": [0], "header": bytes(SIZE), "metadata": b"", "name": "", "original_nbytes": 0, "record_id": 0}
    fixed = len(dump(record)) + len(dump({"index": 0, "length": 0, "record_id": 0})) - 3 + 2 * 24
    digits = lambda c: F.length(c.cast("string"))
    return fixed + 2 * digits(payload) + digits(raw) + 4 * F.ceil(meta / 3) + _json_length(F.col("tensor_name")) + payload


def summary_bytes() -> Column:
    """Bytes that summaries compare: those in the container if known, else of small exact rows what they would take in one, else compressed ones."""
    return F.coalesce("container_bytes", F.when(is_exact() & (F.col("raw_bytes") <= TINY), stored_bytes()).otherwise(F.col("compressed_bytes")))


def summary_overhead() -> Column:
    """The part of summary_bytes that is not payload."""
    apart = stored_bytes() - F.coalesce("payload_bytes", F.lit(0))
    known = F.coalesce("metadata_bytes", F.lit(0)) + F.coalesce("header_bytes", F.lit(0))
    return F.coalesce("container_overhead_bytes", F.when(is_exact() & (F.col("raw_bytes") <= TINY), apart).otherwise(known))


def spotlights(results: DataFrame, types: list[str], k: int) -> DataFrame:
    """The k rows of these types that lose most to the raw baseline, then to the quantized one, then the largest; a row without one comes last."""
    e = results.filter(F.col("tensor_type").isin(types)).withColumn("eff", summary_bytes())
    loss = [F.desc_nulls_last(F.col("eff") - F.nullif(f"zstd_{z}_bytes", F.lit(0))) for z in ("raw", "quantized")]
    return e.orderBy(*loss, F.desc("eff"), "benchmark_name").limit(k)


def summary(results: DataFrame, worst: int = 8, spotlight: int = 8, tiny: int = TINY) -> dict[str, DataFrame]:
    """Tables of a summary by title: aggregates, worst rows, small exact rows, spotlights."""
    a, shown = aggregates(results), ["benchmark_name", "tensor_type", "raw_bytes", "eff", "zstd_raw_bytes", "zstd_quantized_bytes"]
    columns = ["rows", "raw_bytes_total", "compressed_bytes_total", "aggregate_compression_ratio", "mean_mse", "mean_cosine_similarity", "mean_overhead_bytes", "median_overhead_bytes"]
    out = {"overall": a.filter("level = 'run'").select(columns)}
    out["by model"] = a.filter("level = 'model'").select("model", "revision", *columns).orderBy("model", "revision")
    out["by type"] = a.filter("level = 'type'").select("tensor_type", *columns).orderBy("tensor_type")
    out["worst against the quantized baseline"] = worst_vs_quantized(results.withColumn("container_bytes", summary_bytes()), worst).select(shown)
    out[f"exact rows of up to {tiny} bytes"] = tiny_cohort(results.withColumns({"container_bytes": summary_bytes(), "container_overhead_bytes": summary_overhead()}), tiny)
    for t in SPOTLIGHTS:
        out[f"spotlight: {t}"] = spotlights(results.filter(F.lower("tensor_type") == t), [t, t.upper()], spotlight).select(shown)
    return out


def summary_deltas(baseline: DataFrame, current: DataFrame, spotlight: int = 8, tiny: int = TINY) -> dict[str, DataFrame]:
    """Tables of what changed: aggregates of the run and of the spotlit types, small exact rows, spotlit rows."""
    key, named = F.coalesce("tensor_type", F.lit("run")), ["rows", "compressed_bytes_total", "aggregate_compression_ratio"]

    def totals(r: DataFrame, name: str) -> DataFrame:
        a = aggregates(r).filter((F.col("level") == "run") | (F.col("level") == "type") & F.lower("tensor_type").isin(*SPOTLIGHTS))
        return a.select(key.alias("of"), *[F.col(c).alias(f"{c}_{name}") for c in named])

    def small(r: DataFrame, name: str) -> DataFrame:
        c = tiny_cohort(r.withColumns({"container_bytes": summary_bytes(), "container_overhead_bytes": summary_overhead()}), tiny)
        return c.select(F.lit(name).alias("of"), "*")

    rows = spotlight_deltas(baseline, current, [x for t in SPOTLIGHTS for x in (t, t.upper())], spotlight)
    return {
        "aggregates": totals(baseline, "before").join(totals(current, "after"), "of").orderBy("of"),
        f"exact rows of up to {tiny} bytes": small(baseline, "before").unionByName(small(current, "after")),
        "spotlights": rows.select("benchmark_name", "tensor_type", "before", "compressed_bytes", "saved"),
    }


def is_exact() -> Column:
    free = (F.col("mse") == 0) & (F.col("max_abs_error") == 0) & (F.col("relative_error") == 0)
    return F.when(F.col("exact_kind").isNotNull(), F.col("exact_kind").isin(*EXACT)).otherwise(free)


def tiny_cohort(results: DataFrame, most_bytes: int) -> DataFrame:
    """Overhead of the small exact rows: how many, mean and upper median of its share, mean bytes."""
    t = results.filter((F.col("raw_bytes") <= most_bytes) & is_exact()).withColumns({"eff": effective_bytes(), "over": overhead_bytes()})
    t = t.withColumn("share", F.coalesce(ratio(F.col("over"), F.col("eff")), F.lit(0.0)))
    return t.agg(F.count("*").alias("rows"), F.avg("share").alias("mean_share"), upper_median("share").alias("median_share"), F.avg("over").alias("mean_overhead"))


def upper_median(name: str) -> Column:
    """The middle value of an odd number, the upper of the two of an even one: counted from the top, the first half ends there."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def with_container(results: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with what the container holds of their tensor; rows without a record stay as they are."""
    r = records.groupBy(F.col("tensor_name").alias("_t")).agg(F.sum("storage_bytes").alias("_s"), F.sum("payload_bytes").alias("_p"))
    j = results.join(r, F.col("tensor_name") == F.col("_t"), "left")
    j = j.withColumn("container_bytes", F.coalesce("_s", "container_bytes"))
    return j.withColumn("container_overhead_bytes", F.coalesce(F.col("_s") - F.col("_p"), "container_overhead_bytes")).drop("_t", "_s", "_p")


def reasons(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    return skipped.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))
