"""Benchmarks of the codec over a table of tensors: a row of sizes, errors and rates for each tensor."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.codec import detect, tensors
from loomspan.codec.record import SIZE, dump
from loomspan.config import Config
from loomspan.operators.compress import _rows, array_of
from loomspan.operators.routing import skip_reason, tensor_role

#: What a worker measures of a chunk.
MEASURED = "tensor_name string, tensor_type int, dtype string, shape array<long>, raw_bytes long, payload_bytes long, metadata_bytes long, zstd_raw_bytes long, zstd_quantized_bytes long, quantized_bytes long, exact_kind string, n long, se double, max_abs double, top double, ab double, aa double, bb double, encode_s double, decode_s double"
TYPE_NAMES = ("WEIGHT", "KV_CACHE", "EMBEDDING", "ACTIVATION", "OPTIMIZER_STATE", "UNKNOWN", "BIAS", "MIXED_PRECISION", "MASK")


def median_seconds(f, repeats: int) -> tuple[float, object]:
    took, out = [], None
    for _ in range(repeats):
        t = time.perf_counter()
        out = f()
        took.append(time.perf_counter() - t)
    return float(np.median(took)), out


def measure(name: str, a: np.ndarray, whole: tuple[int, ...], config: Config, repeats: int, level: int) -> dict:
    """One chunk: its sizes beside those of zstd over the raw bytes and over plain quantized ones, its errors, its times."""
    kind = detect.detect(name, a, len(whole), whole)
    exact = detect.exact(name, a.nbytes if a.shape == whole else 1 << 62)
    encode_s, r = median_seconds(lambda: tensors.encode(name, a, kind, config, exact), repeats)
    decode_s, back = median_seconds(lambda: tensors.decode(r), repeats)
    raw = np.ascontiguousarray(a).tobytes()
    pack = zstandard.ZstdCompressor(level=level).compress
    quantized = None
    if a.dtype.kind == "f" and np.isfinite(a).all():
        quantized = tensors.quantize(a, config.bits, config.mode if config.mode != "none" else "symmetric", config, config.axis)[1].tobytes()
    x, y = a.astype(float).ravel(), back.astype(float).ravel()
    ok = np.isfinite(x)
    d = np.where(x == y, 0, np.abs(x - y))
    return {
        "tensor_name": name, "tensor_type": kind, "dtype": a.dtype.name, "shape": list(whole), "raw_bytes": a.nbytes, "payload_bytes": len(r.payload), "metadata_bytes": len(dump(r.meta)),
        "zstd_raw_bytes": len(pack(raw)), "zstd_quantized_bytes": quantized and len(pack(quantized)), "quantized_bytes": quantized and len(quantized), "exact_kind": r.meta.get("kind"), "n": a.size,
        "se": float((d[ok] ** 2).sum()), "max_abs": float(d[ok].max(initial=0)), "top": float(np.abs(x[ok]).max(initial=0)), "ab": float((x[ok] * y[ok]).sum()), "aa": float((x[ok] ** 2).sum()), "bb": float((y[ok] ** 2).sum()),
        "encode_s": encode_s, "decode_s": decode_s,
    }


def run(df: DataFrame, config: Config = Config(), label: str = "suite", repeats: int = 3, level: int = 3) -> DataFrame:
    """Benchmark rows of a table of tensors, one per tensor. Tensors that can't be measured are left to skipped()."""
    reason = skip_reason(F.octet_length("data"), F.col("dtype"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in MEASURED.split(", ")])
        for b in batches:
            rows = [measure(r["tensor_name"], array_of(r["dtype"], r["shape"], r["chunks"], r["data"]), tuple(r["shape"]), config, repeats, level) for r in _rows(b)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    m = df.filter(reason.isNull()).mapInArrow(work, MEASURED).groupBy("tensor_name")
    total = [F.sum(c).alias(c) for c in ("raw_bytes", "payload_bytes", "metadata_bytes", "zstd_raw_bytes", "zstd_quantized_bytes", "quantized_bytes", "n", "se", "ab", "aa", "bb", "encode_s", "decode_s")]
    m = m.agg(*[F.first(c).alias(c) for c in ("tensor_type", "dtype", "shape", "exact_kind")], F.count("*").alias("chunks"), F.max("max_abs").alias("max_abs_error"), F.max("top").alias("top"), *total)
    flat = (F.col("aa") == 0) | (F.col("bb") == 0)
    stored = F.col("payload_bytes") + F.col("metadata_bytes") + F.col("header_bytes")
    out = m.withColumn("header_bytes", SIZE * F.col("chunks")).withColumn("compressed_bytes", stored)
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    return out.select(
        F.concat(F.lit(f"{label}:"), "tensor_name").alias("benchmark_name"), "tensor_name", F.get(names, F.col("tensor_type")).alias("tensor_type"), F.array_join(F.col("shape").cast("array<string>"), "x").alias("tensor_shape"), "dtype",
        F.lit(config.to_json()).alias("config"), tensor_role(F.col("tensor_name")).alias("tensor_role"), "raw_bytes", "compressed_bytes", "payload_bytes", "metadata_bytes", "header_bytes", "zstd_raw_bytes", "zstd_quantized_bytes", "quantized_bytes",
        "exact_kind", (F.col("raw_bytes") / F.col("compressed_bytes")).alias("compression_ratio"), (F.col("raw_bytes") / F.col("zstd_raw_bytes")).alias("zstd_raw_ratio"), F.try_divide("raw_bytes", "zstd_quantized_bytes").alias("zstd_quantized_ratio"),
        (F.col("se") / F.col("n")).alias("mse"), "max_abs_error", (F.col("max_abs_error") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("relative_error"),
        F.when(flat, 1.0).otherwise(F.col("ab") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("aa") * F.col("bb")))).alias("cosine_similarity"),
        (F.col("raw_bytes") / F.col("encode_s")).alias("encode_rate"), (F.col("raw_bytes") / F.col("decode_s")).alias("decode_rate"), F.lit(config.layout).alias("backend_name"),
    )


def skipped(df: DataFrame) -> DataFrame:
    """Tensors that are not measured, with the reason."""
    reason = skip_reason(F.octet_length("data"), F.col("dtype"))
    return df.select("tensor_name", reason.alias("reason")).filter("reason is not null").distinct()


def synthetic(spark: SparkSession, seed: int = 2025) -> DataFrame:
    """A small transformer's tensors and three symbol streams, the same for a seed, as a table of tensors."""
    from loomspan.sources.tables import SCHEMA

    rng = np.random.default_rng(seed)
    normal = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
    made = {f"h.0.attn.{p}_proj.weight": normal(96, 96) for p in "qkvo"}
    made |= {"h.0.ln_1.bias": normal(96), "h.0.k_cache": normal(2, 6, 96, 16, s=0.02).cumsum(2).astype(np.float32), "mlp.gate_proj.half": normal(192, 96).astype(np.float16), "token_embed.weight": normal(512, 96)}
    made |= {
        "symbols.zipf": np.minimum(rng.zipf(1.35, (1024, 128)), 32_000).astype(np.int16),
        "symbols.gaussian": np.clip(rng.normal(0, 18, (1024, 128)).round(), -63, 63).astype(np.int16),
        "symbols.binary": rng.choice([0, 1], (2048, 128), p=[0.97, 0.03]).astype(np.int8),
    }
    rows = [(n, a.dtype.name, list(a.shape), 0, 1, 0, bytearray(np.ascontiguousarray(a).tobytes())) for n, a in made.items()]
    return spark.createDataFrame(rows, SCHEMA)
