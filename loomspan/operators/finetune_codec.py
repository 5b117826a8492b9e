"""A fine-tuned model kept as what differs from its base: routes by tensor, records by chunk."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, replace
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.codec import streams, tensors
from loomspan.codec.errors import CodecError
from loomspan.config import Config
from loomspan.operators.cells import beside
from loomspan.operators.compress import _rows, array_of
from loomspan.operators.finetune import TINY, membership

#: The route, and the name, of the record that tells what a table of differences holds; no tensor has this route.
MANIFEST = "manifest"
#: The columns of a table of differences. route is added for tensors that the base lacks; base_crc identifies the base's chunk.
DELTAS = "tensor_name string, dtype string, shape array<long>, chunk int, chunks int, first long, route string, base_crc long, meta string, payload binary"


def statistics(joined: DataFrame) -> DataFrame:
    """Sums over each chunk's differences, then over a tensor's: what its route depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                d = np.abs(_difference(r).astype(float).ravel())
                out.append({"tensor_name": r["tensor_name"], "axes": len(r["shape"]), "n": d.size, "none": int((d < TINY).sum()), "top": float(d.max(initial=0)), "s": float(d.sum()), "ss": float((d * d).sum())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tensor_name", pa.string()), ("axes", pa.int32()), ("n", pa.int64()), ("none", pa.int64()), *[(k, pa.float64()) for k in ("top", "s", "ss")]]))

    s = joined.mapInArrow(run, "tensor_name string, axes int, n long, none long, top double, s double, ss double").groupBy("tensor_name")
    s = s.agg(F.first("axes").alias("axes"), F.sum("n").alias("n"), F.sum("none").alias("none"), F.max("top").alias("max_abs"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    even = (mean >= 1e-10) & (std / F.greatest(mean, F.lit(1e-300)) < 2.0)
    return s.withColumn(
        "route",
        F.when(F.col("max_abs") < 1e-8, "zero")
        .when((F.col("n") >= 1024) & (F.col("axes") == 2) & even, "sign_scale")
        .when((F.col("none") / F.col("n") > 0.85) & (F.col("n") >= 512), "sparse")
        .when(F.col("n") < 512, "lossless")
        .otherwise("quantize"),
    )


def _difference(r: dict) -> np.ndarray:
    x, y = (array_of(r["dtype"], r["shape"], r["chunks"], r[k]) for k in ("data", "base"))
    return x.astype(np.float32) - y.astype(np.float32)


def encode_delta(d: np.ndarray, route: str, bits: int, config: Config) -> tuple[dict, bytes]:
    """A difference by its route."""
    if route == "zero":
        return {}, b""
    if route == "lossless":
        return {}, np.ascontiguousarray(d).tobytes()
    if route == "sign_scale":
        rows = d.reshape(d.shape[0], -1)
        scales = np.abs(rows).mean(1).astype(np.float16).tobytes()
        meta, body = streams.encode_symbols(np.packbits(rows.ravel() >= 0, bitorder="little"), config)
        return {"stream": meta}, struct.pack("<II", len(scales), len(body)) + scales + body
    if route == "sparse":
        flat = d.ravel()
        at = np.flatnonzero(np.abs(flat) >= TINY)
        one, first = streams.encode_symbols(np.diff(at, prepend=0).astype(np.int64), config)
        if not len(at):
            return {"index": one}, struct.pack("<III", len(first), 0, 0) + first
        width = min(bits + 2, 8)
        q, codes = tensors.quantize(flat[at], width, "symmetric", config, 0)
        two, second = streams.encode_symbols(codes, config, width)
        return {"index": one, "quantize": q, "values": two}, struct.pack("<III", len(first), len(second), len(at)) + first + second
    if route != "quantize":
        raise CodecError(f"no such route: {route}")
    meta: dict = {}
    x = d
    if d.ndim > 1:
        meta["normalize"], x = tensors.normalize(d, 0)
    meta["quantize"], codes = tensors.quantize(x, bits, "symmetric", replace(config, granularity="per_channel"), 0)
    meta["stream"], body = streams.encode_symbols(codes, config, bits)
    return meta, body


def decode_delta(meta: dict, data: bytes, route: str, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape))
    if route == "zero":
        return np.zeros(shape, np.float32)
    if route == "lossless":
        return np.frombuffer(data, np.float32).reshape(shape)
    if route == "sign_scale":
        a, b = struct.unpack_from("<II", data)
        scales = np.frombuffer(data[8 : 8 + a], np.float16).astype(np.float32)
        up = np.unpackbits(streams.decode_symbols(meta["stream"], data[8 + a : 8 + a + b]), count=n, bitorder="little")
        return (np.where(up.reshape(shape[0], -1) == 1, 1, -1) * scales[:, None]).astype(np.float32).reshape(shape)
    if route == "sparse":
        a, b, k = struct.unpack_from("<III", data)
        out = np.zeros(n, np.float32)
        if k:
            at = np.cumsum(streams.decode_symbols(meta["index"], data[12 : 12 + a]))
            out[at] = tensors.dequantize(meta["quantize"], streams.decode_symbols(meta["values"], data[12 + a : 12 + a + b]), (k,))
        return out.reshape(shape)
    x = tensors.dequantize(meta["quantize"], streams.decode_symbols(meta["stream"], data), shape)
    return (tensors.denormalize(meta["normalize"], x) if "normalize" in meta else x).astype(np.float32)


def compress(base: DataFrame, tuned: DataFrame, config: Config = Config()) -> DataFrame:
    """Tables of tensors to a table of differences; tensors that the base lacks, or that differ in type or shape, are kept whole.

    Chunks of shared tensors meet by name and chunk. Integers, and what has no difference to speak of, come back exactly.
    """
    from loomspan.codec.record import dump

    b = base.select(F.col("tensor_name").alias("_n"), F.col("chunk").alias("_c"), F.col("dtype").alias("_d"), F.col("shape").alias("_s"), F.col("data").alias("base"))
    on = (F.col("tensor_name") == F.col("_n")) & (F.col("chunk") == F.col("_c")) & (F.col("dtype") == F.col("_d")) & (F.col("shape") == F.col("_s"))
    joined = tuned.join(b, on, "left").drop("_n", "_c", "_d", "_s")
    routes = statistics(joined.filter("base is not null")).select("tensor_name", F.col("route").alias("_r"))
    joined = beside(joined, routes, ["tensor_name"], "left")
    names = DELTAS.replace(" string", "").replace(" array<long>", "").replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                whole = r["base"] is None or np.dtype(r["dtype"]).kind not in "f"
                route = "added" if whole else r["_r"]
                meta, payload = ({}, r["data"]) if whole else encode_delta(_difference(r), route, config.delta_bits, config)
                row = [r["tensor_name"], r["dtype"], r["shape"], r["chunk"], r["chunks"], r["first"], route, zlib.crc32(r["base"] or b""), dump(meta).decode(), payload]
                kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return joined.mapInArrow(run, DELTAS)


def restore(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """The fine-tuned tensors. A base that is not the one that was compressed against raises."""
    from loomspan.codec.record import load
    from loomspan.sources.tables import SCHEMA

    b = base.select(F.col("tensor_name").alias("_n"), F.col("chunk").alias("_c"), F.col("data").alias("base"))
    joined = deltas.filter(F.col("route") != MANIFEST).join(b, (F.col("tensor_name") == F.col("_n")) & (F.col("chunk") == F.col("_c")), "left").drop("_n", "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                if r["route"] == "added":
                    data = r["payload"]
                else:
                    if zlib.crc32(r["base"] or b"") != r["base_crc"]:
                        raise CodecError(f"{r['tensor_name']}: not the base of these differences")
                    x = array_of(r["dtype"], r["shape"], r["chunks"], r["base"])
                    d = decode_delta(load(r["meta"].encode()), r["payload"], r["route"], x.shape)
                    data = x.tobytes() if r["route"] == "zero" else (x.astype(np.float32) + d).astype(x.dtype).tobytes()
                row = [r["tensor_name"], r["dtype"], r["shape"], r["chunk"], r["chunks"], r["first"], data]
                kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["tensor_name", "dtype", "shape", "chunk", "chunks", "first", "data"])

    return joined.mapInArrow(run, SCHEMA)


def pack_manifest(told: dict) -> np.ndarray:
    """A manifest as a tensor of bytes: JSON with sorted keys."""
    return np.frombuffer(json.dumps(told, sort_keys=True, separators=(",", ":")).encode(), np.uint8)


def unpack_manifest(a: np.ndarray) -> dict:
    try:
        return json.loads(np.ascontiguousarray(a, np.uint8).tobytes())
    except ValueError as e:
        raise CodecError("not a manifest") from e


def with_manifest(base: DataFrame, deltas: DataFrame, base_id: str, config: Config = Config()) -> DataFrame:
    """A table of differences with a record more: a manifest, for those who have not got the base.

    It tells what is shared, added and removed with routes and sizes, the settings, and when it was made (UTC). It is one
    row, so it has the names of all tensors, which are metadata, and none of their cells.
    """
    rows = [r.asDict() for r in manifest(base, deltas).orderBy("tensor_name").toLocalIterator()]
    told = {"format_version": 1, "base_model_id": base_id, "config": asdict(config), "created_at": datetime.now(UTC).isoformat(), "tensors": rows}
    a = pack_manifest(told)
    row = (MANIFEST, "uint8", [len(a)], 0, 1, 0, MANIFEST, 0, "{}", bytearray(a.tobytes()))
    return deltas.unionByName(deltas.sparkSession.createDataFrame([row], DELTAS))


def inspect(deltas: DataFrame) -> dict:
    """The manifest of a table of differences, read without the base."""
    row = deltas.filter(F.col("route") == MANIFEST).select("payload").first()
    if row is None:
        raise CodecError("no manifest among the differences")
    return unpack_manifest(np.frombuffer(row[0], np.uint8))


def manifest(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """What a table of differences holds: each tensor's route and sizes, and those that the base has and it lacks (removed)."""
    deltas = deltas.filter(F.col("route") != MANIFEST)
    d = deltas.groupBy("tensor_name").agg(F.first("route").alias("route"), F.sum(F.octet_length("payload")).alias("payload_bytes"))
    return membership(base, deltas).join(d, "tensor_name", "left")
