"""Compression of tables of tensors (see sources.tables): every chunk is a record of its own, made and read in Arrow workers.

A tensor's chunks are cut between slices of its first axis, so channels along that axis stay whole. Chunks are independent:
a lost executor costs the chunks it had, and no task holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.codec import detect, tensors
from loomspan.codec.record import Record, dump, load
from loomspan.config import Config
from loomspan.operators.cells import beside
from loomspan.operators.symbols import allocate_bits
from loomspan.sources import container

#: The columns of a table of records.
RECORDS = "tensor_name string, dtype string, shape array<long>, chunk int, chunks int, first long, tensor_type int, mode int, strategy int, checksum long, nbytes long, meta string, payload binary"


def array_of(dtype: str, shape: list[int], chunks: int, data: bytes) -> np.ndarray:
    """The part of a tensor that a row holds."""
    a = np.frombuffer(data, dtype)
    return a.reshape(tuple(shape) if chunks == 1 else (-1, *shape[1:]))


def encode(df: DataFrame, config: Config = Config(), allocate: bool = False) -> DataFrame:
    """Tensors to records. The type of a tensor is told from its first chunk, so that all chunks have the same.

    allocate: bits by entropy, config.bits a tensor on average; that takes a pass over the values first.
    """
    first = df.filter("chunk = 0").mapInArrow(_types, "tensor_name string, tensor_type int")
    rows = beside(df, first, ["tensor_name"])
    if allocate:
        bits = allocate_bits(entropies(df), "tensor_name", config.bits).select("tensor_name", "bits")
        rows = beside(rows, bits, ["tensor_name"], "left")
    else:
        rows = rows.withColumn("bits", F.lit(None).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                a = array_of(row["dtype"], row["shape"], row["chunks"], row["data"])
                whole = a.nbytes if row["chunks"] == 1 else 1 << 62
                r = tensors.encode(row["tensor_name"], a, row["tensor_type"], config, detect.exact(row["tensor_name"], whole), row["bits"])
                yield _batch(row, r)

    return rows.mapInArrow(run, RECORDS)


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(b)):
        yield {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}


def _batch(row: dict, r: Record) -> pa.RecordBatch:
    meta = dump(r.meta | {"part": list(r.shape)}).decode()
    out = {k: row[k] for k in ("tensor_name", "dtype", "shape", "chunk", "chunks", "first")}
    out |= {"tensor_type": r.tensor_type, "mode": r.mode, "strategy": r.strategy, "checksum": r.checksum, "nbytes": r.nbytes, "meta": meta, "payload": r.payload}
    ints = {"chunk", "chunks", "tensor_type", "mode", "strategy"}
    cols = {k: pa.array([v], pa.int32() if k in ints else pa.list_(pa.int64()) if k == "shape" else pa.binary() if k == "payload" else pa.string() if isinstance(v, str) else pa.int64()) for k, v in out.items()}
    return pa.RecordBatch.from_pydict(cols)


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, kinds = [], []
        for row in _rows(b):
            a = array_of(row["dtype"], row["shape"], row["chunks"], row["data"])
            names.append(row["tensor_name"])
            kinds.append(detect.detect(row["tensor_name"], a, len(row["shape"]), tuple(row["shape"])))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.int32())], ["tensor_name", "tensor_type"])


def entropies(df: DataFrame, bins: int = 256) -> DataFrame:
    """Entropy of each tensor's values over equal bins: ranges first, then counts of bins, both summed from the chunks."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["tensor_name"], x.size, float(x.min()), float(x.max())) for r in _rows(b) for x in [array_of(r["dtype"], r["shape"], r["chunks"], r["data"])] if x.size]
            yield pa.RecordBatch.from_pylist([dict(zip(("tensor_name", "n", "lo", "hi"), o)) for o in out], pa.schema([("tensor_name", pa.string()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("tensor_name", pa.string()), ("bin", pa.int32()), ("c", pa.int64())])
        for b in batches:
            out = []
            for r in _rows(b):
                x = array_of(r["dtype"], r["shape"], r["chunks"], r["data"]).ravel().astype(float)
                k = min(bins, max(8, int(r["n"] ** 0.5)))
                at = np.minimum((x - r["lo"]) / (r["hi"] - r["lo"]) * k, k - 1).astype(int) if r["hi"] > r["lo"] else np.zeros(x.size, int)
                out += [{"tensor_name": r["tensor_name"], "bin": i, "c": int(c)} for i, c in enumerate(np.bincount(at)) if c]
            yield pa.RecordBatch.from_pylist(out, kind)

    r = df.mapInArrow(ranges, "tensor_name string, n long, lo double, hi double").groupBy("tensor_name").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    j = beside(df, r, ["tensor_name"]).mapInArrow(counts, "tensor_name string, bin int, c long").groupBy("tensor_name", "bin").agg(F.sum("c").alias("c"))
    s = j.groupBy("tensor_name").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return s.select("tensor_name", F.greatest(F.lit(0.0), F.log2("n") - F.col("s") / F.col("n")).alias("bits"))


def record_of(row: dict) -> Record:
    meta = load(row["meta"].encode())
    part = tuple(meta.pop("part"))
    return Record(row["tensor_name"], row["tensor_type"], row["dtype"], part, row["mode"], row["strategy"], row["checksum"], meta, row["payload"], row["nbytes"])


def decode(records: DataFrame) -> DataFrame:
    """Records to tensors."""
    from loomspan.sources.tables import SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                a = tensors.decode(record_of(row))
                yield pa.RecordBatch.from_pydict(
                    {
                        "tensor_name": pa.array([row["tensor_name"]]),
                        "dtype": pa.array([row["dtype"]]),
                        "shape": pa.array([row["shape"]], pa.list_(pa.int64())),
                        "chunk": pa.array([row["chunk"]], pa.int32()),
                        "chunks": pa.array([row["chunks"]], pa.int32()),
                        "first": pa.array([row["first"]], pa.int64()),
                        "data": pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()),
                    }
                )

    return records.mapInArrow(run, SCHEMA)


def summary(records: DataFrame) -> DataFrame:
    """Bytes before and after of each tensor, and the ratio."""
    stored = F.octet_length("payload") + F.octet_length("meta") + 64
    s = records.groupBy("tensor_name").agg(F.first("tensor_type").alias("tensor_type"), F.sum("nbytes").alias("raw_bytes"), F.sum(stored).alias("compressed_bytes"))
    return s.withColumn("ratio", F.col("raw_bytes") / F.col("compressed_bytes"))


def errors(df: DataFrame, back: DataFrame) -> DataFrame:
    """Errors of each tensor against what came back: sums from each chunk, put together by tensor."""
    j = df.join(back.select(F.col("tensor_name").alias("_n"), F.col("chunk").alias("_c"), F.col("data").alias("back")), (F.col("tensor_name") == F.col("_n")) & (F.col("chunk") == F.col("_c")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                x, y = (array_of(r["dtype"], r["shape"], r["chunks"], r[k]).ravel().astype(float) for k in ("data", "back"))
                same = x == y
                d = np.where(same, 0, np.abs(x - y))
                fin = np.isfinite(x)
                out.append({"tensor_name": r["tensor_name"], "n": x.size, "se": float((d * d).sum()), "top": float(d.max(initial=0)), "ab": float((x[fin] * y[fin]).sum()), "aa": float((x[fin] ** 2).sum()), "bb": float((y[fin] ** 2).sum())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tensor_name", pa.string()), ("n", pa.int64()), *[(k, pa.float64()) for k in ("se", "top", "ab", "aa", "bb")]]))

    s = j.mapInArrow(run, "tensor_name string, n long, se double, top double, ab double, aa double, bb double").groupBy("tensor_name")
    s = s.agg(F.sum("n").alias("n"), F.sum("se").alias("se"), F.max("top").alias("max_abs"), F.sum("ab").alias("ab"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"))
    flat = (F.col("aa") == 0) | (F.col("bb") == 0)
    return s.select("tensor_name", "n", (F.col("se") / F.col("n")).alias("mse"), "max_abs", F.when(flat, 1.0).otherwise(F.col("ab") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("aa") * F.col("bb")))).alias("cosine"))


def write_container(records: DataFrame, path: str, chunk_size: int = 1 << 20, version: int = container.THREE, count: int | None = None) -> int:
    """Records in one file, by name and chunk; count: how many there are, if known, for the header. Its bytes are in one order, so one task writes it; the table of records is
    the form to keep at scale. Tensors of several chunks are written as one record a chunk, named name#chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for row in _rows(b):
                    r = record_of(row)
                    if row["chunks"] > 1:
                        r.name = f"{r.name}#{row['chunk']}"
                    yield r

        yield pa.RecordBatch.from_arrays([pa.array([container.write(path, records(), chunk_size, version, count)], pa.int64())], ["n"])

    return records.repartition(1).sortWithinPartitions("tensor_name", "chunk").mapInArrow(run, "n long").first()[0]
