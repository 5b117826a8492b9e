"""Tensors as a table: a data source that reads files by byte ranges, and writers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspan.codec.errors import CodecError
from loomspan.codec.tensors import decode
from loomspan.sources import container, formats

#: The columns of a table of tensors. A tensor of over CHUNK bytes has several rows, cut between its slices on axis 0.
SCHEMA = "tensor_name string, dtype string, shape array<long>, chunk int, chunks int, first long, data binary"
CHUNK, TASK = 64 << 20, 64 << 20


@dataclass
class Part(InputPartition):
    """Pieces that one task reads: (place, first byte, bytes, chunk, chunks), or (path, entry) of a container."""

    pieces: list


class TensorReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Part]:
        """Only headers are read here. Small tensors share a task, large ones are cut."""
        pieces: list[tuple[int, tuple]] = []
        found = formats.places(self.path)
        formats.unique(found)
        for p in found:
            row = p.size // p.shape[0] if p.shape and p.shape[0] else p.size
            step = max(1, self.chunk // row) * row if row and not p.member else max(1, p.size)
            cut = list(formats.ranges(p.size, step))
            pieces += [(n, (p, at, n, i, len(cut))) for i, (at, n) in enumerate(cut)]
        for path in formats.files(self.path):
            if path.endswith(".qnc"):
                pieces += [(e.record.nbytes, (path, e)) for e in container.scan(path)]
        out, held, size = [], [], 0
        for n, piece in pieces:
            if held and size + n > TASK:
                out.append(Part(held))
                held, size = [], 0
            held.append(piece)
            size += n
        return [*out, Part(held)] if held else out or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for piece in partition.pieces:
            if len(piece) == 2:
                r = container.fetch(*piece)
                yield r.name, r.dtype, list(r.shape), 0, 1, 0, decode(r).tobytes()
            else:
                p, at, n, i, k = piece
                row = p.size // p.shape[0] if p.shape and p.shape[0] else 0
                yield p.name, "float32" if p.dtype == "bfloat16" else p.dtype, list(p.shape), i, k, at // row if row else 0, formats.read(p, at, n)


class TensorSource(DataSource):
    """spark.read.format("tensors").load(path): files or folders of .npy, .npz, .safetensors and containers."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TensorReader:
        return TensorReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def read_tensors(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A table of the tensors at path; raises if there are none."""
    if not formats.places(path) and not any(f.endswith(".qnc") for f in formats.files(path)):
        raise CodecError(f"no tensors at {path}")
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").option("chunk", chunk).load(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Names, types, shapes and places of tensors, from headers only."""
    rows = [(p.name, p.path, p.dtype, list(p.shape), p.size) for p in formats.unique(formats.places(path)).values()]
    return spark.createDataFrame(rows, "tensor_name string, path string, dtype string, shape array<long>, nbytes long")


def write_folder(df: DataFrame, path: str) -> DataFrame:
    """An array file per tensor under path, written by the tasks that hold them: tensor_name and bytes written.

    A tensor's chunks come together in the order of their rows; only one chunk is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = formats.store_of(path)

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ("tensor_name", "dtype", "shape")), b.column("data"))

        done = []
        for name, group in groupby(rows(), key=lambda r: r[0]):
            head = next(group)
            size = len(head[3].as_buffer())

            def parts() -> Iterator[bytes]:
                nonlocal size
                yield head[3].as_buffer()
                for row in group:
                    size += len(row[3].as_buffer())
                    yield row[3].as_buffer()

            formats.write_npy(store, f"{root}/{name}.npy", head[1], tuple(head[2]), parts())
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["tensor_name", "nbytes"])

    return df.repartition("tensor_name").sortWithinPartitions("tensor_name", "chunk").mapInArrow(run, "tensor_name string, nbytes long")


def write_safetensors(df: DataFrame, path: str) -> DataFrame:
    """Shards under path, one per task that has tensors; a shard's tensors are held in memory to write its header first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, tuple[str, tuple[int, ...], list[bytes]]] = {}
        for b in batches:
            for name, dtype, shape, data in zip(*(b.column(n).to_pylist() for n in ("tensor_name", "dtype", "shape", "data"))):
                held.setdefault(name, (dtype, tuple(shape), []))[2].append(data)
        if held:
            store, root = formats.store_of(path)
            store.create_dir(root, recursive=True)
            formats.write_safetensors(store, f"{root}/part-{TaskContext.get().partitionId():05d}.safetensors", [(n, t, s, b"".join(d)) for n, (t, s, d) in sorted(held.items())])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([sum(map(len, d)) for _, _, d in held.values()], pa.int64())], ["tensor_name", "nbytes"])

    return df.repartition("tensor_name").sortWithinPartitions("tensor_name", "chunk").mapInArrow(run, "tensor_name string, nbytes long")


def meta(df: DataFrame) -> DataFrame:
    """A row per tensor: name, type, shape, bytes."""
    return df.groupBy("tensor_name").agg(F.first("dtype").alias("dtype"), F.first("shape").alias("shape"), F.sum(F.octet_length("data")).alias("nbytes"))


def write_npz(df: DataFrame, path: str) -> int:
    """One archive of arrays, written by one task as its chunks come, by name: an archive's bytes are in one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        import numpy as np

        store, target = formats.store_of(path)
        with store.open_output_stream(target, compression=None) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            member, name, n = None, None, 0
            for b in batches:
                for tensor, dtype, shape, data in zip(*(b.column(c).to_pylist() for c in ("tensor_name", "dtype", "shape")), b.column("data")):
                    if tensor != name:
                        if member:
                            member.close()
                        name, n, member = tensor, n + 1, z.open(f"{tensor}.npy", "w", force_zip64=True)
                        head = io.BytesIO()
                        np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": tuple(shape)})
                        member.write(head.getvalue())
                    member.write(data.as_buffer())
            if member:
                member.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.repartition(1).sortWithinPartitions("tensor_name", "chunk").mapInArrow(run, "n long").first()[0]


def write_npy(df: DataFrame, path: str) -> None:
    """The only tensor of a table in one array file; more or fewer raise."""
    names = [r["tensor_name"] for r in df.select("tensor_name").distinct().limit(2).collect()]
    if len(names) != 1:
        raise CodecError("an array file holds exactly one tensor")
    folder, _, name = path.removesuffix(".npy").rpartition("/")
    write_folder(df.withColumn("tensor_name", F.lit(name)), folder).collect()


def save(df: DataFrame, path: str) -> None:
    """A table of tensors to where the suffix of path says: .npy, .npz, .safetensors (a folder of shards), else a folder of array files."""
    if path.endswith(".npy"):
        write_npy(df, path)
    elif path.endswith(".npz"):
        write_npz(df, path)
    else:
        (write_safetensors if path.endswith(".safetensors") else write_folder)(df, path).collect()
