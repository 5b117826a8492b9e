"""Tensors that arrive over time: encoded as they come, and values that are coded against the ones before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.config import Config
from loomspan.operators.compress import encode
from loomspan.sources.tables import SCHEMA


def arriving(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the array files that appear in a folder, as rows of path and content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)


def as_tensors(files: DataFrame, root: str) -> DataFrame:
    """Rows of path and content to a table of tensors, named by their path below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                name = path.partition(root.rstrip("/") + "/")[2].removesuffix(".npy")
                row = [name, a.dtype.name, list(a.shape), 0, 1, 0, np.ascontiguousarray(a).tobytes()]
                kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["tensor_name", "dtype", "shape", "chunk", "chunks", "first", "data"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def encode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Encodes what arrives. A batch that is run again after a failure replaces its own folder, so each tensor is kept once."""

    def batch(df: DataFrame, number: int) -> None:
        encode(as_tensors(df, folder), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_frequencies(stream: DataFrame, key: str, symbol: str) -> DataFrame:
    """Counts of symbols so far; the state has a row per key and symbol."""
    return stream.groupBy(key, symbol).agg(F.count("*").alias("c"))


def windowed_profile(stream: DataFrame, time: str, key: str, x: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Statistics of values by time window; rows later than the watermark are left out, as its state is dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "lo", "hi", "mean")


def difference_stream(stream: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """delta: each value less the one before it of its key, across batches; the state is a key's last value."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        last = state.get[0] if state.exists else rows[x].iloc[0]
        values = rows[x].to_numpy()
        state.update((float(values[-1]),))
        yield pd.DataFrame({"k": k[0], "o": rows[order].to_numpy(), "delta": np.diff(values, prepend=last)})

    kinds = dict(stream.dtypes)
    out = stream.groupBy(key).applyInPandasWithState(run, f"k {kinds[key]}, o {kinds[order]}, delta double", "last double", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"k": key, "o": order})
