"""What the operators of this subpackage share: tables, scratch storage, joins to dimensions, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than these six.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A dimension of at most so many rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        own = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Folders made in this process. Results are lazy and may still read them; release() deletes them all.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/loomspan/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables and archives of this process: for when its results have been written."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Files of a staged table that is known to be small.
FEW_FILES = 4


def staged(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and lost executors lose nothing.

    small: of a bounded number of rows, made by an aggregate; then a few tasks write it.
    """
    path = new_path(df.sparkSession, label)
    (df.coalesce(FEW_FILES) if small else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    return out


def drop_staged(df: DataFrame) -> None:
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _made:
            _made.remove(path)


def spread(spark: SparkSession) -> int:
    """Partitions for rows that stand for much more work than their bytes, which AQE would put into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | Column) -> Column:
    """The words of a text, in order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def dimension_join(df: DataFrame, dim: DataFrame, on: Column, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join to a dimension: broadcast up to BROADCAST_ROWS rows (counted, not guessed), a shuffle join beyond."""
    rows = dim.count() if rows is None else rows
    return df.join(F.broadcast(dim) if rows <= BROADCAST_ROWS else dim, on, how)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (u long, v long), any order, repeats and loops allowed. Returns (node, root): every node that has an edge
    to another, with the smallest node reachable. Each round is two aggregates and two joins; a round's edges are
    written to the shared folder. Neighbours are never collected into an array, so a node with very many links is
    aggregated before the shuffle and split by the skew join after it.
    """
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("a"), F.col("m"), "u")
        new = staged(
            small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(),
            "edges",
            small=before is not None and before[0] <= BROADCAST_ROWS,  # a round makes two edges of one at most
        )
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        drop_staged(e)
        e = new
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
