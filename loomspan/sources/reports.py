"""Reports and manifests as files: JSON in, JSON and CSV out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row's columns by kind: what was measured, of what, and how.
SIZES = [f"{x}_bytes" for x in ("raw", "compressed", "quantized", "payload", "metadata", "header", "zstd_raw", "zstd_quantized", "container", "container_payload", "container_overhead")] + ["bundle_entries"]
MEASURES = [f"{x}_ratio" for x in ("compression", "zstd_raw", "zstd_quantized")] + ["mse", "max_abs_error", "relative_error", "cosine_similarity"] + [f"{x}_rate" for x in ("encode", "decode")]
TENSOR = [f"tensor_{x}" for x in ("name", "role", "type", "shape")] + ["dtype", "exact_kind"]
ORIGIN = [f"{x}_name" for x in ("benchmark", "backend")] + ["config", "benchmark_mode", "sample_policy"] + [f"model_{x}" for x in ("id", "revision", "local_path")] + [f"source_{x}" for x in ("file", "file_sha256", "dtype")]
ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ORIGIN + TENSOR]
    + [T.StructField("was_sampled", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in SIZES]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
)
VERSIONS = (1, 2, 3)
#: Fixed value: how other writers of reports end the name of a rate.
RATE = "_throughput_bytes_per_sec"


def _field(row: Column, name: str) -> Column:
    """A field of a row that another program may have written: under its own name, or with one word before it, as in engine_payload_bytes."""
    other = "|".join(sorted(set(ROW.fieldNames()) - {name}, key=len, reverse=True))
    wanted = F.filter(F.map_entries(row), lambda e: F.regexp_replace(e["key"], RATE + "$", "_rate").rlike(f"^(?:[a-z0-9]+_)?{name}$") & ~F.regexp_replace(e["key"], RATE + "$", "_rate").rlike(f"^(?:{other})$"))
    return F.get(F.array_sort(F.transform(wanted, lambda e: F.struct(F.length(e["key"]).alias("n"), e["value"].alias("value")))), F.lit(0))["value"]


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a report {schema_version, results: [...]}. Fields that are not known are left out, those that lack are null.

    Names of fields follow a rule (_field), so that reports of other programs are read as well.
    """
    doc = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("results", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    df = spark.read.schema(doc).json(path, multiLine=True)
    ok = F.col("schema_version").isin(*VERSIONS)
    unknown = F.raise_error(F.concat(F.lit("unknown version of a report: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))))
    rows = df.select(F.explode(F.when(ok, F.col("results")).otherwise(unknown.cast(doc["results"].dataType))).alias("r"))
    return rows.select(*[_field(F.col("r"), f.name).cast(f.dataType).alias(f.name) for f in ROW.fields])


def complete(results: DataFrame) -> DataFrame:
    """All columns of a row, in order; null where results have none."""
    return results.select(*[(F.col(f.name) if f.name in results.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW.fields])


def write_report(results: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """A report of a run as one JSON document in a folder, its rows by benchmark name, which read_report reads. A run's rows are few."""
    row = F.struct(*[F.col(c) for c in complete(results).columns])
    rows = complete(results).agg(F.array_sort(F.collect_list(row)).alias("results"))
    told = F.create_map(*[F.lit(x) for kv in sorted((metadata or {"writer": "loomspan"}).items()) for x in kv])
    rows.select(F.lit(VERSIONS[-1]).alias("schema_version"), told.alias("run_metadata"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at_utc"), "results").write.mode("overwrite").json(path)


def write_rows(results: DataFrame, path: str, kind: str = "json") -> None:
    """Rows to a folder: a report, or CSV files with all columns in a fixed order."""
    if kind == "csv":
        complete(results).write.mode("overwrite").option("header", True).csv(path)
    else:
        write_report(results, path)


def read_rows(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(ROW).option("header", True).csv(path) if kind == "csv" else read_report(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of models: a row per weight file with its sum. Paths that are not absolute are below the manifest's folder."""
    schema = "models array<struct<repo_id: string, requested_revision: string, resolved_revision: string, local_path: string, total_downloaded_bytes: long, files array<struct<path: string, kind: string, size_bytes: long, sha256: string>>>>".replace("files array", "files: array")
    root = path.rpartition("/")[0]
    m = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("models").alias("m")).select("m.*")
    local = F.when(F.col("local_path").startswith("/"), F.col("local_path")).otherwise(F.concat(F.lit(root + "/"), F.col("local_path")))
    f = m.withColumn("local_path", local).select("repo_id", "resolved_revision", "local_path", F.explode("files").alias("f"))
    return f.filter("f.kind = 'weight'").select("repo_id", "resolved_revision", "local_path", "f.path", "f.size_bytes", "f.sha256")
