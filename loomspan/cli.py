"""Commands: python -m loomspan.cli compress | decompress | profile | delta-compress | delta-restore | delta-inspect |
benchmark (of a path, or of synthetic tensors) | summarize (of a report, against another if given) | compare (exit 2 if a
row got worse)."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.codec.errors import CodecError
from loomspan.config import Config
from loomspan.operators import compress, finetune_codec, harness, reports, routing
from loomspan.sources import reports as report_files
from loomspan.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    settings = argparse.ArgumentParser(add_help=False)
    for f in fields(Config):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            settings.add_argument(name, action="store_true")
        else:
            settings.add_argument(name, type=type(f.default), default=f.default)
    for name, args in (
        ("compress", ("input", "output")),
        ("decompress", ("input", "output")),
        ("profile", ("input",)),
        ("delta-compress", ("base", "tuned", "output")),
        ("delta-restore", ("base", "input", "output")),
        ("delta-inspect", ("input",)),
        ("benchmark", ("input", "output")),
        ("compare", ("baseline", "current")),
        ("summarize", ("input",)),
    ):
        c = sub.add_parser(name, parents=[settings])
        for a in args:
            c.add_argument(a, **({"nargs": "?"} if name == "benchmark" and a == "output" else {}))
        if name == "benchmark":
            for option, value, told in (("repeats", 3, "how often each tensor is coded; medians count"), ("seed", 2025, "of the synthetic tensors"), ("zstd-level", 3, "of the baselines"), ("extras", -1, "tensors without a role to take, chosen by the seed; -1: all")):
                c.add_argument(f"--{option}", type=int, default=value, help=told)
        if name == "compare":
            for option, value in (("ratio-drop", reports.RATIO_DROP), ("error-rise", reports.ERROR_RISE), ("rate-drop", reports.RATE_DROP)):
                c.add_argument(f"--{option}", type=float, default=value)
        if name == "summarize":
            c.add_argument("--compare", help="an earlier report")
            for option, value in (("worst-limit", 8), ("spotlight-limit", 8), ("tiny-threshold", reports.TINY)):
                c.add_argument(f"--{option}", type=int, default=value)
        if name == "compress":
            c.add_argument("--allocate-bits", action="store_true", help="more bits for tensors of more entropy")
    return p


def _read(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_tensors(spark, path)


def _print(tables_by_title: dict[str, DataFrame]) -> None:
    for title, df in tables_by_title.items():
        print(title)
        df.show(1000, False)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomspan").getOrCreate()
    try:
        config = Config(**{f.name: getattr(a, f.name) for f in fields(Config)})
        if a.command == "compress":
            records = compress.encode(_read(spark, a.input), config, a.allocate_bits).persist()
            if a.output.endswith(".qnc"):
                compress.write_container(records, a.output, config.chunk_size, count=records.count())
            else:
                records.write.mode("overwrite").parquet(a.output)
            compress.summary(records).orderBy("tensor_name").show(1000, False)
            compress.summary(records).agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), (F.sum("raw_bytes") / F.sum("compressed_bytes")).alias("ratio")).show()
        elif a.command == "decompress":
            df = _read(spark, a.input) if a.input.endswith(".qnc") else compress.decode(spark.read.parquet(a.input))
            tables.save(df, a.output)
            tables.meta(df).agg(F.count("*").alias("tensors"), F.sum("nbytes").alias("nbytes")).show()
        elif a.command == "profile":
            df = _read(spark, a.input)
            types = df.filter("chunk = 0").mapInArrow(compress._types, "tensor_name string, tensor_type int")
            tables.meta(df).join(types, "tensor_name").join(compress.entropies(df), "tensor_name").orderBy("tensor_name").show(1000, False)
        elif a.command == "delta-compress":
            base = _read(spark, a.base)
            deltas = finetune_codec.compress(base, _read(spark, a.tuned), config).persist()
            finetune_codec.with_manifest(base, deltas, a.base, config).write.mode("overwrite").parquet(a.output)
            deltas.unpersist()
        elif a.command == "delta-restore":
            tables.save(finetune_codec.restore(_read(spark, a.base), spark.read.parquet(a.input)), a.output)
        elif a.command == "benchmark":
            df = harness.synthetic(spark, a.seed) if a.input == "synthetic" else _read(spark, a.input)
            if a.extras >= 0:
                chosen = routing.sampled_names(df.select("tensor_name").distinct(), "tensor_name", a.seed, a.extras)
                df = df.join(chosen.select(F.col("name").alias("tensor_name")), "tensor_name", "left_semi")
            rows = harness.run(df, config, a.input, a.repeats, a.zstd_level).persist()
            reports.aggregates(report_files.complete(rows)).orderBy("level", "tensor_type").show(100, False)
            reports.reasons(harness.skipped(df)).show()
            if a.output:
                report_files.write_rows(rows, a.output)
        elif a.command == "compare":
            failures = reports.compare(report_files.read_rows(spark, a.baseline), report_files.read_rows(spark, a.current), a.ratio_drop, a.error_rise, a.rate_drop).persist()
            failures.orderBy("benchmark_name", "failure").show(1000, False)
            return 0 if failures.isEmpty() else 2
        elif a.command == "summarize":
            rows = report_files.read_rows(spark, a.input)
            _print(reports.summary(rows, a.worst_limit, a.spotlight_limit, a.tiny_threshold))
            if a.compare:
                _print(reports.summary_deltas(report_files.read_rows(spark, a.compare), rows, a.spotlight_limit, a.tiny_threshold))
        else:
            print(json.dumps(finetune_codec.inspect(spark.read.parquet(a.input)), indent=2, sort_keys=True))
    except (CodecError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
