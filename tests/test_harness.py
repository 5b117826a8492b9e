import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.codec import registry, tensors
from loomspan.config import Config
from loomspan.operators import harness, reports
from loomspan.sources import reports as files


def test_suite(spark, tmp_path):
    df = harness.synthetic(spark)
    rows = harness.run(df, repeats=1).persist()
    got = {r["tensor_name"]: r for r in rows.collect()}
    assert len(got) == 11
    assert all(r["cosine_similarity"] > 0.95 and r["compression_ratio"] > 0.8 and r["encode_rate"] > 0 for r in got.values())
    assert got["token_embed.weight"]["tensor_type"] == "EMBEDDING" and got["h.0.attn.q_proj.weight"]["tensor_role"] == "attn_q_proj"
    assert got["symbols.zipf"]["compressed_bytes"] < got["symbols.zipf"]["zstd_raw_bytes"]
    full = files.complete(rows)
    total = reports.aggregates(full).filter("level = 'run'").first()
    assert total["rows"] == 11 and total["aggregate_compression_ratio"] > 2
    assert reports.compare(rows, rows).count() == 0
    worse = rows.withColumn("compression_ratio", F.col("compression_ratio") * 0.9)
    assert reports.compare(rows, worse).count() == 11
    exact = rows.filter(reports.is_exact() & F.col("exact_kind").isNotNull())
    assert {r["exact_kind"] for r in exact.collect()} >= {r["exact_kind"] for r in got.values() if r["mse"] == 0 and r["exact_kind"]}
    assert reports.tiny_cohort(full, 1 << 20).first()["rows"] == rows.filter((F.col("raw_bytes") <= 1 << 20) & reports.is_exact()).count() > 0
    for kind in ("json", "csv"):
        files.write_rows(rows, str(tmp_path / kind), kind)
        back = files.read_rows(spark, str(tmp_path / kind), kind)
        assert back.columns == files.ROW.fieldNames() and back.agg(F.sum("raw_bytes")).first()[0] == total["raw_bytes_total"]


def test_skipped(spark):
    df = harness.synthetic(spark).limit(2).withColumn("dtype", F.lit("complex64"))
    assert {r["reason"] for r in harness.skipped(df).collect()} == {"unsupported_dtype:complex64"}
    assert harness.run(df).count() == 0


def test_report_files(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"schema_version": 2, "results": [{"benchmark_name": "a", "raw_bytes": 5, "what": 1}, {"benchmark_name": "b"}]}))
    got = files.read_report(spark, str(p)).orderBy("benchmark_name").collect()
    assert [r["raw_bytes"] for r in got] == [5, None] and len(got[0]) == 39
    foreign = {"benchmark_name": "c", "raw_bytes": 8, "other_payload_bytes": 3, "other_container_payload_bytes": 4, "container_bytes": 9, "encode_throughput_bytes_per_sec": 2.5, "other_exact_kind": "aseq", "was_sampled": True, "model_id": None}
    p.write_text(json.dumps({"schema_version": 3, "results": [foreign]}))
    got = files.read_report(spark, str(p)).first()
    assert (got["payload_bytes"], got["container_payload_bytes"], got["container_bytes"], got["encode_rate"], got["exact_kind"], got["was_sampled"], got["model_id"], got["raw_bytes"]) == (3, 4, 9, 2.5, "aseq", True, None, 8)
    p.write_text(json.dumps({"schema_version": 9, "results": []}))
    with pytest.raises(Exception, match="unknown version"):
        files.read_report(spark, str(p)).collect()
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"models": [{"repo_id": "x/y", "resolved_revision": "r", "local_path": "here", "files": [{"path": "w.safetensors", "kind": "weight", "size_bytes": 9, "sha256": "s"}, {"path": "c.json", "kind": "config"}]}], "failures": []}))
    rows = files.read_manifest(spark, str(m)).collect()
    assert len(rows) == 1 and rows[0]["local_path"] == f"{tmp_path}/here" and rows[0]["sha256"] == "s"


def test_percentile_and_upper_median(spark):
    df = spark.createDataFrame([(0.99,), (0.95,)], "c double")
    assert df.agg(F.percentile("c", 0.05)).first()[0] == pytest.approx(0.952)
    for rows, want in (([1, 2, 3], 2), ([1, 2, 3, 4], 3), ([5], 5)):
        assert spark.createDataFrame([(float(x),) for x in rows], "c double").agg(reports.upper_median("c")).first()[0] == want


def test_backends():
    class Plain:
        def encode(self, places, model):
            return np.asarray(places, np.uint16).tobytes()

        def decode(self, data, n, model):
            return np.frombuffer(data, np.uint16).astype(np.int64)

    lanes = registry.get(registry.CODERS, "lanes")
    registry.register(registry.CODERS, "lanes", Plain())
    try:
        a = np.random.default_rng(0).normal(size=(64, 64)).astype(np.float32)
        assert tensors.decode(tensors.encode("w", a, tensors.WEIGHT, Config(lossless=True))).tobytes() == a.tobytes()
    finally:
        registry.register(registry.CODERS, "lanes", lanes)
    with pytest.raises(ValueError):
        registry.get(registry.PACKERS, "none")


def test_quantizer_objects(spark):
    from loomspan.operators import quantizers as Q

    cells = spark.createDataFrame([("a", float(x)) for x in range(-7, 8)] + [("b", 70.0)], "t string, x double")

    class Fixed:
        def ranges(self, cells, keys, x, mode):
            return cells.select(*keys).distinct().selectExpr("*", "-7D as lo", "7D as hi")

    p = Q.Calibrator(4, policy=Fixed()).calibrate(cells, ["t"])
    coded = Q.Uniform(4).quantize(cells, ["t"], p)
    back = {(r["t"], r["x"]): (r["q"], r["y"]) for r in Q.Uniform(4).dequantize(coded).collect()}
    assert all(back["a", float(x)] == (x, float(x)) for x in range(-7, 8)) and back["b", 70.0] == (7, 7.0)
    same = Q.quantize(cells, ["t"], 4, policy=Fixed()).collect()
    assert {(r["t"], r["x"]): (r["q"], r["y"]) for r in same} == back
    whole = Q.quantize(cells, [], 4)
    assert whole.count() == 16 and whole.agg({"q": "max"}).first()[0] == 7


def test_spotlights(spark):
    from loomspan.sources.reports import complete

    rows = [("big", "mask", 9000, 500, 400, 300, None), ("none", "mask", 9000, 900, None, 100, None), ("zero", "mask", 9000, 901, 0, 950, None), ("tiny", "mask", 64, 10, 900, 10, "raw"), ("other", "bias", 1, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "tensor_name string, tensor_type string, raw_bytes long, compressed_bytes long, zstd_raw_bytes long, zstd_quantized_bytes long, exact_kind string")
    df = complete(df.selectExpr("*", "tensor_name as benchmark_name", "10L as payload_bytes", "5L as metadata_bytes", "1D as mse"))
    got = reports.spotlights(df, ["mask"], 10).select("benchmark_name", "eff").collect()
    assert [r[0] for r in got] == ["big", "tiny", "none", "zero"]
    record = '{"chunk_count":1,"chunk_lengths":[10],"header":{"__bytes__":true,"data":"' + "A" * 86 + '=="},"metadata":{"__bytes__":true,"data":"AAAAAAA="},"name":"tiny","original_nbytes":64,"record_id":0}'
    assert got[1]["eff"] == 48 + len(record) + len('{"index":0,"length":10,"record_id":0}') + 10
    odd = df.filter("tensor_name = 'tiny'").withColumn("tensor_name", reports.F.lit('é"\n\x01\U0001f600')).select(reports._json_length(reports.F.col("tensor_name")).alias("n"))
    import json

    assert odd.first()["n"] == len(json.dumps('é"\n\x01\U0001f600')) - 2
