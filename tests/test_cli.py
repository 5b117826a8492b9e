import numpy as np

from loomspan.cli import run

RNG = np.random.default_rng(1)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m").mkdir()
    (tmp_path / "t").mkdir()
    a = {"w.weight": RNG.normal(size=(64, 64)).astype(np.float32), "ids": np.arange(40)}
    for n, x in a.items():
        np.save(tmp_path / "m" / f"{n}.npy", x)
        np.save(tmp_path / "t" / f"{n}.npy", x if n == "ids" else x + np.float32(0.001))
    path = lambda n: str(tmp_path / n)
    for out in ("c.qnc", "c"):
        assert run(["compress", path("m"), path(out), "--bits", "8", "--allocate-bits"], spark) == 0
        assert run(["decompress", path(out), path("back-" + out)], spark) == 0
        back = np.load(tmp_path / f"back-{out}" / "w.weight.npy")
        assert np.abs(back - a["w.weight"]).max() < 0.1 and (np.load(tmp_path / f"back-{out}" / "ids.npy") == a["ids"]).all()
    assert run(["profile", path("m")], spark) == 0
    assert run(["delta-compress", path("m"), path("t"), path("d")], spark) == 0
    assert run(["delta-inspect", path("d")], spark) == 0
    assert run(["delta-restore", path("m"), path("d"), path("again")], spark) == 0
    assert np.abs(np.load(tmp_path / "again" / "w.weight.npy") - a["w.weight"] - 0.001).max() < 1e-4
    assert "sign_scale" in capsys.readouterr().out
    for out in ("x.npz", "x.safetensors"):
        assert run(["decompress", path("c"), path(out)], spark) == 0
    assert (np.load(tmp_path / "x.npz")["ids"] == a["ids"]).all()
    assert run(["benchmark", "synthetic", path("b1")], spark) == 0 and run(["compare", path("b1"), path("b1")], spark) == 0
    assert run(["summarize", path("b1"), "--compare", path("b1"), "--tiny-threshold", "8192"], spark) == 0
    out = capsys.readouterr().out
    assert "spotlight: mixed_precision" in out and "h.0.ln_1.bias" in out and "aggregates" in out
    assert run(["benchmark", "synthetic", path("b2"), "--seed", "3", "--repeats", "1", "--zstd-level", "1", "--extras", "1"], spark) == 0
    from loomspan.sources.reports import read_rows

    names = {r[0] for r in read_rows(spark, path("b2")).select("tensor_name").collect()}
    assert len([n for n in names if n.startswith("symbols.")]) <= 1 < len(names)
    assert run(["benchmark", path("m")], spark) == 0
    assert run(["compress", path("none"), path("x")], spark) == 1 and run(["compress", path("m"), path("x"), "--bits", "99"], spark) == 1


def test_sql_functions(spark):
    from loomspan.functions import sql

    sql.register(spark)
    a = np.arange(8, dtype=np.float32)
    spark.createDataFrame([(bytearray(a.tobytes()), "float32"), (None, "float32")], "data binary, dtype string").createOrReplaceTempView("t")
    assert [tuple(r) for r in spark.sql("select c.idx, c.x from t, lateral tensor_cells(data, dtype) c order by 1").collect()] == [(i, float(i)) for i in range(8)]
    assert sorted(r[0] for r in spark.sql("select tensor_entropy(data, dtype) from t where data is not null").collect()) == [3.0]
    r = spark.sql("select pack_codes(array(1L, 2L, 3L), 2) p, unpack_codes(pack_codes(array(1L, 2L, 3L), 2), 2, 3) u").first()
    assert bytes(r["p"]) == bytes([0b111001]) and r["u"] == [1, 2, 3]


def test_one_array(spark, tmp_path):
    import pytest

    from loomspan.codec.errors import CodecError
    from loomspan.sources import tables

    np.save(tmp_path / "a.npy", np.arange(5))
    df = tables.read_tensors(spark, str(tmp_path / "a.npy"))
    tables.save(df, str(tmp_path / "out.npy"))
    assert (np.load(tmp_path / "out.npy") == np.arange(5)).all()
    with pytest.raises(CodecError):
        tables.save(df.unionByName(df.withColumn("tensor_name", df["dtype"])), str(tmp_path / "two.npy"))
