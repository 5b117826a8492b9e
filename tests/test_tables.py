import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.codec import tensors
from loomspan.codec.errors import CodecError
from loomspan.codec.record import dump
from loomspan.config import Config
from loomspan.operators import compress, finetune_codec
from loomspan.sources import container, formats, tables

RNG = np.random.default_rng(4242)


def model():
    return {
        "token_embed.weight": RNG.normal(0, 0.1, (512, 96)).astype(np.float32),
        "h.0.attn.weight": RNG.normal(0, 0.1, (96, 96)).astype(np.float32),
        "h.0.ln_1.weight": RNG.normal(1, 0.1, 96).astype(np.float32),
        "mlp.bias": RNG.normal(0, 0.1, 192).astype(np.float32),
        "layer_0.k_cache": RNG.normal(0, 0.02, (2, 6, 96, 16)).cumsum(2).astype(np.float32),
        "position_ids": np.arange(512, dtype=np.int64).reshape(1, 512),
        "causal_mask": np.tril(np.ones((64, 64), np.float32)),
        "gate.half": RNG.normal(0, 0.1, (192, 96)).astype(np.float16),
        "step": np.array(17, np.int32),
    }


def save(folder, tensors_):
    for name, a in tensors_.items():
        (folder / f"{name}.npy").parent.mkdir(parents=True, exist_ok=True)
        np.save(folder / f"{name}.npy", a)
    return str(folder)


def arrays(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["tensor_name"], r["chunk"])):
        out.setdefault(r["tensor_name"], (r["dtype"], r["shape"], []))[2].append(bytes(r["data"]))
    return {n: np.frombuffer(b"".join(d), t).reshape(s) for n, (t, s, d) in out.items()}


def same(a, b):
    assert set(a) == set(b)
    for n in a:
        assert a[n].dtype == b[n].dtype and a[n].shape == b[n].shape and a[n].tobytes() == b[n].tobytes(), n


@pytest.mark.parametrize("chunk", [tables.CHUNK, 4096])
def test_read_every_format(spark, tmp_path, chunk):
    m = model() | {"deep/er": np.ones(3, np.float32)}
    folder = save(tmp_path / "m", m)
    same(arrays(tables.read_tensors(spark, folder, chunk)), m)
    np.savez(tmp_path / "m.npz", **m)
    same(arrays(tables.read_tensors(spark, str(tmp_path / "m.npz"), chunk)), m)
    tables.write_safetensors(tables.read_tensors(spark, folder, chunk), str(tmp_path / "s")).collect()
    same(arrays(tables.read_tensors(spark, str(tmp_path / "s"), chunk)), m)
    assert tables.write_folder(tables.read_tensors(spark, folder, chunk), str(tmp_path / "again")).agg(F.sum("nbytes")).first()[0] == sum(a.nbytes for a in m.values())
    same(arrays(tables.read_tensors(spark, str(tmp_path / "again"))), m)


def test_bfloat16_and_index(spark, tmp_path):
    x = RNG.normal(size=10).astype(np.float32)
    half = (x.view(np.uint32) >> 16).astype(np.uint16)
    head = json.dumps({"__metadata__": {"a": "b"}, "w": {"dtype": "BF16", "shape": [10], "data_offsets": [0, 20]}}).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + half.tobytes())
    got = arrays(tables.read_tensors(spark, str(tmp_path)))["w"]
    assert got.dtype == np.float32 and np.abs(got - x).max() < 0.02
    assert tables.index(spark, str(tmp_path)).first()["nbytes"] == 20


def test_sources_refuse(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_tensors(spark, str(tmp_path / "none"))
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(CodecError):
        tables.read_tensors(spark, str(tmp_path / "x.txt"))
    with pytest.raises(CodecError):
        tables.read_tensors(spark, str(tmp_path))
    for sub in "ab":
        formats.write_safetensors(formats.store_of(str(tmp_path))[0], str(tmp_path / f"{sub}.safetensors"), [("w", "float32", (1,), b"1234")])
    with pytest.raises(ValueError):
        formats.unique(formats.places(str(tmp_path)))


@pytest.mark.parametrize("chunk", [tables.CHUNK, 8192])
@pytest.mark.parametrize("allocate", [False, True])
def test_encode_decode(spark, tmp_path, chunk, allocate):
    m = model()
    df = tables.read_tensors(spark, save(tmp_path / "m", m), chunk)
    records = compress.encode(df, Config(), allocate).persist()
    back = compress.decode(records)
    got = arrays(back)
    for n, a in m.items():
        assert got[n].dtype == a.dtype and got[n].shape == a.shape
    for n in ("h.0.ln_1.weight", "mlp.bias", "position_ids", "causal_mask", "step"):
        assert got[n].tobytes() == m[n].tobytes(), n
    e = {r["tensor_name"]: r for r in compress.errors(df, back).collect()}
    assert e["step"]["mse"] == 0 and all(r["cosine"] > 0.98 and r["max_abs"] < 0.3 for r in e.values())
    total = compress.summary(records).agg(F.sum("raw_bytes"), F.sum("compressed_bytes")).first()
    assert total[1] < 0.75 * total[0]


def test_allocation_follows_entropy(spark, tmp_path):
    m = {"a": RNG.normal(size=(64, 64)), "b": np.where(RNG.random((64, 64)) < 0.05, 1.0, 0), "c": np.zeros((64, 64))}
    df = tables.read_tensors(spark, save(tmp_path / "m", m))
    h = {r["tensor_name"]: r["bits"] for r in compress.entropies(df).collect()}
    assert h["a"] > h["b"] > h["c"] == 0


@pytest.mark.parametrize("version", [container.TWO, container.THREE])
def test_container(spark, tmp_path, version):
    m = model()
    df = tables.read_tensors(spark, save(tmp_path / "m", m))
    path = str(tmp_path / "x.qnc")
    assert compress.write_container(compress.encode(df, Config(lossless=True)), path, 1000, version) == len(m)
    same(arrays(tables.read_tensors(spark, path)), m)
    entries = list(container.scan(path))
    assert [e.name for e in entries] == sorted(m)
    size = (tmp_path / "x.qnc").stat().st_size
    assert sum(e.storage for e in entries) + 12 == size
    data = (tmp_path / "x.qnc").read_bytes()
    for bad in (b"NOPE" + data[4:], data[:4] + b"\x09\0" + data[6:], data[:-3], data[:12] + b"XXXX" + data[16:]):
        (tmp_path / "bad.qnc").write_bytes(bad)
        with pytest.raises(CodecError):
            list(container.scan(str(tmp_path / "bad.qnc")))


def test_container_of_the_first_version(spark, tmp_path):
    r = tensors.encode("w", np.ones((30, 30), np.float32) * 2, tensors.WEIGHT, Config(lossless=True))
    meta, head = dump(r.meta), r.header()
    body = struct.pack("<I", 1) + b"w" + struct.pack("<I", len(head)) + head + struct.pack("<Q", len(meta)) + meta + struct.pack("<Q", len(r.payload)) + r.payload
    raw = struct.pack("<4sHI", b"QNCB", 1, 1) + body
    (tmp_path / "one.qnc").write_bytes(raw)
    same(arrays(tables.read_tensors(spark, str(tmp_path / "one.qnc"))), {"w": np.ones((30, 30), np.float32) * 2})
    (tmp_path / "one.qnc").write_bytes(raw + b"x")
    with pytest.raises(CodecError):
        list(container.scan(str(tmp_path / "one.qnc")))


@pytest.mark.parametrize("chunk", [tables.CHUNK, 16_384])
def test_fine_tuned(spark, tmp_path, chunk):
    base = {"sign": RNG.normal(size=(128, 128)), "same": RNG.normal(size=(64, 64)), "few": RNG.normal(size=2048), "dense": RNG.normal(size=4096), "small": RNG.normal(size=(8, 8)), "gone": np.ones(4)}
    base = {n: a.astype(np.float32) for n, a in base.items()} | {"ids": np.arange(3000, dtype=np.int64) + 2**40}
    tuned = {n: a + RNG.normal(0, 0.005, a.shape).astype(np.float32) for n, a in base.items() if n not in ("gone", "ids")}
    tuned["same"] = base["same"].copy()
    tuned["few"] = base["few"].copy()
    tuned["few"][::20] += 0.01
    tuned |= {"new": np.ones((3, 3), np.float32), "ids": base["ids"] + 1}
    b, t = (tables.read_tensors(spark, save(tmp_path / n, m), chunk) for n, m in (("b", base), ("t", tuned)))
    deltas = finetune_codec.compress(b, t).persist()
    routes = {r["tensor_name"]: (r["membership"], r["route"]) for r in finetune_codec.manifest(b, deltas).collect()}
    assert routes == {"sign": ("shared", "sign_scale"), "same": ("shared", "zero"), "few": ("shared", "sparse"), "dense": ("shared", "quantize"), "small": ("shared", "lossless"), "gone": ("removed", None), "new": ("added", "added"), "ids": ("shared", "added")}
    got = arrays(finetune_codec.restore(b, deltas))
    assert set(got) == set(tuned)
    for n in ("same", "new", "ids"):
        assert got[n].tobytes() == tuned[n].tobytes()
    for n, a in tuned.items():
        assert np.abs(got[n].astype(float) - a).max() < 0.03
        assert np.abs(got[n].astype(float) - a).sum() <= np.abs(base.get(n, a).astype(float) - a).sum() + 1e-9 or n == "new"
    with pytest.raises(Exception, match="not the base"):
        finetune_codec.restore(t, deltas).collect()


def test_header_count(spark, tmp_path):
    from loomspan.codec import tensors
    from loomspan.codec.errors import CodecError
    from loomspan.config import Config
    from loomspan.sources import container

    made = [tensors.encode(f"t{i}", np.arange(i + 3), tensors.WEIGHT, Config(lossless=True)) for i in range(3)]
    path = str(tmp_path / "counted.qnc")
    assert container.write(path, made, count=3) == 3
    head = open(path, "rb").read(12)
    assert int.from_bytes(head[6:8], "little") == container.STREAMED | container.COUNTED and int.from_bytes(head[8:12], "little") == 3
    assert [e.name for e in container.scan(path)] == ["t0", "t1", "t2"]
    with pytest.raises(CodecError):
        container.write(path, made, count=4)
    with pytest.raises(CodecError):
        list(container.scan(path))
    container.write(path, made)
    assert int.from_bytes(open(path, "rb").read(12)[8:12], "little") == container.UNKNOWN


def test_manifest(spark):
    from loomspan.codec.errors import CodecError
    from loomspan.operators import finetune_codec
    from loomspan.sources.tables import SCHEMA

    def tensors_of(made):
        return spark.createDataFrame([(n, a.dtype.name, list(a.shape), 0, 1, 0, bytearray(a.tobytes())) for n, a in made.items()], SCHEMA)

    a = np.arange(600, dtype=np.float32)
    base, tuned = tensors_of({"a": a, "gone": a}), tensors_of({"a": a, "new": a})
    deltas = finetune_codec.compress(base, tuned)
    told = finetune_codec.with_manifest(base, deltas, "base")
    m = finetune_codec.inspect(told)
    assert m["base_model_id"] == "base" and m["created_at"].endswith("+00:00") and m["config"]["bits"]
    assert {r["tensor_name"]: r["membership"] for r in m["tensors"]} == {"a": "shared", "gone": "removed", "new": "added"}
    assert sorted(r["tensor_name"] for r in finetune_codec.restore(base, told).collect()) == ["a", "new"]
    assert (finetune_codec.unpack_manifest(finetune_codec.pack_manifest(m)) == m) and finetune_codec.pack_manifest(m).dtype == np.uint8
    for bad in (lambda: finetune_codec.inspect(deltas), lambda: finetune_codec.unpack_manifest(np.array([1, 2], np.uint8))):
        with pytest.raises(CodecError):
            bad()
