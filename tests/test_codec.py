import struct

import numpy as np
import pytest

from loomspan.codec import bits, detect, rans, streams, tensors
from loomspan.codec.errors import CodecError, EntropyError, HeaderError, StrategyError
from loomspan.codec.record import Record, dump, load
from loomspan.config import Config

RNG = np.random.default_rng(42)
ZIPF = np.minimum(RNG.zipf(1.5, 10_000), 256)
STREAMS = [RNG.integers(0, 256, 10_000), ZIPF, np.full(1000, 7), RNG.choice([0, 1], 5000, p=[0.97, 0.03]), np.array([3]), RNG.integers(-(2**31), 2**31 - 1, 500), np.clip(RNG.normal(0, 18, 32_768).round(), -63, 63).astype(int)]


@pytest.mark.parametrize("values", STREAMS)
def test_rans_round_trip(values):
    model, places = rans.Model.of(values)
    again = rans.Model.from_bytes(model.to_bytes())
    for enc, dec in ((rans.encode, lambda d: rans.decode(d, again)), (rans.encode_single, lambda d: rans.decode_single(d, len(values), again))):
        data = enc(places, model)
        assert (again.symbols[dec(data)] == values).all()
        with pytest.raises(EntropyError):
            dec(data[:-2])
        with pytest.raises(EntropyError):
            dec(data + b"\1\2")


def test_rans_near_the_bound():
    values = RNG.choice(256, 200_000, p=(p := 1 / np.arange(1, 257) ** 1.5) / p.sum())
    model, places = rans.Model.of(values)
    bound = model.bits(np.bincount(places)) * len(values) / 8
    assert len(rans.encode_single(places, model)) < 1.01 * bound and len(rans.encode(places, model)) < 1.10 * bound


@pytest.mark.parametrize("counts", [np.ones(65_536), [1, 1, 1], [100_000] * 3, [1] * 40_000 + [10**9], [1], [5, 4, 3, 2, 1]])
def test_normalized_frequencies(counts):
    f = rans.normalize(np.array(counts))
    assert f.sum() == 65_536 and f.min() >= 1


def test_normalize_refuses():
    for bad in ([], [0, 1], np.ones(65_537)):
        with pytest.raises(EntropyError):
            rans.normalize(np.array(bad))


@pytest.mark.parametrize("width, signed", [(1, False), (2, False), (4, False), (4, True), (8, False), (8, True), (13, True), (32, False)])
def test_pack(width, signed):
    lo, hi = (-(1 << (width - 1)), 1 << (width - 1)) if signed else (0, 1 << width)
    v = RNG.integers(lo, hi, 101)
    data = bits.pack(v, width)
    assert len(data) == -(-101 * width // 8) and (bits.unpack(data, width, 101, signed) == v).all()
    with pytest.raises(CodecError):
        bits.pack(np.array([1 << width]), width)


def test_varints():
    for v in (0, 1, 127, 128, 300, 2**32, 2**64 - 1):
        assert bits.read_uvarint(bits.uvarint(v) + b"x", 0) == (v, len(bits.uvarint(v)))
        for s in (v // 2, -(v // 2)):
            assert bits.read_svarint(bits.svarint(s), 0)[0] == s
    assert bits.svarint(-1) == b"\1" and bits.svarint(1) == b"\2"
    for bad in (b"\x80", b"\x80" * 11, b"\xff" * 9 + b"\x7f"):
        with pytest.raises(CodecError):
            bits.read_uvarint(bad, 0)


def test_runs():
    f = RNG.random(1000) < 0.2
    assert (bits.read_runs(bits.runs(f), 1000) == f).all()
    with pytest.raises(CodecError):
        bits.read_runs(bits.runs(f), 999)


EXACT = [
    np.arange(512, dtype=np.int64).reshape(1, 512),
    np.tile(np.arange(64, dtype=np.int32) * 3 - 5, (4, 1)),
    np.ones((16, 16), np.float32),
    np.array([0.0, -0.0], np.float32),
    np.array([np.nan, np.nan, np.inf]),
    RNG.normal(size=(8, 5)).astype(np.float16),
    RNG.integers(0, 3, 5000).astype(np.uint8),
    np.array([2**64 - 1, 2**64 - 2], np.uint64),
    np.array(7, np.int16),
    np.array([True, False, True]),
]


@pytest.mark.parametrize("a", EXACT)
def test_exact(a):
    meta, data = streams.encode_exact(a, Config())
    back = streams.decode_exact(load(dump(meta)), data, a.dtype, a.shape)
    assert back.dtype == a.dtype and back.shape == a.shape and back.tobytes() == a.tobytes()


def test_exact_kinds():
    kinds = [streams.encode_exact(a, Config())[0]["kind"] for a in EXACT[:4]]
    assert kinds == ["sequence", "along", "constant", "raw"]


MASKS = {
    "mask_triangle": [np.tril(np.ones((64, 64), np.float32)), np.where(np.tri(64), 0, -np.inf).astype(np.float32), np.triu(np.ones((2, 8, 8), np.float32))],
    "mask_constant": [np.zeros((64, 64), np.float32), np.full((4, 4), np.nan, np.float32)],
    "mask_runs": [np.repeat([0.0, 1.0], 2000).astype(np.float32).reshape(40, 100)],
    "mask_bits": [(np.arange(4096) % 3 == 0).astype(np.float32).reshape(64, 64)],
    "mask_palette": [RNG.choice(np.array([0, 1, np.inf, -np.inf], np.float32), (50, 50))],
}


@pytest.mark.parametrize("kind, a", [(k, a) for k, rows in MASKS.items() for a in rows])
def test_masks(kind, a):
    meta, data = streams.encode_mask(a, Config())
    assert meta["kind"] == kind
    assert streams.decode_mask(load(dump(meta)), data, a.dtype, a.shape).tobytes() == a.tobytes()


LOSSY = [
    ("mlp.weight", tensors.WEIGHT, (RNG.normal(0, 0.18, (96, 64)) * RNG.lognormal(-0.4, 0.25, (96, 1))).astype(np.float32), 0.05, 0.15),
    ("layer_0.k_cache", tensors.KV_CACHE, RNG.normal(0, 0.025, (2, 8, 96, 16)).cumsum(2).astype(np.float32), 0.08, 0.3),
    ("token_embed.weight", tensors.EMBEDDING, np.where(RNG.random((256, 48)) < 0.35, 0, RNG.normal(0, 0.1, (256, 48))).astype(np.float32), 0.03, 0.1),
    ("token_embed.dense", tensors.EMBEDDING, RNG.normal(0, 0.1, (256, 48)).astype(np.float32), 0.03, 0.1),
    ("block.activation", tensors.ACTIVATION, np.maximum(RNG.normal(0, 0.8, (4, 32, 64)), 0).astype(np.float32), 0.05, 0.2),
    ("optimizer.exp_avg", tensors.OPTIMIZER_STATE, RNG.normal(0, 0.01, (64, 64)).cumsum(1).astype(np.float32), 0.05, 0.2),
    ("big.bias", tensors.BIAS, RNG.normal(0, 0.1, 2048).astype(np.float32), 0.03, 0.06),
    ("mlp.fp16_gate", tensors.MIXED_PRECISION, RNG.normal(0, 0.1, (64, 64)).astype(np.float16), 0.03, 0.08),
    ("odd", tensors.UNKNOWN, RNG.normal(0, 1, (40, 70)).astype(np.float64), 0.3, 0.6),
]


@pytest.mark.parametrize("name, kind, a, mean, most", LOSSY)
@pytest.mark.parametrize("config", [Config(), Config(mode="asymmetric", granularity="per_tensor", bits=5), Config(granularity="blockwise", block_size=3), Config(policy="percentile", percentile=100.0), Config(pack_bits=True), Config(coder="raw"), Config(layout="single")])
def test_lossy(name, kind, a, mean, most, config):
    r = tensors.encode(name, a, kind, config)
    back = tensors.decode(Record.from_bytes(r.to_bytes(), name))
    assert back.shape == a.shape and back.dtype == a.dtype
    wide = 3 if config.granularity != "per_channel" else 1
    e = np.abs(back.astype(float) - a.astype(float))
    assert e.mean() <= wide * mean and e.max() <= 2 * wide * most
    assert tensors.decode(tensors.encode(name, a, kind, Config(lossless=True))).tobytes() == a.tobytes()


def test_coded_is_smaller():
    a = LOSSY[0][2].repeat(10, 0)
    sizes = [tensors.encode("w", a, tensors.WEIGHT, c).compressed for c in (Config(), Config(coder="raw"))]
    assert sizes[0] < 0.25 * a.nbytes and sizes[0] < sizes[1]


def test_refuses():
    with pytest.raises(CodecError):
        tensors.encode("x", np.empty(0, np.float32), tensors.WEIGHT, Config())
    with pytest.raises(CodecError):
        tensors.encode("x", np.full((100, 100), np.nan, np.float32), tensors.WEIGHT, Config())
    with pytest.raises(CodecError):
        tensors.encode("x", np.array(["a"]), tensors.WEIGHT, Config())
    r = tensors.encode("x", np.ones((40, 40), np.float32), tensors.WEIGHT, Config(lossless=True))
    r.meta["value"] = b"\0\0\0\0"
    with pytest.raises(CodecError):
        tensors.decode(r)
    r.meta = {"k": "const"}
    with pytest.raises(CodecError, match="another encoder"):
        tensors.decode(r)
    r.strategy = 4
    with pytest.raises(StrategyError):
        tensors.decode(r)


def test_headers():
    r = tensors.encode("x", np.ones((3, 4), np.float32), tensors.WEIGHT, Config())
    data = r.to_bytes()
    assert len(r.header()) == 64 and struct.unpack_from("<4sH", data) == (b"QNC1", 1)
    for bad in (b"NOPE" + data[4:], data[:30], data[:4] + b"\2\0" + data[6:], data[:6] + b"\x63" + data[7:], data[:8] + b"\x09" + data[9:]):
        with pytest.raises(HeaderError):
            Record.from_bytes(bad)
    for bad in (data[:-1], data + b"x"):
        with pytest.raises(CodecError):
            Record.from_bytes(bad)
    r.shape = (1 << 32,)
    with pytest.raises(HeaderError):
        r.header()


def test_metadata():
    m = {"b": b"\0\1", "a": np.arange(6, dtype=np.int16).reshape(2, 3), "n": np.float32(1.5), "l": [1, {"x": None}]}
    back = load(dump(m))
    assert back["b"] == b"\0\1" and (back["a"] == m["a"]).all() and back["l"] == [1, {"x": None}] and back["n"] == 1.5
    for bad in (b"[1]", b"{", b'{"a":{"__ndarray__":true,"dtype":"<f4","shape":[8589934592],"data":""}}', b'{"a":{"__ndarray__":true,"dtype":"O","shape":[1],"data":""}}', b'{"a":{"__ndarray__":true,"dtype":"<f4","shape":[2],"data":"AAAA"}}'):
        with pytest.raises(CodecError):
            load(bad)
    with pytest.raises(CodecError):
        dump({"x": float("nan")})


def test_detect():
    a = RNG.normal(size=(64, 64)).astype(np.float32)
    cases = [("token_embed", a, tensors.EMBEDDING), ("exp_avg", a, tensors.OPTIMIZER_STATE), ("w", a.astype(np.float16), tensors.MIXED_PRECISION), ("m", np.tri(64, dtype=np.float32), tensors.MASK), ("b.bias", a[0], tensors.BIAS), ("k_cache", a.reshape(1, 4, 16, 64), tensors.KV_CACHE), ("mlp", a, tensors.WEIGHT), ("x", np.maximum(a - 0.5, 0), tensors.ACTIVATION), ("x", a, tensors.WEIGHT), ("x", a.reshape(1, 4, 16, 64), tensors.KV_CACHE), ("x", a.reshape(64, 64, 1, 1), tensors.KV_CACHE), ("x", a.reshape(4, 4, 4, 64)[..., :63], tensors.ACTIVATION), ("x", a[0], tensors.UNKNOWN)]
    for name, x, want in cases:
        assert detect.detect(name, x) == want, (name, x.shape)


def test_chunks():
    parts = [b"", b"abc", b"x" * 1000]
    assert tensors.unchunk(tensors.chunk(parts)) == parts
    with pytest.raises(CodecError):
        tensors.unchunk(tensors.chunk(parts)[:-1])


def test_config():
    c = Config(bits=3, granularity="blockwise", block_size=7)
    assert Config.from_json(c.to_json()) == c and Config.from_yaml(c.to_yaml()) == c
    for bad in ({"bits": 0}, {"bits": 33}, {"mode": "none"}, {"bits": 1}, {"granularity": "per_tensor", "policy": "per_channel"}, {"granularity": "per_channel", "policy": "blockwise"}, {"granularity": "blockwise", "policy": "per_channel"}, {"percentile": 0}, {"block_size": 0}, {"coder": "zip"}, {"variance": 0}, {"layout": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        Config.from_json('{"nope": 1}')
    assert Config(mode="none", lossless=True).lossless
