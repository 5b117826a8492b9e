"""Round trips of the codec over generated values."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from loomspan.codec import bits, rans, streams, tensors
from loomspan.codec.record import Record, dump, load
from loomspan.config import Config

QUICK = settings(max_examples=60, deadline=None)
DTYPES = [np.dtype(t) for t in ("bool", "u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f2", "<f4", "<f8")]
SHAPES = hnp.array_shapes(min_dims=0, max_dims=4, min_side=1, max_side=7)


@QUICK
@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=300))
def test_range_coder(values):
    model, places = rans.Model.of(np.array(values))
    assert (model.symbols[rans.decode(rans.encode(places, model), model)] == values).all()
    assert (model.symbols[rans.decode_single(rans.encode_single(places, model), len(values), model)] == values).all()


@QUICK
@given(st.integers(1, 32), st.data())
def test_packing(width, data):
    v = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=50)), np.int64)
    assert (bits.unpack(bits.pack(v, width), width, len(v)) == v).all()


@QUICK
@given(st.integers(-(2**63), 2**63 - 1))
def test_integers_of_variable_length(v):
    assert bits.read_svarint(bits.svarint(v) + b"\xff", 0) == (v, len(bits.svarint(v)))


@QUICK
@given(st.lists(st.booleans(), max_size=200))
def test_runs(flags):
    f = np.array(flags, bool)
    if len(f):
        assert (bits.read_runs(bits.runs(f), len(f)) == f).all()


@QUICK
@given(st.sampled_from(DTYPES).flatmap(lambda t: hnp.arrays(t, SHAPES)))
def test_exact_tensors(a):
    for encode, decode in ((streams.encode_exact, streams.decode_exact), (streams.encode_mask, streams.decode_mask)):
        meta, data = encode(a, Config())
        assert decode(load(dump(meta)), data, a.dtype, a.shape).tobytes() == a.tobytes()


@QUICK
@given(hnp.arrays(np.float32, hnp.array_shapes(min_dims=1, max_dims=3, min_side=1, max_side=9), elements=st.floats(-1e3, 1e3, width=32)), st.sampled_from(range(8)), st.sampled_from(["symmetric", "asymmetric"]), st.sampled_from(["per_tensor", "per_channel", "blockwise"]))
def test_lossy_tensors(a, kind, mode, granularity):
    r = tensors.encode("x", a, kind, Config(bits=8, mode=mode, granularity=granularity, block_size=2))
    back = tensors.decode(Record.from_bytes(r.to_bytes(), "x"))
    span = float(np.abs(a).max()) * (max(a.shape) if kind in (tensors.KV_CACHE, tensors.OPTIMIZER_STATE) else 1)
    assert back.shape == a.shape and np.abs(back.astype(float) - a).max() <= 0.05 * span + 1e-5


@QUICK
@given(st.binary(max_size=200))
def test_damaged_records_raise_typed_errors(data):
    r = tensors.encode("x", np.arange(2000, dtype=np.float32).reshape(40, 50), tensors.WEIGHT, Config()).to_bytes()
    for bad in (data, r[:64] + data, data + r):
        try:
            tensors.decode(Record.from_bytes(bad))
        except ValueError:
            pass
