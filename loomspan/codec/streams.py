"""Streams of integers, and tensors that must come back bit by bit."""

from __future__ import annotations

import struct

import numpy as np

from loomspan.codec import bits, rans, registry
from loomspan.codec.errors import CodecError
from loomspan.config import Config

#: Beyond so many elements, sequences and constants are not looked for.
SEARCHED = 16_384

#: Kinds of exact forms, as records name them.
EXACT_KINDS = ("raw", "constant", "sequence", "along", "bytes", "integers", "mask_constant", "mask_triangle", "mask_palette", "mask_bits", "mask_runs")


def encode_symbols(values: np.ndarray, config: Config, width: int | None = None) -> tuple[dict, bytes]:
    """Metadata and bytes of integers. width: how many bits hold each; needed for packing."""
    v = np.ascontiguousarray(values).ravel()
    meta = {"n": int(v.size), "dtype": v.dtype.str}
    if not v.size:
        return meta | {"kind": "empty"}, b""
    if config.pack_bits and width and width < v.dtype.itemsize * 8:
        return meta | {"kind": "packed", "bits": width, "signed": bool(v.min() < 0)}, bits.pack(v, width)
    if config.coder == "rans" and v.dtype.kind in "iub" and -(1 << 31) <= int(v.min()) and int(v.max()) < 1 << 31:
        model, places = _modelled(v)
        if model:
            head = model.to_bytes()
            body = registry.get(registry.CODERS, config.layout).encode(places, model)
            return meta | {"kind": "rans", "layout": config.layout}, struct.pack("<II", len(head), len(body)) + head + body
    return meta | {"kind": "raw"}, v.tobytes()


def _modelled(v: np.ndarray) -> tuple[rans.Model | None, np.ndarray]:
    """None for more symbols than a model holds."""
    if v.size > rans.TOTAL and v.dtype.itemsize > 2 and int(v.max()) - int(v.min()) >= rans.TOTAL and len(np.unique(v)) > rans.TOTAL:
        return None, v
    return rans.Model.of(v)


def decode_symbols(meta: dict, data: bytes) -> np.ndarray:
    dtype, n = np.dtype(meta["dtype"]), int(meta["n"])
    if meta["kind"] == "empty":
        return np.empty(0, dtype)
    if meta["kind"] == "packed":
        return bits.unpack(data, meta["bits"], n, meta["signed"]).astype(dtype)
    if meta["kind"] == "raw":
        if len(data) != n * dtype.itemsize:
            raise CodecError("raw values are cut off")
        return np.frombuffer(data, dtype)
    if meta["kind"] != "rans" or len(data) < 8:
        raise CodecError(f"no such stream: {meta['kind']}")
    head, body = struct.unpack_from("<II", data)
    if len(data) != 8 + head + body:
        raise CodecError("a stream has another length than it says")
    model, coded = rans.Model.from_bytes(data[8 : 8 + head]), data[8 + head :]
    places = registry.get(registry.CODERS, meta["layout"]).decode(coded, n, model)
    if len(places) != n:
        raise CodecError("a stream has another number of symbols than it says")
    return model.symbols[places].astype(dtype)


def _raw_bits(a: np.ndarray) -> np.ndarray:
    """Elements as rows of bytes, so that -0.0 and 0.0, or two NaNs, differ where their bits do."""
    return np.ascontiguousarray(a).reshape(-1, 1).view(np.uint8).reshape(a.size, -1)


def encode_exact(a: np.ndarray, config: Config) -> tuple[dict, bytes]:
    """The shortest of: a sequence, one along an axis, a constant, the raw bytes, the coded bytes or integers. The first of equals wins."""
    from loomspan.codec.record import dump

    found: list[tuple[dict, bytes]] = []
    if a.size and a.size <= SEARCHED:
        if a.dtype.kind in "iu":
            flat = a.ravel().astype(object)
            step = int(flat[1] - flat[0]) if a.size > 1 else 0
            if all(int(flat[0]) + i * step == x for i, x in enumerate(flat)):
                found.append(({"kind": "sequence", "start": int(flat[0]), "step": step}, b""))
            for axis in range(a.ndim) if a.ndim > 1 else ():
                line = np.moveaxis(a, axis, -1).reshape(-1, a.shape[axis])
                first = line[0].astype(object)
                step = int(first[1] - first[0]) if len(first) > 1 else 0
                if (line == line[0]).all() and all(int(first[0]) + i * step == x for i, x in enumerate(first)):
                    found.append(({"kind": "along", "axis": axis, "start": int(first[0]), "step": step}, b""))
                    break
        rows = _raw_bits(a)
        if (rows == rows[0]).all():
            found.append(({"kind": "constant", "value": rows[0].tobytes()}, b""))
    raw = np.ascontiguousarray(a).tobytes()
    found.append(({"kind": "raw"}, raw))
    if config.coder == "rans" and raw:
        meta, body = encode_symbols(np.frombuffer(raw, np.uint8), config)
        found.append(({"kind": "bytes", "stream": meta}, body))
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1:  # whole integers rather than their bytes
            meta, body = encode_symbols(a, config)
            if meta["kind"] == "rans":
                found.append(({"kind": "integers", "stream": meta}, body))
    return min(found, key=lambda x: len(dump(x[0])) + len(x[1]))


def decode_exact(meta: dict, data: bytes, dtype: np.dtype, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape, dtype=object)) if shape else 1
    kind = meta["kind"]
    if kind == "sequence":
        return (meta["start"] + np.arange(n, dtype=object) * meta["step"]).astype(dtype).reshape(shape)
    if kind == "along":
        line = (meta["start"] + np.arange(shape[meta["axis"]], dtype=object) * meta["step"]).astype(dtype)
        return np.broadcast_to(line.reshape([-1 if i == meta["axis"] else 1 for i in range(len(shape))]), shape).copy()
    if kind == "constant":
        return np.frombuffer(meta["value"] * n, dtype).reshape(shape)
    raw = decode_symbols(meta["stream"], data).tobytes() if kind in ("bytes", "integers") else data
    if kind not in ("raw", "bytes", "integers") or len(raw) != n * dtype.itemsize:
        raise CodecError("exact bytes are cut off")
    return np.frombuffer(raw, dtype).reshape(shape)


def encode_mask(a: np.ndarray, config: Config) -> tuple[dict, bytes]:
    """A mask of few values: one, a triangle of two, two by bits or by runs, or up to four by a palette; else exact."""
    rows = _raw_bits(a)
    values, first, places = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    places = places.ravel()
    palette = [v.tobytes() for v in values]
    if len(palette) == 1:
        return {"kind": "mask_constant", "palette": palette}, b""
    exact = encode_exact(a, config)
    if len(palette) == 2:
        p = places.reshape(a.shape)
        if a.ndim >= 2 and a.shape[-1] == a.shape[-2]:
            for lower in (True, False):
                tri = np.tri(a.shape[-1], dtype=bool) if lower else np.tri(a.shape[-1], dtype=bool).T
                for one in (1, 0):
                    if (p == np.where(tri, one, 1 - one)).all():
                        return {"kind": "mask_triangle", "palette": palette, "lower": lower, "one": one}, b""
        flags = places.astype(bool)
        packed, by_runs = np.packbits(flags, bitorder="little").tobytes(), bits.runs(flags)
        kind, body = ("mask_runs", by_runs) if len(by_runs) < len(packed) else ("mask_bits", packed)
        return {"kind": kind, "palette": palette}, body
    if len(palette) <= 4:
        body = bits.pack(places, 2)
        if len(body) < len(exact[1]):
            return {"kind": "mask_palette", "palette": palette}, body
    return exact


def decode_mask(meta: dict, data: bytes, dtype: np.dtype, shape: tuple[int, ...]) -> np.ndarray:
    kind = meta["kind"]
    if not kind.startswith("mask_"):
        return decode_exact(meta, data, dtype, shape)
    values, n = np.frombuffer(b"".join(meta["palette"]), dtype), int(np.prod(shape))
    if kind == "mask_constant":
        return np.full(shape, values[0], dtype) if values[0] == values[0] else np.broadcast_to(values[0], shape).copy()
    if kind == "mask_triangle":
        tri = np.tri(shape[-1], dtype=bool) if meta["lower"] else np.tri(shape[-1], dtype=bool).T
        return values[np.broadcast_to(np.where(tri, meta["one"], 1 - meta["one"]), shape)]
    if kind == "mask_bits":
        places = np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little")
    elif kind == "mask_runs":
        places = bits.read_runs(data, n).astype(int)
    else:
        places = bits.unpack(data, 2, n)
    return values[places.reshape(shape)]
