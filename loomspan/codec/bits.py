"""Packed integers: fixed widths, least bit first, and variable-length ones of 7 bits a byte."""

from __future__ import annotations

import numpy as np

from loomspan.codec.errors import CodecError


def pack(values: np.ndarray, bits: int) -> bytes:
    """Integers of bits bits each, two's complement if negative, back to back."""
    v = np.ascontiguousarray(values, dtype=np.int64)
    if not 1 <= bits <= 32:
        raise CodecError(f"bits must be 1 to 32, not {bits}")
    if v.size and (v.min() < -(1 << (bits - 1)) or v.max() >= 1 << bits):
        raise CodecError(f"a value does not fit in {bits} bits")
    planes = (v[:, None] >> np.arange(bits) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, signed: bool = False) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) != -(-n * bits // 8):
        raise CodecError(f"{len(raw)} bytes do not hold {n} values of {bits} bits")
    planes = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits).astype(np.int64)
    out = planes @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return np.where(out >= 1 << (bits - 1), out - (1 << bits), out) if signed else out


def uvarint(value: int) -> bytes:
    if value < 0:
        raise CodecError("an unsigned integer can't be negative")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place after it."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            break
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            if value >> 64:
                break
            return value, at
    raise CodecError("malformed integer of variable length")


def svarint(value: int) -> bytes:
    return uvarint(2 * value if value >= 0 else -2 * value - 1)


def read_svarint(data: bytes, at: int) -> tuple[int, int]:
    v, at = read_uvarint(data, at)
    return (-(v + 1) // 2 if v & 1 else v // 2), at


def runs(flags: np.ndarray) -> bytes:
    """The first flag, then the lengths of the runs."""
    f = np.asarray(flags, bool).ravel()
    if not f.size:
        return b"\0"
    ends = np.append(np.flatnonzero(f[1:] != f[:-1]) + 1, f.size)
    return bytes([int(f[0])]) + b"".join(uvarint(int(n)) for n in np.diff(ends, prepend=0))


def read_runs(data: bytes, n: int) -> np.ndarray:
    out, at, flag, done = np.empty(n, bool), 1, bool(data[0]), 0
    while at < len(data):
        size, at = read_uvarint(data, at)
        if done + size > n:
            raise CodecError("runs are longer than the tensor")
        out[done : done + size] = flag
        done, flag = done + size, not flag
    if done != n:
        raise CodecError("runs are shorter than the tensor")
    return out
