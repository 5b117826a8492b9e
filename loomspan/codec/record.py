"""A compressed tensor as bytes: header, metadata, payload."""

from __future__ import annotations

import base64
import json
import struct
from dataclasses import dataclass, field

import numpy as np

from loomspan.codec.errors import CodecError, HeaderError

#: Fixed values of the format: the header's mark, its layout of 64 bytes, and the limits of its fields.
MARK = b"QNC1"
LAYOUT = "<4sHBBBB10sHI8I6s"
SIZE = struct.calcsize(LAYOUT)
LOSSY, LOSSLESS = 0, 1
DTYPES = (
    "bool",
    "uint8",
    "int8",
    "uint16",
    "int16",
    "uint32",
    "int32",
    "uint64",
    "int64",
    "float16",
    "float32",
    "float64",
)
#: An array in metadata may decode to so many bytes.
MOST = 256 << 20


def dump(value: object) -> bytes:
    """Metadata as JSON with sorted keys; arrays and bytes are tagged and in base 64."""

    def plain(v: object) -> object:
        if isinstance(v, np.ndarray):
            return {"__ndarray__": True, "dtype": v.dtype.str, "shape": list(v.shape), "data": base64.b64encode(np.ascontiguousarray(v).tobytes()).decode()}
        if isinstance(v, bytes):
            return {"__bytes__": True, "data": base64.b64encode(v).decode()}
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v.item() if isinstance(v, np.generic) else v

    try:
        return json.dumps(plain(value), allow_nan=False, sort_keys=True, separators=(",", ":")).encode()
    except (TypeError, ValueError) as e:
        raise CodecError(f"metadata can't be written: {e}") from e


def load(data: bytes) -> dict:
    def rich(v: object) -> object:
        if isinstance(v, list):
            return [rich(x) for x in v]
        if not isinstance(v, dict):
            return v
        if v.get("__bytes__"):
            return base64.b64decode(v["data"], validate=True)
        if v.get("__ndarray__"):
            kind, shape = np.dtype(v["dtype"]), [int(n) for n in v["shape"]]
            count = 1
            for n in shape:
                count *= n
            if kind.hasobject or min(shape, default=0) < 0 or count * kind.itemsize > MOST:
                raise CodecError("an array in metadata is too large or of a kind that is not allowed")
            raw = base64.b64decode(v["data"], validate=True)
            if len(raw) != count * kind.itemsize:
                raise CodecError("an array in metadata is cut off")
            return np.frombuffer(raw, kind).reshape(shape)
        return {k: rich(x) for k, x in v.items()}

    try:
        out = rich(json.loads(data))
    except (ValueError, TypeError, KeyError) as e:
        raise CodecError(f"metadata can't be read: {e}") from e
    if not isinstance(out, dict):
        raise CodecError("metadata is not an object")
    return out


@dataclass
class Record:
    """One compressed tensor."""

    name: str
    tensor_type: int
    dtype: str
    shape: tuple[int, ...]
    mode: int
    strategy: int
    checksum: int
    meta: dict = field(default_factory=dict)
    payload: bytes = b""
    nbytes: int = 0

    def header(self) -> bytes:
        if len(self.shape) > 8 or any(not 0 <= n < 1 << 32 for n in self.shape):
            raise HeaderError(f"a shape of 8 axes below 2**32 at most, not {self.shape}")
        name = self.dtype.encode("ascii")
        if len(name) > 10:
            raise HeaderError(f"the name of a type has 10 characters at most: {self.dtype}")
        return struct.pack(LAYOUT, MARK, 1, self.tensor_type, self.mode, len(self.shape), len(name), name, self.strategy, self.checksum, *self.shape, *[0] * (8 - len(self.shape)), b"")

    def with_header(self, data: bytes) -> Record:
        """This record with the fields of a header."""
        if len(data) < SIZE:
            raise HeaderError("a header is cut off")
        mark, version, kind, mode, axes, width, dtype, strategy, checksum, *dims = struct.unpack(LAYOUT, data[:SIZE])
        if mark != MARK or version != 1 or kind > 8 or mode > 1 or axes > 8 or width > 10:
            raise HeaderError("not a header")
        name = dtype[:width].decode("ascii", "replace")
        if name not in DTYPES:
            raise HeaderError(f"no such type of elements: {name}")
        self.tensor_type, self.mode, self.dtype, self.strategy, self.checksum = kind, mode, name, strategy, checksum
        self.shape = tuple(dims[:axes])
        return self

    def to_bytes(self) -> bytes:
        meta = dump(self.meta)
        return self.header() + struct.pack("<QII", self.nbytes, len(meta), len(self.payload)) + meta + self.payload

    @classmethod
    def blank(cls, name: str = "") -> Record:
        return cls(name, 5, "float32", (), 0, 0, 0)

    @classmethod
    def from_bytes(cls, data: bytes, name: str = "") -> Record:
        out = cls.blank(name).with_header(data)
        if len(data) < SIZE + 16:
            raise CodecError("a record is cut off")
        out.nbytes, m, p = struct.unpack_from("<QII", data, SIZE)
        if len(data) != SIZE + 16 + m + p:
            raise CodecError("a record has another length than it says")
        out.meta, out.payload = load(data[SIZE + 16 : SIZE + 16 + m]), data[SIZE + 16 + m :]
        return out

    @property
    def compressed(self) -> int:
        return SIZE + len(dump(self.meta)) + len(self.payload)

    @property
    def ratio(self) -> float:
        return self.nbytes / self.compressed
