"""Files of tensors: what they hold and where, without reading it, so that readers can be planned by byte ranges."""

from __future__ import annotations

import ast
import io
import json
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

from loomspan.codec.errors import CodecError

#: Types of elements by their names in safetensors files.
SAFE_TYPES = {"BOOL": "bool", "U8": "uint8", "I8": "int8", "U16": "uint16", "I16": "int16", "U32": "uint32", "I32": "int32", "U64": "uint64", "I64": "int64", "F16": "float16", "F32": "float32", "F64": "float64", "BF16": "bfloat16"}
SUFFIXES = (".npy", ".npz", ".safetensors", ".qnc")


@dataclass(frozen=True)
class Place:
    """Where a tensor's bytes are: little-endian, C order. member: inside an archive, read as a whole."""

    path: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    at: int = 0
    member: str = ""

    @property
    def width(self) -> int:
        return 2 if self.dtype == "bfloat16" else np.dtype(self.dtype).itemsize

    @property
    def size(self) -> int:
        n = self.width
        for d in self.shape:
            n *= d
        return n


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def files(uri: str) -> list[str]:
    """The files of a path: itself, or all below it with a known suffix, sorted."""
    store, path = store_of(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        if not path.endswith(SUFFIXES):
            raise CodecError(f"not a file of tensors: {path}")
        return [path]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIXES))


def npy_header(f: io.BufferedIOBase) -> tuple[str, tuple[int, ...], int]:
    """Type, shape and length of the header of an array file. Objects, big-endian or Fortran order are refused."""
    lead = f.read(10)
    if lead[:6] != b"\x93NUMPY":
        raise CodecError("not an array file")
    if lead[6] == 1:
        size, skip = struct.unpack("<H", lead[8:10])[0], 10
    else:
        size, skip = struct.unpack("<I", lead[8:10] + f.read(2))[0], 12
    head = ast.literal_eval(f.read(size).decode("latin1"))
    dtype = np.dtype(head["descr"])
    if dtype.hasobject or dtype.byteorder == ">" or head["fortran_order"]:
        raise CodecError("an array file with objects, big-endian or Fortran order")
    return dtype.name, tuple(head["shape"]), skip + size


def safe_header(f: io.BufferedIOBase) -> tuple[dict, int]:
    """Entries of a safetensors file, and where its data begins."""
    size = struct.unpack("<Q", f.read(8))[0]
    if size > 100 << 20:
        raise CodecError("the header of a safetensors file is too long")
    return json.loads(f.read(size)), 8 + size


def places(uri: str) -> list[Place]:
    """All tensors of a file or folder, by name; array files are named by their path in the folder without suffix."""
    store, root = store_of(uri)
    out: list[Place] = []
    for path in files(uri):
        with store.open_input_file(path) as f:
            if path.endswith(".npy"):
                dtype, shape, at = npy_header(f)
                inside = path[len(root) :].lstrip("/") if path != root else path.rpartition("/")[2]
                out.append(Place(path, inside.removesuffix(".npy").replace("\\", "/"), dtype, shape, at))
            elif path.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    for m in sorted(z.namelist()):
                        with z.open(m) as g:
                            dtype, shape, at = npy_header(g)
                        out.append(Place(path, m.removesuffix(".npy"), dtype, shape, at, m))
            elif path.endswith(".safetensors"):
                entries, base = safe_header(f)
                for name in sorted(set(entries) - {"__metadata__"}):
                    e = entries[name]
                    if e["dtype"] not in SAFE_TYPES:
                        raise CodecError(f"{name} has elements of a type that is not supported: {e['dtype']}")
                    out.append(Place(path, name, SAFE_TYPES[e["dtype"]], tuple(e["shape"]), base + e["data_offsets"][0]))
    return sorted(out, key=lambda p: p.name)


def unique(found: Iterable[Place]) -> dict[str, Place]:
    """Places by name; a name in two files raises."""
    out: dict[str, Place] = {}
    for p in found:
        if p.name in out:
            raise ValueError(f"{p.name} is in {out[p.name].path} and in {p.path}")
        out[p.name] = p
    return out


def read(p: Place, first: int = 0, size: int | None = None) -> bytes:
    """Bytes of a tensor, or some of them; bfloat16 as float32."""
    store, _ = store_of(p.path)
    size = p.size - first if size is None else size
    with store.open_input_file(p.path) as f:
        if p.member:
            with zipfile.ZipFile(f) as z, z.open(p.member) as g:
                g.seek(p.at + first)
                data = g.read(size)
        else:
            data = f.read_at(size, p.at + first)
    if len(data) != size:
        raise CodecError(f"{p.name} is cut off")
    return (np.frombuffer(data, "<u2").astype("<u4") << 16).tobytes() if p.dtype == "bfloat16" else data


def write_npy(store: fs.FileSystem, path: str, dtype: str, shape: tuple[int, ...], parts: Iterable[bytes]) -> None:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": tuple(shape)})
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        f.write(head.getvalue())
        for part in parts:
            f.write(part)


def write_safetensors(store: fs.FileSystem, path: str, tensors: list[tuple[str, str, tuple[int, ...], bytes]]) -> None:
    names = {v: k for k, v in SAFE_TYPES.items()}
    head, at = {}, 0
    for name, dtype, shape, data in tensors:
        head[name] = {"dtype": names[dtype], "shape": list(shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
    raw = json.dumps(head, separators=(",", ":")).encode()
    raw += b" " * (-len(raw) % 8)
    with store.open_output_stream(path, compression=None) as f:
        f.write(struct.pack("<Q", len(raw)) + raw)
        for *_, data in tensors:
            f.write(data)


def ranges(size: int, step: int) -> Iterator[tuple[int, int]]:
    """(from, length) of the pieces of size bytes; one empty piece for none."""
    for at in range(0, max(1, size), step):
        yield at, min(step, size - at)
