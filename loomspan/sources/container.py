"""One file with many compressed tensors: a header, then segments, each with its metadata and payload."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from loomspan.codec import bits
from loomspan.codec.errors import CodecError
from loomspan.codec.record import LOSSLESS, Record, dump, load
from loomspan.codec.streams import decode_exact
from loomspan.sources.formats import ranges, store_of

#: Fixed values of the format: marks, versions, flags, kinds of segments, layouts.
MARK, SEGMENT_MARK, BUNDLE_MARK = b"QNCB", b"QNCS", b"QNTB"
ONE, TWO, THREE = 1, 2, 3
STREAMED, COUNTED, UNKNOWN = 1, 2, 0xFFFFFFFF
TENSOR, CHUNK, BUNDLE = 1, 2, 3
LEAD, COUNT, REST, SEGMENT = "<4sH", "<I", "<HI", "<4sBBHQQ"
MOST_META, MOST_PAYLOAD = 256 << 20, 4 << 30
#: Kinds of bundled tensors in the order of their codes, and types of elements in that of theirs.
KINDS = ("raw", "constant", "sequence", "along")
ELEMENTS = ("|b1", "|u1", "|i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f2", "<f4", "<f8")
#: Exact tensors up to so many bytes are bundled; up to twice as many if their form says it all.
BUNDLED = 2048
#: A segment of the writer's holds so many of them at most, so that what waits is bounded.
MOST_BUNDLED = 65_536


@dataclass(frozen=True)
class Entry:
    """A tensor in a file: its record without payload, and where the payload's chunks are."""

    name: str
    record: Record
    chunks: tuple[tuple[int, int], ...]
    storage: int
    bundle: bool = field(default=False)


def bundles(r: Record) -> bool:
    kind = r.meta.get("kind")
    limit = BUNDLED if kind == "raw" else 2 * BUNDLED
    return r.mode == LOSSLESS and kind in KINDS and r.nbytes <= limit and len(r.shape) < 256


def _bundle_entry(r: Record) -> tuple[bytes, bytes]:
    kind, token, name = r.meta["kind"], np.dtype(r.dtype).str, r.name.encode()
    out = bytearray(bits.uvarint(len(name)) + name)
    out += bytes([KINDS.index(kind), r.tensor_type]) + struct.pack("<HI", r.strategy, r.checksum)
    out += bytes([ELEMENTS.index(token)]) if token in ELEMENTS else bytes([0xFF, len(token)]) + token.encode()
    out += bytes([len(r.shape)]) + b"".join(map(bits.uvarint, r.shape))
    if kind == "along":
        out.append(r.meta["axis"])
    if kind in ("sequence", "along"):
        out += bits.svarint(r.meta["start"]) + bits.svarint(r.meta["step"])
    return bytes(out), r.meta["value"] if kind == "constant" else r.payload


class Writer:
    """Writes records as they come. Small exact ones wait, to share a segment if there are two or more of them in a row.

    count: how many records there will be, if that is known; the header then tells it, and another number raises at the end.
    """

    def __init__(self, path: str, chunk_size: int = 1 << 20, version: int = THREE, count: int | None = None) -> None:
        self.store, self.path = store_of(path)
        self.chunk_size, self.version, self.n, self.waiting, self.count = chunk_size, version, 0, [], count
        self.file = self.store.open_output_stream(self.path, compression=None)
        # the count is at the end of the header, which a stream can't go back to: if it is not known before, it is told as unknown
        told = (STREAMED, UNKNOWN) if count is None else (STREAMED | COUNTED, count)
        self.file.write(struct.pack(LEAD, MARK, version) + struct.pack(REST, *told))

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self._flush()
        self.file.close()
        if kind is None and self.count not in (None, self.n):
            raise CodecError(f"{self.n} tensors were written where {self.count} were told")

    def _segment(self, kind: int, meta: bytes, payload: bytes) -> None:
        self.file.write(struct.pack(SEGMENT, SEGMENT_MARK, 1, kind, 0, len(meta), len(payload)))
        self.file.write(meta)
        self.file.write(payload)

    def add(self, r: Record) -> None:
        if self.version == THREE and bundles(r):
            self.waiting.append(r)
            if len(self.waiting) == MOST_BUNDLED:
                self._flush()
            return
        self._flush()
        self._tensor(r)

    def _flush(self) -> None:
        rows, self.waiting = self.waiting, []
        if len(rows) < 2:
            for r in rows:
                self._tensor(r)
            return
        parts = [_bundle_entry(r) for r in rows]
        self._segment(BUNDLE, BUNDLE_MARK + b"\1" + bits.uvarint(len(rows)) + b"".join(m for m, _ in parts), b"".join(p for _, p in parts))
        self.n += len(rows)

    def _tensor(self, r: Record) -> None:
        cut = list(ranges(len(r.payload), self.chunk_size))
        meta = {"chunk_count": len(cut), "chunk_lengths": [n for _, n in cut], "header": r.header(), "metadata": dump(r.meta), "name": r.name, "original_nbytes": r.nbytes, "record_id": self.n}
        self._segment(TENSOR, dump(meta), b"")
        for i, (at, n) in enumerate(cut):
            self._segment(CHUNK, dump({"index": i, "length": n, "record_id": self.n}), r.payload[at : at + n])
        self.n += 1


def write(path: str, records: Iterable[Record], chunk_size: int = 1 << 20, version: int = THREE, count: int | None = None) -> int:
    with Writer(path, chunk_size, version, count) as w:
        for r in records:
            w.add(r)
    return w.n


def scan(path: str) -> Iterator[Entry]:
    """Entries of a file of any version. Payloads are skipped; lengths, order and counts are checked."""
    store, path = store_of(path)
    with store.open_input_file(path) as f:
        size = f.size()

        def take(layout: str) -> tuple:
            n = struct.calcsize(layout)
            raw = f.read(n)
            if len(raw) != n:
                raise CodecError("a file of tensors is cut off")
            return struct.unpack(layout, raw)

        mark, version = take(LEAD)
        if mark != MARK or version not in (ONE, TWO, THREE):
            raise CodecError("not a file of tensors")
        if version == ONE:
            yield from _scan_one(f, take(COUNT)[0], take, size)
            return
        flags, count = take(REST)
        n = 0
        while f.tell() < size:
            begin = f.tell()
            kind, meta, at, length = _segment(f, take, size)
            if kind == BUNDLE and version == THREE:
                rows = list(_unbundle(meta, at, length))
                yield from rows
                n += len(rows)
                continue
            if kind != TENSOR or length:
                raise CodecError("a segment out of place")
            m = load(meta)
            if m["record_id"] != n or m["chunk_count"] != len(m["chunk_lengths"]):
                raise CodecError("a record out of order")
            chunks = []
            for i, want in enumerate(m["chunk_lengths"]):
                kind, meta, at, length = _segment(f, take, size)
                c = load(meta) if kind == CHUNK else {}
                if (c.get("index"), c.get("length"), c.get("record_id"), length) != (i, want, n, want):
                    raise CodecError("a chunk out of place")
                chunks.append((at, length))
            r = Record.blank(m["name"]).with_header(m["header"])
            r.meta, r.nbytes = load(m["metadata"]), m["original_nbytes"]
            yield Entry(r.name, r, tuple(chunks), f.tell() - begin)
            n += 1
        if flags & COUNTED and count not in (UNKNOWN, n):
            raise CodecError(f"a file of {n} tensors that says {count}")


def _segment(f: object, take: object, size: int) -> tuple[int, bytes, int, int]:
    mark, version, kind, _, meta, payload = take(SEGMENT)
    if mark != SEGMENT_MARK or version != 1 or meta > MOST_META or payload > MOST_PAYLOAD or f.tell() + meta + payload > size:
        raise CodecError("a segment is cut off, or is not one")
    raw, at = f.read(meta), f.tell()
    f.seek(at + payload)
    return kind, raw, at, payload


def _scan_one(f: object, count: int, take: object, size: int) -> Iterator[Entry]:
    for _ in range(count):
        begin = f.tell()
        name = f.read(take("<I")[0]).decode()
        head = f.read(take("<I")[0])
        meta = f.read(take("<Q")[0])
        length = take("<Q")[0]
        at = f.tell()
        if at + length > size:
            raise CodecError("a file of tensors is cut off")
        f.seek(at + length)
        r = Record.blank(name).with_header(head)
        r.meta, r.nbytes = load(meta), int(np.prod(r.shape, dtype=object)) * np.dtype(r.dtype).itemsize
        yield Entry(name, r, ((at, length),), f.tell() - begin)
    if f.tell() != size:
        raise CodecError("bytes after the last tensor")


def _unbundle(meta: bytes, base: int, length: int) -> Iterator[Entry]:
    if meta[:5] != BUNDLE_MARK + b"\1":
        raise CodecError("not a bundle")
    count, at = bits.read_uvarint(meta, 5)
    shared = at + struct.calcsize(SEGMENT)
    used = 0
    for i in range(count):
        begin = at
        n, at = bits.read_uvarint(meta, at)
        name, at = meta[at : at + n].decode(), at + n
        kind, tensor_type = KINDS[meta[at]], meta[at + 1]
        strategy, checksum = struct.unpack_from("<HI", meta, at + 2)
        token, at = meta[at + 8], at + 9
        if token == 0xFF:
            n = meta[at]
            dtype, at = np.dtype(meta[at + 1 : at + 1 + n].decode()), at + 1 + n
        else:
            dtype = np.dtype(ELEMENTS[token])
        axes, at, shape = meta[at], at + 1, []
        for _ in range(axes):
            d, at = bits.read_uvarint(meta, at)
            shape.append(d)
        r = Record(name, tensor_type, dtype.name, tuple(shape), LOSSLESS, strategy, checksum, {"kind": kind})
        r.nbytes = int(np.prod(shape, dtype=object)) * dtype.itemsize
        if kind == "along":
            r.meta["axis"], at = meta[at], at + 1
        if kind in ("sequence", "along"):
            r.meta["start"], at = bits.read_svarint(meta, at)
            r.meta["step"], at = bits.read_svarint(meta, at)
        size = {"raw": r.nbytes, "constant": dtype.itemsize}.get(kind, 0)
        # the part that all share is divided among them, the first ones taking the remainder
        share = shared // count + (i < shared % count)
        yield Entry(name, r, ((base + used, size),), share + at - begin + size, True)
        used += size
    if at != len(meta) or used != length:
        raise CodecError("a bundle has another length than it says")


def fetch(path: str, e: Entry) -> Record:
    """The record with its payload, chunk by chunk."""
    store, path = store_of(path)
    with store.open_input_file(path) as f:
        data = b"".join(f.read_at(n, at) for at, n in e.chunks)
    r = Record(**{**e.record.__dict__, "payload": data})
    if e.bundle and r.meta["kind"] == "constant":
        r.meta, r.payload = r.meta | {"value": data}, b""
    return r


def exact(r: Record) -> np.ndarray:
    """The tensor of a bundled record."""
    return decode_exact(r.meta, r.payload, np.dtype(r.dtype), r.shape)
