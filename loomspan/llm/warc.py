"""WARC archives of pages, and an index of two levels over them: a sparse directory of compressed, sorted blocks."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, new_path, spread, staged, table

#: An archive is closed beyond so many bytes; lines in an index block; bytes of an archive that one range read covers; bytes
#: between two records that are read along rather than by another request.
ARCHIVE, BLOCK, STRETCH, GAP = 256 << 20, 3000, 4 << 20, 64 << 10
#: Fixed values of the format.
VERSION, DATE = "WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TRAILER = "<QI"


def surt(url: str | None) -> str:
    """The index key of a URL: the host's labels reversed, then the rest; without spaces or control characters."""
    rest = (url or "").partition("://")[2] or (url or "")
    m = re.match(r"([^/?#]*)(.*)", rest, re.S)
    host, path = m[1].lower(), m[2]
    key = ",".join(reversed(host.split("."))) + ")" + path
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", key)


def entry_key(url: str | None, page_id: int | None) -> bytes:
    return f"{surt(url)} {page_id}".encode("utf-8", "surrogatepass")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all workers see: local, or any store that pyarrow knows by its scheme."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return _member(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\r\n]", lambda c: f"%{ord(c[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": len(payload),  # an extension: a revisit has no payload of its own to measure
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record(fields, http if revisit else http + payload)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under folder; entries (key, archive, at, size), one per record.

    Of the records with equal payloads of least bytes or more, that with the largest page_id is the response and the others
    revisit it. Only payloads that occur twice are joined back to the pages, by digest: they are broadcast while few,
    and joined by a shuffle otherwise. A task writes archives under names of its own attempt; entries name only those of
    the attempts that counted, as they are staged when written.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.select("page_id", F.sha1(body).alias("sum"), F.length(body).alias("n")).filter(F.col("n") >= least)
    last = sums.groupBy("sum").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select(F.col("sum").alias("_sum"), "last")
    last = staged(last, "payloads")
    rows = pages.select("page_id", "url", body.alias("payload"))
    # one payload may be a third of all pages, so the few of them are broadcast rather than shuffled to
    small = last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(last) if small else last, F.sha1("payload") == F.col("_sum"), "left").select(F.col("page_id").cast("long"), "url", "payload", F.col("last").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, name, at = None, "", 0
        for b in batches:
            keys, names, places, sizes = [], [], [], []
            for page_id, url, payload, last_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if out is None or at > ARCHIVE:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    at += out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{name}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                data = payload.as_py()
                member = page_record(page_id, url, data, base32_sha1(data), last_id, last_id is not None and last_id != page_id)
                out.write(member)
                keys.append(entry_key(url, page_id))
                names.append(name)
                places.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["key", "archive", "at", "size"])
        if out is not None:
            out.close()

    return staged(rows.mapInArrow(run, "key binary, archive string, at long, size long"), "entries")


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Sorts entries by key into index files under folder; (file, first), a row per file: the index's upper level.

    A file is a range of keys: blocks of BLOCK lines, each compressed on its own, then the directory (first key, place and
    size of each block), then a trailer. Keys hold the page_id, so that captures of one URL, however many, spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        name, out, at, directory, lines = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush() -> None:
            nonlocal at
            block = zlib.compress(b"\n".join(lines), 6)
            directory.append(b"%s\t%d %d" % (lines[0].partition(b"\t")[0], at, len(block)))
            out.write(block)
            at += len(block)
            lines.clear()

        for b in batches:
            for key, archive, place, size in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(b"%s\t%s %d %d" % (key, archive.encode(), place, size))
                if len(lines) >= BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(b"\n".join(directory), 6)
            out.write(packed + struct.pack(_TRAILER, at, len(packed)))
            out.close()
            first = directory[0].partition(b"\t")[0]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.binary())], ["file", "first"])

    return staged(entries.repartitionByRange(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "file string, first binary"), "index")


class IndexFile:
    """One index file: its directory in memory, its blocks by range reads, the last of them kept."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(_TRAILER)
        at, n = struct.unpack(_TRAILER, self.file.read_at(tail, size - tail))
        rows = [x.split(b"\t") for x in zlib.decompress(self.file.read_at(n, at)).split(b"\n")]
        self.first = [r[0] for r in rows]
        self.places = [tuple(map(int, r[1].split(b" "))) for r in rows]
        self.held: tuple[int, list[bytes], list[bytes]] = (-1, [], [])

    def block(self, i: int) -> tuple[list[bytes], list[bytes]]:
        if self.held[0] != i:
            at, n = self.places[i]
            rows = [x.split(b"\t") for x in zlib.decompress(self.file.read_at(n, at)).split(b"\n")]
            self.held = (i, [r[0] for r in rows], [r[1] for r in rows])
        return self.held[1:]

    def find(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """All entries of a key: by binary search in the directory, then in the block."""
        i = max(0, bisect_left(self.first, key) - 1)
        while i < len(self.first) and self.first[i] <= key:
            keys, values = self.block(i)
            for j in range(bisect_left(keys, key), bisect_right(keys, key)):
                name, at, size = values[j].split(b" ")
                yield name.decode(), int(at), int(size)
            i += 1


def look_up(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """wanted (page_id, url) to (archive, at, size): the entries of each distinct pair, through the index.

    The upper level, a row per index file and so at most one per partition of the sort, goes to every task, which routes
    its keys by binary search. Then keys go to the tasks of their files.
    """
    upper = sorted((bytes(r["first"]), r["file"]) for r in index.collect())
    firsts, names = [f for f, _ in upper], [n for _, n in upper]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [entry_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            files = [names[max(0, bisect_right(firsts, k) - 1)] for k in keys] if names else [""] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(keys, pa.binary())], ["file", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        name, index_file = None, None
        for b in batches:
            found = []
            for file, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    name, index_file = file, IndexFile(store, f"{root}/{file}")
                found += index_file.find(key)
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "at", "size"])

    keys = wanted.select("page_id", "url").mapInArrow(route, "file string, key binary").distinct()
    return keys.repartition(spread(wanted.sparkSession), "file").sortWithinPartitions("file", "key").mapInArrow(run, "archive string, at long, size long")


def spans(entries: Iterable[tuple[str, int, int]], stretch: int = STRETCH, gap: int = GAP) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Entries (archive, at, size), in order, to what is read at once: records of one archive that are gap bytes apart at
    most, over stretch bytes, or one larger record."""
    name, held = None, []
    for archive, at, size in entries:
        if held and (archive != name or at - sum(held[-1]) > gap or at + size - held[0][0] > stretch):
            yield name, held
            held = []
        name = archive
        held.append((at, size))
    if held:
        yield name, held


def read_records(entries: DataFrame, folder: str) -> DataFrame:
    """Reads records by range, in the order of each archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Records near to each other share a range (spans), so that a store sees a request per STRETCH, not one per page. A response whose payload does not have the digest in its header raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        name, file = None, None
        for b in batches:
            rows: list[tuple] = []
            for archive, places in spans(zip(*(c.to_pylist() for c in b.columns))):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                start = places[0][0]
                data = memoryview(file.read_at(sum(places[-1]) - start, start))
                for at, size in places:
                    fields, payload = parse(data[at - start : at - start + size])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{archive} at {at}: payload and digest differ")
                    rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = entries.select("archive", "at", "size").repartition(spread(entries.sparkSession), "archive", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if n in ("", "None") else int(n)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) in the shared folder, indexes them, and reads each back through the index.

    One row per row of pages. Null html is an empty payload, a null url an empty key. Rows that repeat page_id and payload
    are responses each if theirs is the largest page_id. A null page_id counts as the smallest. An empty
    table gives an empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    entries = write_archives(pages, folder, least)
    index = write_index(entries, folder)
    return read_records(look_up(pages, index, folder), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same result from the pages alone: digests in base 32 from 20 bits at a time.
OP7_SQL = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as x from pages),
m as (select x, max(page_id) as last from d group by x)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(d.x, cast(k // 4 as int) * 5 + 1, 5) as bigint) >> cast(15 - 5 * (k % 4) as int)) & 31 as int), 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from d join m using (x)
"""
