"""Byte-pair encoding and decoding with a word-end vocabulary, merges found by scanning a contiguous array of ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Fixed values of the vocabulary's format: the pattern of pieces, the mark of a word's last part. What the file says of
#: runs of white space changes no piece, as no piece holds any.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
END = "</w>"
#: Up to so many parts a word is merged by scanning; a longer one through a heap, in n log n.
SHORT = 256
#: Words whose ids a worker remembers, twice over, and the longest that it does.
REMEMBERED, LONGEST = 100_000, 64
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next letter from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def unassigned() -> str:
    """A class of the characters that either of this Python's tables of Unicode lacks."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)]
    edges = [c for c in range(0x110000) if known[c] != (known[c - 1] if c else True)] + [0x110000]
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2])) + r"\p{Cn}]"


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        #: merges[(a, b)] = rank << 32 | id, of ids: the order of the ranks is that of the values.
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + END] for c in letters]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces, self.unknown = regex.compile(PIECES), regex.compile(unassigned())
        self.beyond = regex.compile(r"[^\x00-\u0377]")  # below that, no character is missing from a table
        self.byte, self.path, self.library = {c: b for b, c in enumerate(letters)}, path, None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece."""
        return self._merged(piece.encode("utf-8", "surrogatepass"))

    def _merged(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        """ids[i] starts the part at boundary i; ranks[i] is that of parts i and i + 1. Both arrays stay contiguous."""
        get = self.merges.get
        ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same for a long piece: linked parts, and a heap of (rank, place) with stale entries left in."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := get(pair, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j]), NONE) != r:
                continue
            ids[i], ids[j], after[i] = r & 0xFFFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := get((ids[i], ids[after[i]]), NONE)) != NONE:
                    heapq.heappush(heap, (q, i))
            if before[i] >= 0 and (q := get((ids[before[i]], ids[i]), NONE)) != NONE:
                heapq.heappush(heap, (q, before[i]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.merged(piece)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:  # words seen since the last turn stay for another one
                self.known, self.older = {}, self.known
            self.known[piece] = out
        return out

    def _newer(self, text: str) -> list[bytes]:
        """Pieces of a text with characters that this Python's tables don't know: cut by the library, whose may."""
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in piece) for piece, _ in cut]

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text.isascii() and self.beyond.search(text) and self.unknown.search(text):
            for raw in self._newer(text):
                ids = self._merged(raw)
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            return
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter, so without the form at a word's end
        packed = self._packed
        out += [self.known.get(p) or packed(p) for p in self.pieces.findall(text)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Special tokens in the text become their ids."""
        out: list[bytes] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            self._plain(text[at : m.start()], out)
            out.append(struct.pack("<I", self.special[m[0]]))
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens with spaces between, as the file names no decoder; special tokens are kept."""
        token = self.token
        return " ".join([token[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids, a row per row.

    A null text is empty and has no tokens. Documents are encoded one after another, so a worker holds one at a time
    beside its Arrow batch; there is no shuffle. path is where every worker finds the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(path or vocabulary())
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, len(x), 1000)):
            n, a, b, kept = [], [], [], []
            for text in batch.column(1):
                ids = tool.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(tool.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    kept.append(pa.array(memoryview(ids).cast("I").tolist(), pa.int32()))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                flat = pa.concat_arrays(kept) if kept else pa.array([], pa.int32())
                offsets = [0]
                for x in n:
                    offsets.append(offsets[-1] + x)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"))
