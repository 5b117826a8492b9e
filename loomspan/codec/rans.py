"""Range coding of symbols by asymmetric numeral systems: many interleaved lanes, and a single one of 64 bits."""

from __future__ import annotations

import struct

import numpy as np

from loomspan.codec.errors import EntropyError

#: Frequencies add up to 2**16; the single lane keeps its state at 2**56 or more and moves bytes.
SCALE = 16
TOTAL = 1 << SCALE
SINGLE_LEAST = 1 << 56
#: The interleaved lanes keep theirs at 2**16 or more, below 2**32, and move 16 bits: one word a step at most.
LANES, STEPS = 4096, 512


def normalize(counts: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Counts in the order of their symbols, scaled to add up to total, each at least 1."""
    c = np.asarray(counts, np.int64)
    if not len(c) or len(c) > total or c.min() < 1:
        raise EntropyError(f"{len(c)} symbols, or a count below 1, for a total of {total}")
    f = np.maximum(1, np.floor(c * (float(total) / float(c.sum()))).astype(np.int64))
    gap = total - int(f.sum())
    if gap > 0:
        turn = np.lexsort((np.arange(len(c)), -c))
        f += gap // len(c)
        f[turn[: gap % len(c)]] += 1
    while gap < 0:  # one off each in turn, pass by pass
        turn = np.lexsort((np.arange(len(c)), -f))
        turn = turn[f[turn] > 1][:-gap]
        f[turn] -= 1
        gap += len(turn)
    return f


class Model:
    """Symbols in order with their frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = np.asarray(symbols, np.int64), np.asarray(freq, np.int64)
        if not len(self.symbols) or len(self.symbols) != len(self.freq) or self.freq.min() < 1 or int(self.freq.sum()) != TOTAL:
            raise EntropyError(f"frequencies do not add up to {TOTAL}")
        self.start = np.cumsum(self.freq) - self.freq

    @classmethod
    def of(cls, values: np.ndarray) -> tuple[Model, np.ndarray]:
        """A model of the values, and the place in it of each."""
        v = np.asarray(values).ravel()
        lo = int(v.min())
        if int(v.max()) - lo < 1 << 18:  # a table of counts, without a sort
            v = v.astype(np.int64) - lo
            counts = np.bincount(v)
            found = np.flatnonzero(counts)
            place = np.zeros(len(counts), np.int64)
            place[found] = np.arange(len(found))
            return cls(found + lo, normalize(counts[found])), place[v]
        symbols, places, counts = np.unique(v, return_inverse=True, return_counts=True)
        return cls(symbols, normalize(counts)), places.ravel()

    def to_bytes(self) -> bytes:
        rows = np.empty(len(self.symbols), [("s", "<i4"), ("f", "<u4")])
        rows["s"], rows["f"] = self.symbols, self.freq
        return struct.pack("<I", len(rows)) + rows.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        n = struct.unpack_from("<I", data)[0] if len(data) >= 4 else -1
        if n < 1 or len(data) != 4 + 8 * n:
            raise EntropyError("a model is cut off")
        rows = np.frombuffer(data, [("s", "<i4"), ("f", "<u4")], offset=4)
        if (np.diff(rows["s"].astype(np.int64)) <= 0).any():
            raise EntropyError("symbols are not in order")
        return cls(rows["s"], rows["f"])

    def bits(self, counts: np.ndarray) -> float:
        p = np.asarray(counts, float) / np.sum(counts)
        return float(-(p * np.log2(p)).sum())


def lanes_for(n: int) -> int:
    """Lanes for n symbols: enough steps a lane to repay its state of 4 bytes."""
    return max(1, min(LANES, n // STEPS))


def encode(places: np.ndarray, model: Model) -> bytes:
    """Symbol i goes to lane i mod lanes. Steps run backwards, all lanes at once; words are kept step by step, forwards."""
    n = len(places)
    k = lanes_for(n)
    steps = -(-n // k)
    # states are below 2**32 and frequencies above 0, so that a quotient in doubles, cut off, is exact
    freq, start = model.freq.astype(np.float64), model.start.astype(np.int64)
    whole, limit = model.freq.astype(np.int64), model.freq.astype(np.int64) << 16
    x = np.full(k, 1 << 16, np.int64)
    words: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        s = places[t * k : min(n, (t + 1) * k)]
        y = x[: len(s)]
        full = y >= limit[s]
        words.append(y[full].astype("<u2"))
        y = np.where(full, y >> 16, y)
        q = (y / freq[s]).astype(np.int64)
        x[: len(s)] = (q << SCALE) + start[s] + (y - q * whole[s])
    return struct.pack("<II", n, k) + x.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode(data: bytes, model: Model) -> np.ndarray:
    """Places of the symbols. The end state is checked: each lane must be back where it began, with no word left."""
    if len(data) < 8:
        raise EntropyError("a stream is cut off")
    n, k = struct.unpack_from("<II", data)
    if k < 1 or k != lanes_for(n) or len(data) < 8 + 4 * k or (len(data) - 8 - 4 * k) % 2:
        raise EntropyError("a stream is cut off")
    x = np.frombuffer(data, "<u4", k, 8).astype(np.int64)
    words = np.frombuffer(data, "<u2", offset=8 + 4 * k).astype(np.int64)
    slot = np.repeat(np.arange(len(model.freq)), model.freq)
    freq = model.freq[slot]  # of each slot, and its place among its symbol's slots
    within = np.arange(TOTAL) - model.start[slot]
    out, at = np.empty(n, np.int64), 0
    for t in range(-(-n // k)):
        y = x[: min(k, n - t * k)]
        low = y & (TOTAL - 1)
        out[t * k : t * k + len(low)] = slot[low]
        y = freq[low] * (y >> SCALE) + within[low]
        short = np.flatnonzero(y < 1 << 16)
        if at + len(short) > len(words):
            raise EntropyError("a stream is cut off")
        y[short] = (y[short] << 16) | words[at : at + len(short)]
        at += len(short)
        x[: len(low)] = y
    if at != len(words) or (x != 1 << 16).any():
        raise EntropyError("a stream does not end where it began")
    return out


def encode_single(places: np.ndarray, model: Model) -> bytes:
    """One lane: for files that need the layout of a single state of 64 bits, which comes first."""
    x, out = SINGLE_LEAST, bytearray()
    freq, start = model.freq.tolist(), model.start.tolist()
    for s in reversed(np.asarray(places).tolist()):
        f = freq[s]
        while f < TOTAL and x >= f << 48:
            out.append(x & 0xFF)
            x >>= 8
        x = (x // f << SCALE) + start[s] + x % f
    return struct.pack("<Q", x) + bytes(reversed(out))


def decode_single(data: bytes, n: int, model: Model) -> np.ndarray:
    if len(data) < 8:
        raise EntropyError("a stream is cut off")
    x, at = struct.unpack_from("<Q", data)[0], 8
    freq, start = model.freq.tolist(), model.start.tolist()
    slot = np.repeat(np.arange(len(freq)), model.freq).tolist()
    out = []
    for _ in range(n):
        low = x & (TOTAL - 1)
        s = slot[low]
        out.append(s)
        x = freq[s] * (x >> SCALE) + low - start[s]
        while x < SINGLE_LEAST:
            if at >= len(data):
                raise EntropyError("a stream is cut off")
            x = x << 8 | data[at]
            at += 1
    if at != len(data) or x != SINGLE_LEAST:
        raise EntropyError("a stream does not end where it began")
    return np.array(out, np.int64)
