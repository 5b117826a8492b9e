"""Repeated passages of 200 bytes and more: interval trees over suffixes at content-chosen places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dimension_join, staged, table

#: Length of a repeat, and of the string whose hash chooses the places whose suffixes are sorted.
LENGTH, GRAM = 200, 80
#: A tree is built over at most so many distinct contexts; a larger group is split into smaller trees, by so many bytes of
#: the left end of a repeat at a time.
LARGEST, STEPS = 1000, (8, 1)
#: Bytes that a worker hashes at once, and bytes of texts that it unpacks at once.
PIECE, UNPACKED = 1 << 19, 8 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"][:n], _tables["down"][:n]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], for each i with as many."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _chosen(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes that some window of length bytes chooses, for texts that end at ends.

    A window chooses the grams within it whose hash is the least. That depends on the window's bytes alone, so equal
    windows choose the same of their places, wherever they are.
    """
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    order = ((h * _MIX) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    width = length - gram + 1
    least = _sliding(order, width, np.minimum)  # of the window that starts at each place
    for end in ends.tolist():
        least[max(0, end - length + 1) : end] = 0  # no window starts there
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)]), width, np.maximum)
    at = np.flatnonzero(most == order)
    return at, h[at] * _MIX ^ h[at] >> np.uint64(29)


def places(texts: pa.Array, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of texts, place, hash of the gram there, hash of the context around it), a few texts at a time.

    The context of a place has all windows that contain its gram: length - gram bytes before and length bytes from there
    on, less at a text's ends. A text longer than PIECE is worked through in pieces that overlap.
    """
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    view = memoryview(data)
    hashed = xxhash.xxh3_64_intdigest

    def rows(lo: int, hi: int, at: np.ndarray, kh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row = np.searchsorted(offsets[lo : hi + 1], at, side="right") - 1 + lo
        begin, end = np.maximum(at - (length - gram), offsets[row]), np.minimum(at + length, offsets[row + 1])
        ch = np.fromiter((hashed(view[b:e], p - b) for b, e, p in zip(begin.tolist(), end.tolist(), at.tolist())), np.uint64, len(at))
        return row, at - offsets[row], kh, ch

    i = 0
    while i < len(texts):
        j = i + 1
        if offsets[j] - offsets[i] <= PIECE:
            while j < len(texts) and offsets[j + 1] - offsets[i] <= PIECE:
                j += 1
            at, kh = _chosen(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], length, gram)
            yield rows(i, j, at + offsets[i], kh)
        else:
            last = np.empty(0, np.int64)
            for start in range(int(offsets[i]), int(offsets[j]), PIECE):
                stop = min(int(offsets[j]), start + PIECE + length - 1)
                at, kh = _chosen(data[start:stop], np.array([stop - start]), length, gram)
                new = ~np.isin(at + start, last)
                yield rows(i, j, at[new] + start, kh[new])
                last = at + start
        i = j


def common(a: bytes, b: bytes) -> int:
    """How many first bytes two strings share."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(shared: list[int], n: int, least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of n sorted strings, by a stack scan: (length shared, first, last) for each node of least bytes or more.

    shared[i] is what string i shares with string i - 1 (shared[0] is not looked at).
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        value, first = shared[i] if i < n else -1, i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def repeat_groups(contexts: list[tuple[bytes, bytes]], length: int = LENGTH, gram: int = GRAM, counts: list[int] | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of length bytes or more that contain the place of every context: (bytes before it, bytes from it, occurrences).

    contexts: distinct pairs of the bytes before the place, reversed, and those from it; counts: how often each occurs.
    Suffixes from the place are sorted, and their tree is scanned. The occurrences of a node are tested for how far they
    extend alike to the left, by the same tree over what stands before them: only a node whose occurrences differ in the
    byte before is left-diverse, and with it a repeat that can't be longer. A pair of nodes is given with all of its occurrences;
    those that share more to the right come up at a deeper node instead. A context that occurs more than once is a leaf
    that repeats as a whole.
    """
    n = len(contexts)
    for i, times in enumerate(counts or ()):
        if times > 1 and sum(map(len, contexts[i])) >= length:
            yield len(contexts[i][0]), len(contexts[i][1]), [i]
    if n == 2:  # a tree of one inner node
        a, b = common(contexts[0][0], contexts[1][0]), common(contexts[0][1], contexts[1][1])
        if a + b >= length and b >= gram:
            yield a, b, [0, 1]
        return
    by_right = sorted(range(n), key=lambda i: contexts[i][1])
    right = [contexts[i][1] for i in by_right]
    shared = [0] + [common(right[i - 1], right[i]) for i in range(1, n)]
    left_rank = [0] * n
    by_left = sorted(range(n), key=lambda i: contexts[by_right[i]][0])
    for r, i in enumerate(by_left):
        left_rank[i] = r
    for b, first, last in intervals(shared, n, gram):
        members = sorted(range(first, last + 1), key=left_rank.__getitem__) if last - first + 1 < n else by_left
        left = [contexts[by_right[i]][0] for i in members]
        both = [0] + [common(left[i - 1], left[i]) for i in range(1, len(left))]
        for a, p, q in intervals(both, len(left), max(0, length - b)):
            own = sorted(members[p : q + 1])
            if min(shared[own[0] + 1 : own[-1] + 1]) == b:  # right-diverse: not all within a deeper node
                yield a, b, [by_right[i] for i in own]


def reaches(contexts: list[tuple[bytes, bytes]], counts: list[int], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int]]:
    """How far the repeats around the place of each context reach: (bytes before it, bytes from it), zeros for none.

    Every repeat here contains the place, so that the union of those of one context is one span.
    """
    before, after = [0] * len(contexts), [0] * len(contexts)
    for a, b, members in repeat_groups(contexts, length, gram, counts):
        for i in members:
            if a > before[i]:
                before[i] = a
            if b > after[i]:
                after[i] = b
    return list(zip(before, after))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as a sorted list without overlaps; those that touch are joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _text_key() -> Column:
    """128 bits for a text; null is the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """docs (text) to (tid, th, n, z): each distinct text once, compressed, with a number, its key and how many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = [pack(t.as_buffer()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["th", "z"])

    packed = docs.select(_text_key().alias("th"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "th binary, z binary")
    once = packed.groupBy("th").agg(F.count("*").alias("n"), F.first("z").alias("z"))
    return staged(once.withColumn("tid", F.monotonically_increasing_id()), "texts")


def _unpacked(batch: pa.RecordBatch, z: str) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, so many at a time that they stay small: (number of the first, texts)."""
    unpack = zstandard.ZstdDecompressor().decompress
    first, size, texts = 0, 0, []
    for i, x in enumerate(batch.column(z)):
        texts.append(unpack(x.as_py()))
        size += len(texts[-1])
        if size > UNPACKED:
            yield first, texts
            first, size, texts = i + 1, 0, []
    if texts:
        yield first, texts


def _places(texts: DataFrame, length: int, gram: int, located: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in _unpacked(b, "z"):
                for row, at, kh, ch in places(pa.array(some, pa.binary()), length, gram):
                    row = pa.array(row + first)
                    cols = [pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64)), b.column("n").take(row)]
                    names = ["kh", "ch", "n"]
                    if located:
                        cols += [b.column("tid").take(row), pa.array(at, pa.int64())]
                        names += ["tid", "at"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return texts.select("tid", "n", "z").mapInArrow(run, "kh long, ch long, n long" + ", tid long, at long" * located)


def _with_contexts(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """wanted (kh, ch, n, tid, at) to (g = kh, c = ch, n, l, r): the bytes before the place, reversed, and those from it."""
    by_text = wanted.groupBy("tid").agg(F.collect_list(F.struct("kh", "ch", "n", "at")).alias("w"))
    both = by_text.join(texts.select("tid", "z"), "tid").select("z", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, w in zip(batch.column(0), batch.column(1)):
                text = unpack(z.as_py())
                kh, ch, n, at = (w.values.field(i) for i in range(4))
                left, right = [], []
                for p in at.to_pylist():
                    left.append(text[max(0, p - (length - gram)) : p][::-1])
                    right.append(text[p : p + length])
                yield pa.RecordBatch.from_arrays([kh, ch, n, pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["g", "c", "n", "l", "r"])

    return both.mapInArrow(run, "g long, c long, n long, l binary, r binary")


def _trees(contexts: DataFrame, length: int, gram: int, groups: bool = False) -> DataFrame:
    """contexts (g, c, n, l, r), each (g, c) once, to (g, c, lo, hi): how far what repeats within a group g reaches around the place.

    With groups: a row per maximal repeat and occurrence instead, and node, which numbers the repeats of a group; only
    repeats of which a window chooses the place, as all of their occurrences have it.
    Groups come one after another in a sorted stream, so that many small ones share a batch, and one at a time is held.
    """

    def found(group: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, ...]]:
        pairs, counts = [(left, right) for _, _, left, right in group], [n for _, n, _, _ in group]
        if groups:
            for node, (a, b, members) in enumerate(repeat_groups(pairs, length, gram, counts)):
                whole = np.frombuffer(pairs[members[0]][0][:a][::-1] + pairs[members[0]][1][:b], np.uint8)
                if a in _chosen(whole, np.array([len(whole)]), length, gram)[0]:
                    yield from ((group[i][0], -a, b, node) for i in members)
        else:
            for (c, *_), (a, b) in zip(group, reaches(pairs, counts, length, gram)):
                if b:
                    yield c, -a, b

    names = ["g", "c", "lo", "hi"] + ["node"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, rows = None, [], []

        def close() -> None:
            rows.extend((key, *x) for x in found(group))
            group.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            for g, *x in zip(*(c.to_pylist() for c in b.columns)):
                if g != key:
                    close()
                    key = g
                    if len(rows) > 10_000:
                        yield out()
                group.append(x)
        close()
        yield out()

    return contexts.select("g", "c", "n", "l", "r").repartition("g").sortWithinPartitions("g").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _split(contexts: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """Large groups' contexts (g, c, n, l, r) to (g, c, n, most, g2, c2): the smaller groups that each goes to, and what it is there.

    Two contexts share a repeat if they share a bytes to the left and b to the right of the place, a + b >= length. Left
    ends are dealt into ranges of step bytes, least to most: then a repeat whose left end is in a range shares a prefix of
    least bytes to the left and length - most to the right, and these two prefixes are its group. There, contexts are cut
    to most bytes to the left and length - least to the right, beyond which other ranges see to it; those that are equal so
    are one. So each repeat is found in the groups of its windows' left ends, whatever the size of the group.
    """
    ranges = [(i, min(i + step - 1, length - gram)) for i in range(0, length - gram + 1, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(6)]
            for g, c, n, left, right in zip(*(x.to_pylist() for x in b.columns)):
                for least, most in ranges:
                    if len(left) < least or len(right) < length - most:
                        continue
                    own = b"%d %d " % (g, least)
                    key = hashed(own + left[:least] + right[: length - most])
                    kind = hashed(b"%d " % min(most, len(left)) + left[:most] + right[: length - least])
                    for x, y in zip(cols, (g, c, n, most, key - (1 << 63), kind - (1 << 63))):
                        x.append(y)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["g", "c", "n", "most", "g2", "c2"])
                    cols = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["g", "c", "n", "most", "g2", "c2"])

    return contexts.select("g", "c", "n", "l", "r").mapInArrow(run, "g long, c long, n long, most long, g2 long, c2 long")


def _reaches(contexts: DataFrame, length: int, gram: int, largest: int, steps: tuple[int, ...] = STEPS, large: DataFrame | None = None) -> DataFrame:
    """contexts (g, c, n, l, r) to (g, c, lo, hi), by trees over groups of at most largest; larger ones are split as often as steps says.

    The last split is by single bytes, where all that is left of a group is one kind, so every tree is bounded. large: the
    large groups, if they are known.
    """
    if large is None:
        contexts = staged(contexts, "contexts")
        large = staged(contexts.groupBy("g").count().filter(F.col("count") > largest).select("g"), "large", small=True)
    if not steps or large.isEmpty():
        return _trees(contexts, length, gram)
    big = large.withColumnRenamed("g", "_g")
    contexts = staged(contexts, "contexts")
    rows = staged(_split(dimension_join(contexts, big, F.col("g") == F.col("_g"), "left_semi"), length, gram, steps[0]), "split")
    kinds = rows.groupBy("g2", "c2").agg(F.sum("n").alias("n"), F.first(F.struct("g", "c", "most")).alias("of"))
    some = rows.groupBy("g2").agg(F.sum("n").alias("all")).filter("all > 1").select(F.col("g2").alias("_g2"))
    kinds = staged(kinds.join(some, F.col("g2") == F.col("_g2"), "left_semi").select("g2", "c2", "n", "of.*"), "kinds")
    cut = kinds.join(contexts.select("g", "c", "l", "r"), ["g", "c"]).withColumn("least", F.col("most") - F.col("most") % steps[0])
    cut = cut.select(F.col("g2").alias("g"), F.col("c2").alias("c"), "n", F.expr("substring(l, 1, int(most))").alias("l"), F.expr(f"substring(r, 1, int({length} - least))").alias("r"))
    part = _reaches(cut, length, gram, largest, steps[1:]).withColumnsRenamed({"g": "g2", "c": "c2"})
    back = rows.join(part, ["g2", "c2"]).groupBy("g", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _trees(dimension_join(contexts, big, F.col("g") == F.col("_g"), "left_anti"), length, gram).unionByName(back)


class Repeats:
    """The places of texts (tid, th, n, z) that can hold a repeat, and the contexts among which trees look for them.

    Every window of length bytes chooses places, equal windows the same ones. So windows are equal only where their
    places have the same gram, and only places with a gram found twice are looked at further.
    1. Places are counted by gram and context, combined before the shuffle: places alike are one row, however many there are.
    2. A gram with one context only, found twice, is a tree of one leaf, which repeats as a whole.
    3. Contexts that share a gram and differ are fetched, one of each kind, and their interval tree gives the maximal
       repeats between them.
    """

    def __init__(self, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> None:
        self.texts, self.length, self.gram, self.largest = texts, length, gram, largest
        kinds = _places(texts, length, gram, False).groupBy("kh", "ch").agg(F.sum("n").alias("n"))
        grams = kinds.groupBy("kh").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter("all > 1")
        grams = staged(grams.select("kh", "kinds"), "grams")
        self.at = staged(_places(texts, length, gram, True).join(grams, "kh"), "places")
        # any place of a kind will do for its context; the firsts are of one row
        kinds = self.at.groupBy("kh", "ch").agg(F.sum("n").alias("n"), F.first(F.struct("tid", "at", "kinds")).alias("one"))
        self.kinds = staged(kinds.select("kh", "ch", "n", "one.*"), "kinds")
        self.contexts = _with_contexts(texts, self.kinds.filter("kinds > 1"), length, gram)
        self.large = staged(grams.filter(F.col("kinds") > largest).select(F.col("kh").alias("g")), "large", small=True)
        self.leaves = self.kinds.filter("kinds = 1").select("kh", "ch", F.lit(gram - length).cast("long").alias("lo"), F.lit(length).cast("long").alias("hi"))

    def spans(self) -> DataFrame:
        """(tid, spans): for each text with repeats, spans of bytes (lo, hi), one a place; they overlap, and a leaf's may go beyond the text."""
        part = _reaches(self.contexts, self.length, self.gram, self.largest, large=self.large)
        part = part.withColumnsRenamed({"g": "kh", "c": "ch"}).unionByName(self.leaves)
        found = self.at.select("kh", "ch", "tid", "at").join(part, ["kh", "ch"])
        return found.groupBy("tid").agg(F.collect_list(F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))).alias("spans"))

    def groups(self) -> DataFrame:
        """(gram, node, tid, lo, hi): every occurrence of every maximal repeat around a place, as far as its context goes.

        A repeat is told by gram and node. All groups are scanned whole here, large ones too: it is their output that is asked for.
        """
        found = _trees(self.contexts, self.length, self.gram, groups=True).withColumnsRenamed({"g": "kh", "c": "ch"})
        found = found.unionByName(self.leaves.withColumn("node", F.lit(0).cast("long")))
        found = self.at.select("kh", "ch", "tid", "at").join(found, ["kh", "ch"])
        return found.select(F.col("kh").alias("gram"), "node", "tid", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))


def _cut(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and what is left."""
    clipped = ((max(0, lo), min(len(text), hi)) for lo, hi in spans)
    runs = merged((lo, hi) for lo, hi in clipped if hi - lo >= length)
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return runs, b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST, keep_text: bool = False, carry: Iterable[str] = ()) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per row; with keep_text also
    the text that is left (bytes of a character that was cut in two are dropped) and the spans removed. The columns
    named in carry come along.

    A byte goes if any string of length bytes over it starts anywhere else too, in this text or another; what repeats is
    judged on the input. A null text is empty. Rows of equal texts, whatever their doc_id, remove each other; each distinct
    text is worked on once. Texts shorter than length stay whole. An empty table gives an empty result.
    """
    texts = distinct_texts(docs)
    both = texts.select("tid", "th", "z").join(Repeats(texts, length, gram, largest).spans(), "tid", "left").select("th", "z", "spans")
    extra = ", text string, spans array<struct<lo: long, hi: long>>" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            out: list[list] = [[] for _ in range(6)]
            for z, spans in zip(batch.column(1), batch.column(2)):
                text = unpack(z.as_py())
                got = []
                if spans.is_valid and len(spans.values):
                    got = list(zip(*(spans.values.field(i).to_pylist() for i in (0, 1))))
                runs, kept = _cut(text, got, length)
                new = (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None, [{"lo": a, "hi": b} for a, b in runs])
                for x, y in zip(out, new):
                    x.append(y)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            names = ["th", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(out[4], pa.string()), pa.array(out[5], kind)], [*names, "text", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    cut = both.mapInArrow(run, "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("th"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    return rows.join(cut, "th").drop("th").withColumnsRenamed({f"carried_{c}": c for c in carry})


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
