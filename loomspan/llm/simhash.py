"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import LOWER, UPPER, components, dimension_join, spread, staged, table

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Distinct fingerprints in a tile, about; comparisons that a worker makes at once; links that it holds before it thins them.
TILE, AT_ONCE, HELD = 32_768, 1 << 18, 400_000
#: Near copies: words in a shingle, least share of common shingles, and the bits in which fingerprints of such texts
#: may differ, of the first 64 and of all 128. At that share one expects 9.7 and 19.4, with deviations of 2.9 and 4.1; of 2,355
#: pairs of texts with it (measured), none differs in more than 17 of the first.
COPY_SHINGLE, COPY_LEAST, COPY_RADIUS, COPY_RADIUS_128 = 5, 0.8, 17, 30
#: Texts of candidates in a tile, and their bytes, compressed: a worker holds the shingles of two tiles.
COPY_TILE, COPY_BYTES = 1024, 4 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash."""
    h = hashes.astype(np.uint64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def lower_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(w: list[bytes], size: int) -> np.ndarray:
    """The XXH64 of each run of size words, repeats included; of all words if there are fewer."""
    if not w:
        return np.empty(0, ">u8")
    runs = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64 majority bits of the XXH64 of a text's shingles; 0 without words."""
    return _majority(shingles(lower_words(text), size))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    h = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for a very long text
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp long, the 64 bits as a signed number). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py() or "", size) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _lanes(x: np.ndarray, lanes: int) -> np.ndarray:
    """Population counts of the lanes of 64 / lanes bits."""
    width = 64 // lanes
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count(x >> np.uint64(width * i) & mask) for i in range(lanes)], 1).astype(np.int16)


def _pairs(a: np.ndarray, b: np.ndarray, radius: int, lanes: int = 4, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) where a[i] and b[j] differ in radius bits at most: every pair, unless population counts rule it out.

    A large tile is cut into smaller ones of equal population counts in 4, then 8 lanes; two of these are skipped if the
    counts differ by more than the radius in all, as each bit that differs moves one lane's count by one. Beyond a bit a lane, few would be.
    """
    if len(a) * len(b) > 64 * AT_ONCE and lanes <= 8 and radius <= lanes:
        ka, kb = _lanes(a, lanes), _lanes(b, lanes)
        ua, ia = np.unique(ka, axis=0, return_inverse=True)
        ub, ib = np.unique(kb, axis=0, return_inverse=True)
        oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
        ea, eb = np.searchsorted(ia[oa], np.arange(len(ua) + 1)), np.searchsorted(ib[ob], np.arange(len(ub) + 1))
        for p in range(len(ua)):
            pa_ = oa[ea[p] : ea[p + 1]]
            near = np.flatnonzero(np.abs(ub - ua[p]).sum(1) <= radius)
            if not len(near):
                continue
            pb = np.concatenate([ob[eb[q] : eb[q + 1]] for q in near])
            for i, j in _pairs(a[pa_], b[pb], radius, lanes * 2):
                yield pa_[i], pb[j]
        return
    step = max(1, at_once // max(1, len(b)))
    for i in range(0, len(a), step):
        x = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        if x.any():
            u, v = np.nonzero(x)
            yield u + i, v


class Forest:
    """Links thinned to a spanning forest, so that what is held and sent grows with the nodes, not with the pairs."""

    def __init__(self, held: int = HELD) -> None:
        self.u, self.v, self.n, self.held = [], [], 0, held

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        keep = u != v
        self.u.append(u[keep])
        self.v.append(v[keep])
        self.n += int(keep.sum())
        if self.n > self.held:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from each node to the smallest one of its component among the links so far."""
        if not self.u:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        u, v = np.concatenate(self.u), np.concatenate(self.v)
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != (r := root[root])).any():
                root = r
        far = root != np.arange(len(nodes))
        u, v = nodes[far], nodes[root[far]]
        self.u, self.v, self.n = [u], [v], len(u)
        return u, v


Steps = list[tuple[int, int]]


def _tiles(nodes: DataFrame, kind: tuple[Column, Column], tile: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes as tiles (h, l, k, an array for each column of carry), and how many tiles each kind (h, l) has.

    Each kind is dealt by hash to as many tiles as its count asks for. There are few kinds, whatever the input.
    """
    h, l = kind  # noqa: E741
    kinds = staged(nodes.groupBy(h.alias("h"), l.alias("l")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "kinds", small=True)
    dealt = nodes.withColumns({"h": h, "l": l}).join(F.broadcast(kinds), ["h", "l"])
    k = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("k")
    return staged(dealt.groupBy("h", "l", k).agg(*[F.collect_list(c).alias(c) for c in carry]), "tiles"), kinds


def _meet(tiles: DataFrame, kinds: DataFrame, steps: Steps, carry: list[str]) -> DataFrame:
    """Pairs of tiles (a_ and b_ before each column of carry) whose kinds are a step apart, one of each two.

    Only the counts of the kinds are broadcast, a table of a fixed size. So the filter skips tile pairs before they are
    shuffled, and each pair of rows meets once.
    """
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    left = tiles.select("h", "l", "k", *[F.col(c).alias(f"a_{c}") for c in carry], near.alias("s"))
    k2 = kinds.select(F.col("h").alias("h2"), F.col("l").alias("l2"), "tiles")
    left = left.join(F.broadcast(k2), (F.col("h2") == F.col("h") + F.col("s.x")) & (F.col("l2") == F.col("l") + F.col("s.y")))
    left = left.withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("h2 <> h or l2 <> l or k2 >= k")
    right = tiles.select(F.col("h").alias("h3"), F.col("l").alias("l3"), F.col("k").alias("k3"), *[F.col(c).alias(f"b_{c}") for c in carry])
    both = left.join(right.hint("shuffle_hash"), (F.col("h2") == F.col("h3")) & (F.col("l2") == F.col("l3")) & (F.col("k2") == F.col("k3")))
    names = [f"{side}_{c}" for side in "ab" for c in carry]
    return both.select(*names).repartition(spread(tiles.sparkSession))


def _row(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
    return [c[row].values.to_numpy(zero_copy_only=False) for c in batch.columns]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """nodes (node long, fp long, each fp once) to (u, v): links that connect just what the links within radius connect.

    Tiles are made of fingerprints with equal population counts in both halves, 33 x 33 kinds at most. A tile
    is sent to the tiles whose population counts differ by radius at most in all, one of each two, and compared there
    by exclusive-or and bit counts; a task gives back a spanning forest of the pairs.
    """
    hi = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    lo = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    carry = ["fp", "node"]
    both = _meet(*_tiles(nodes, (hi, lo), tile, carry), steps, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for batch in batches:
            for row in range(len(batch)):
                fa, ia, fb, ib = _row(batch, row)
                for i, j in _pairs(fa.view(np.uint64), fb.view(np.uint64), radius):
                    found.add(ia[i], ib[j])
        u, v = found.thin()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _members(roots: DataFrame) -> DataFrame:
    """(node, root) of components, with the roots themselves."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), a row per row.

    Texts with equal fingerprints are one node, counted before the shuffle, so copies are never paired. Null and empty
    texts have fingerprint zero and are linked like any other. A null doc_id counts as larger than any other; a component
    of such rows only has a null component_id. An empty table gives an empty result; further columns are left out.
    """
    fps = staged(fingerprints(docs, size), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = staged(nodes.join(_members(components(links(nodes, radius))), "node").select("fp", "first", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    theirs = linked.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    # every other fingerprint is a component of its own
    theirs = theirs.unionByName(nodes.join(linked.select("fp"), "fp", "left_anti").select(F.col("fp").alias("_fp"), F.col("first").alias("component_id")))
    out = fps.join(theirs, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_words_key(docs: DataFrame) -> DataFrame:
    """docs with _key: 128 bits, equal for texts of equal words; null and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [xxhash.xxh3_128_digest(b" ".join(lower_words(t.as_py() or ""))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "_key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_key", BinaryType())]))


def _copy_texts(docs: DataFrame, size: int) -> DataFrame:
    """docs (text) to (node, key, fp, fp2, n, z): each text of equal words once; n is how many shingles it has, z its words, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            key, fp, fp2, n, z = [], [], [], [], []
            for t in b.column(0):
                w = lower_words(t.as_py() or "")
                h, whole = shingles(w, size), b" ".join(w)
                key.append(xxhash.xxh3_128_digest(whole))
                fp.append(_majority(h))
                fp2.append(_majority(_second(h)))
                n.append(len(np.unique(h)))
                z.append(pack(whole))
            bits = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, fp2)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *bits, pa.array(n, pa.int32()), pa.array(z, pa.binary())], ["key", "fp", "fp2", "n", "z"])

    once = docs.select("text").mapInArrow(run, "key binary, fp long, fp2 long, n int, z binary").groupBy("key").agg(F.first(F.struct("fp", "fp2", "n", "z")).alias("x"))
    return staged(once.select("key", "x.*").withColumn("node", F.monotonically_increasing_id()), "texts")


def _candidates(nodes: DataFrame, radius: int, radius_128: int, least: float, tile: int) -> DataFrame:
    """nodes (node, fp, fp2, n) to (u, v): links that connect just what is linked by pairs within both radii, of sizes that allow the similarity.

    Tiles are kinds of size (a step apart: sizes that allow the similarity) by bands of population counts; tile pairs
    whose counts differ by more than radius are skipped. A task gives back a spanning forest.
    """
    band = max(1, radius // 3)
    reach = (radius + band - 1) // band  # counts of bands further apart differ by more than radius
    kind = (F.floor(F.log("n") / -math.log(least) + 1e-9).cast("int"), F.floor(F.bit_count("fp") / band).cast("int"))
    steps = [(0, y) for y in range(reach + 1)] + [(1, y) for y in range(-reach, reach + 1)]
    carry = ["fp", "fp2", "node", "n"]
    both = _meet(*_tiles(nodes, kind, tile, carry), steps, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest(HELD // 4)  # in a wide radius whole tiles may be alike
        for batch in batches:
            for row in range(len(batch)):
                fa, ga, ia, na, fb, gb, ib, nb = _row(batch, row)
                for i, j in _pairs(fa.view(np.uint64), fb.view(np.uint64), radius, at_once=AT_ONCE // 4):
                    near = _allowed(fa[i], ga[i], na[i], fb[j], gb[j], nb[j], radius_128, least)
                    found.add(ia[i][near], ib[j][near])
        u, v = found.thin()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _allowed(fa, ga, na, fb, gb, nb, radius_128: int, least: float) -> np.ndarray:
    d = np.bitwise_count((fa ^ fb).view(np.uint64)).astype(np.int16) + np.bitwise_count((ga ^ gb).view(np.uint64))
    return (d <= radius_128) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)


def joined(sets: list[np.ndarray], fp: np.ndarray, fp2: np.ndarray, sides: tuple[np.ndarray, np.ndarray], radius: int, radius_128: int, least: float) -> np.ndarray:
    """For each text (its shingles, ascending, and fingerprints) the first one of its group: groups are joined by pairs of similar texts, one of each side.

    Every pair within the radii is compared, but for those already in one group. What a text shares with all of its
    partners is counted at once.
    """
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, ends[:-1])
    group, mark = np.arange(len(sets)), np.zeros(int(ends[-1]), bool)
    left, right = sides
    for i in left.tolist():
        j = right[group[right] != group[i]]
        j = j[np.bitwise_count((fp[j] ^ fp[i]).view(np.uint64)) <= radius]
        j = j[_allowed(fp[j], fp2[j], n[j], fp[i], fp2[i], n[i], radius_128, least)]
        if not len(j):
            continue
        mark[ids[i]] = True
        both = np.add.reduceat(mark[np.concatenate([ids[k] for k in j.tolist()])].astype(np.int64), np.cumsum(n[j]) - n[j])
        mark[ids[i]] = False
        alike = group[j[both >= least * (n[j] + n[i] - both) - 1e-9]]
        if len(alike):
            alike = np.unique(np.append(alike, group[i]))
            group[np.isin(group, alike)] = alike[0]
    return group


def _verified(members: DataFrame, radius: int, radius_128: int, least: float, size: int, tile: int) -> DataFrame:
    """members (cluster, node, fp, fp2, z) to (u, v): links that connect just what similar texts of a cluster connect.

    Only texts of one cluster of candidates can be linked. A cluster of more than tile texts, or of more than COPY_BYTES, is dealt to tiles, each pair
    of which is a task's worth; so no task holds more than two tiles of texts, and what comes back grows with the texts, not with their pairs.
    """
    tiles = F.ceil(F.greatest(F.count("*") / tile, F.least(F.sum(F.octet_length("z")) / COPY_BYTES, F.count("*"))))
    large = members.groupBy(F.col("cluster").alias("_c")).agg(tiles.cast("int").alias("tiles")).filter("tiles > 1")
    dealt = dimension_join(members, staged(large, "large", small=True), F.col("cluster") == F.col("_c")).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("cluster", F.least("k", "x").alias("ka"), F.greatest("k", "x").alias("kb"), "k", "node", "fp", "fp2", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        key, group = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                k, node, fp, fp2, z = zip(*group)
                nodes, k = np.array(node), np.array(k)
                sets = [np.unique(shingles(unpack(x).split(), size)) for x in z]
                first = joined(sets, np.array(fp), np.array(fp2), tuple(np.flatnonzero(k == side) for side in key[1:]), radius, radius_128, least)
                far = first != np.arange(len(first))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[first[far]])], ["u", "v"])
            group.clear()

        for b in (x.slice(i, 512) for x in batches for i in range(0, len(x), 512)):
            for *of, k, node, fp, fp2, z in zip(*(c.to_pylist() for c in b.columns)):
                if of != key:
                    yield from links()
                    key = of
                group.append((k, node, fp, fp2, z))
        yield from links()

    keys = ["cluster", "ka", "kb"]
    return dealt.repartition(spread(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, radius: int = COPY_RADIUS, radius_128: int = COPY_RADIUS_128, size: int = COPY_SHINGLE, least: float = COPY_LEAST, tile: int = TILE, verify: int = COPY_TILE) -> DataFrame:
    """docs (text) to (key, root): for texts that are linked to others, the key of with_words_key and a number of their group.

    Texts of equal words are one node. Two are linked if they share least of their shingles of size words (Jaccard, exact)
    and their fingerprints differ in radius bits at most, radius_128 with the second ones. Tiles of fingerprints give
    clusters of candidates, within which texts are compared. Null and empty texts have no shingles and are one key. An empty
    table gives an empty result.
    """
    texts = _copy_texts(docs, size)
    nodes = texts.filter("n > 0").select("node", "fp", "fp2", "n")
    clusters = _members(components(_candidates(nodes, radius, radius_128, least, tile))).select(F.col("node").alias("_node"), F.col("root").alias("cluster"))
    members = dimension_join(texts, staged(clusters, "clusters"), F.col("node") == F.col("_node"), "inner").select("cluster", "node", "fp", "fp2", "z")
    roots = components(_verified(members, radius, radius_128, least, size, verify))
    return texts.select("key", "node").join(_members(roots), "node").select("key", "root")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
