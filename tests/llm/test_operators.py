"""Each operator against a brute-force version, on odd rows: nulls, empty and long texts, repeated rows, clashing columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import bpe, licenses, mixing, quality_crf, quality_rules, repeats, simhash, spotsigs, url_filter, warc
from loomspan.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "a", "Haus", "été", "ñandú", "x", "***", "|", "ß", "Ünder", "tion", "er"]
    vocab += ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(80)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    out = []
    for i in range(n):
        t = "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8)))
        if i % 6 == 0:
            t += " " + passage + (" tail" if i % 12 else "")
        if i % 10 == 3:
            t = out[-1]
        if i % 10 == 4:
            t = out[-1] + " é"
        out.append(t)
    line = "one line that is said again and again"
    return [*out, None, "", " \t\n", "x", "a b", "\n".join([line] * 9), "ab" * 400, "é" * 250, passage * 3, "Σίσυφος ΟΔΟΣ <|endoftext|> don't I'LL 12३", "z" * 30_000]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i * 3, t, [None, "en", "fr"][i % 3], [None, "b", "a", "ç"][min(i % 7, 3)], None if t is None else len(t)) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


def known(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def words(t):
    return WORD.findall(t or "")


# 2


def plain_fingerprint(t):
    w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rows = texts()
    got = known(simhash.near_duplicates(frame(spark).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))))
    f = [plain_fingerprint(t) for t in rows]
    r = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    assert {k: (v["fingerprint"], v["component_id"]) for k, v in got.items()} == {3 * i: (f"{x:016x}", 3 * r[i]) for i, x in enumerate(f)}


def test_simhash_tiles(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(8)} | {0, (1 << 64) - 1})
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for tile in (5, 1 << 15):
        got = {x["node"]: x["root"] for x in components(simhash.links(nodes, tile=tile)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_large_tiles():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 6000, dtype=np.uint64)
    b = np.concatenate([a[:500] ^ np.uint64(0b101), r.integers(0, 1 << 63, 5500, dtype=np.uint64)])
    got = {(int(i), int(j)) for u, v in simhash._pairs(a, b, 3) for i, j in zip(u, v)}
    want = set()
    for i in range(0, len(a), 500):
        u, v = np.nonzero(np.bitwise_count(a[i : i + 500, None] ^ b) <= 3)
        want |= {(int(x) + i, int(y)) for x, y in zip(u, v)}
    assert len(a) * len(b) > 64 * simhash.AT_ONCE and got == want


def test_components_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (5, 5)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**{i: 0 for i in range(1, n + 1)}, 201: 200}


def test_release(spark):
    import os

    from loomspan.llm.common import release, shared_dir, staged

    df = staged(spark.range(3), "some")
    assert df.count() == 3
    folder = shared_dir(spark).removeprefix("file:") + "/loomspan"
    assert any(f.startswith("some-") for f in os.listdir(folder))
    release(spark)
    assert not any(f.startswith("some-") for f in os.listdir(folder))


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


# 3


def plain_measures(t):
    t = t or ""
    w = words(t)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_quality_measures(spark):
    rows = texts()
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = known(quality_rules.quality_rules(frame(spark).withColumn("stratum", F.lit("clash")), labels))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {k: tuple(v[c] for c in cols) for k, v in got.items()} == {3 * i: plain_measures(t) for i, t in enumerate(rows)}
    assert all(v["kept"] == (not v["base_failed"]) for v in got.values())  # too few labels for any cutoff


def test_risk_controlled_cutoffs(spark):
    data = [(i, "en" if i % 2 else None, 100, 500, 40 if i % 200 == 1 else i % 3, 0, 0, False) for i in range(8000)]
    m = spark.createDataFrame(data, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(8000)], "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r.asDict() for r in quality_rules.cutoffs(m, labels).collect()}
    tests = 2 * sum(map(len, quality_rules.GRID.values()))
    rate = 0.04 / len(quality_rules.RULES)
    for s in ("en", None):
        rows = [d for d in data if d[1] == s]
        want = None
        for c in quality_rules.GRID["symbols"]:
            k = sum(d[4] * 1000 // d[3] > c for d in rows)
            tail = sum(math.exp(math.lgamma(len(rows) + 1) - math.lgamma(i + 1) - math.lgamma(len(rows) - i + 1) + i * math.log(rate) + (len(rows) - i) * math.log(1 - rate)) for i in range(k + 1))
            if tail <= 0.05 / tests:
                want = c
                break
        assert got.get((s, "symbols"), {}).get("cutoff") == want
    assert got[(None, "symbols")]["k"] < got[(None, "symbols")]["n"]


def test_quality_rules_empty(spark):
    assert quality_rules.quality_rules(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


# 6


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(3)
    rows = texts() + ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(80)) for _ in range(60)]
    rows += ["q" * 700 + "the" * 300, "a\x1cb\x85c​d", "ΑΣ İ ǅ ﬁ ½"]
    got = known(bpe.bpe(frame(spark, rows).withColumn("ids", F.lit(0)), keep_ids=True))
    for i, t in enumerate(rows):
        e = lib.encode(t or "", add_special_tokens=False)
        g = got[3 * i]
        assert g["ids"] == e.ids and g["n_tokens"] == len(e.ids), repr(t)
        assert g["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("op", ["simhash", "quality_crf", "bpe", "spotsigs", "mixing", "quality_rules"])
def test_null_everywhere(spark, op):
    """A row of nulls, one of them with a text, and large ids."""
    rows = [(None, None, None, None, None), (None, "a b c " * 60, None, None, 1), (2**60 + 1, "d e f " * 60, "en", "s", 5), (2**60 + 1, "d e f " * 60, "en", "s", 5), (-5, "", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(2**60 + 1, 1), (None, 0), (-5, None)], "doc_id long, quality int")
    run = {"simhash": lambda: simhash.near_duplicates(df), "quality_crf": lambda: quality_crf.classify(df, labels), "bpe": lambda: bpe.bpe(df), "spotsigs": lambda: spotsigs.fingerprints(df), "mixing": lambda: mixing.mix(df), "quality_rules": lambda: quality_rules.quality_rules(df, labels)}
    assert sorted(str(r["doc_id"]) for r in run[op]().collect()) == sorted(str(r[0]) for r in rows)


def test_bpe_heap_is_scan():
    tool, r = bpe.Bpe(bpe.vocabulary()), random.Random(1)
    for _ in range(300):
        raw = bytes(r.choice(b"etaoinshr") for _ in range(r.randint(2, 120)))
        ids = [tool.inner[b] for b in raw[:-1]] + [tool.last[raw[-1]]]
        assert tool._scan(list(ids)) == tool._heap(list(ids))


# 8


def test_spotsigs(spark, monkeypatch):
    rows = texts()
    t = [x or "" for x in rows]
    w = [words(x.lower()) for x in t]
    counts = Counter(x for ws in w for x in ws)
    common = {x for x, n in counts.items() if n >= sum(counts.values()) / 200}
    df = frame(spark).withColumn("next", F.lit(1)).withColumn("sigs", F.lit(2))
    assert spotsigs.anchors(df, 1 / 200) == sorted(common)

    def sigs(x):
        ws, out = words(x.lower()), set()
        for i, a in enumerate(ws):
            c = [y for y in ws[i + 1 :] if y not in common][:2] if a in common else []
            if len(c) == 2:
                out.add((a, *c))
        return out or ({("all", *ws)} if ws else set())

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    own = [sigs(x) for x in t]
    root = roots(len(t), [(i, j) for i in range(len(t)) for j in range(i) if like(own[i], own[j]) >= 0.8])
    for chunk in (1, 9):
        monkeypatch.setattr(spotsigs, "spread", lambda _, n=chunk: n)
        got = known(spotsigs.fingerprints(df, 1 / 200))
        assert [got[3 * i]["component_id"] for i in range(len(t))] == [3 * r for r in root]
        for i, x in enumerate(t):
            y, h = t[(i + 1) % len(t)], len(x) // 2
            e = x[: len(x) - h] + y[:h]
            g = got[3 * i]
            assert (g["n_chars"], g["edited_sha256"]) == (len(x), hashlib.sha256(e.encode()).hexdigest())
            assert g["near_edited"] == pytest.approx(like(sigs(x), sigs(e))) and g["near_next"] == pytest.approx(like(sigs(x), sigs(y)))
        prints = {}
        for i, x in enumerate(t):
            assert prints.setdefault(x, got[3 * i]["fingerprint"]) == got[3 * i]["fingerprint"]


@pytest.mark.parametrize("tile", [3, 512])
def test_similar_sets(spark, tile):
    """Chains, cliques and many sets near the threshold, against all pairs."""
    r = random.Random(23)
    sets = []
    for g in range(12):
        base = [r.randrange(1 << 40) for _ in range(r.choice([1, 4, 10, 40, 90]))]
        for _ in range(14):
            out = [x for x in base if r.random() > 0.07] + [r.randrange(1 << 40) for _ in range(r.choice([0, 0, 1, 6]))]
            sets.append(sorted(set(out or base)))
            if g % 3 == 0:
                base = sets[-1]
    sets += [[5, 6], [5, 7], [8]]
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    want = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))])
    df = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(sets)], "sid long, n int, sigs array<long>")
    got = {x["node"]: x["root"] for x in spotsigs.similar_sets(df, tile=tile).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == want and len(set(want)) < len(sets) - 20


@pytest.mark.parametrize("ids", ["far", "null", "same"])
def test_next_is_dealt_evenly(spark, ids, monkeypatch):
    rows = [({"far": i if i else 1 << 60, "null": None, "same": 7}[ids], f"text {i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(spotsigs, "spread", lambda _: 4)
    got = spotsigs.with_next(df, {"one": F.lit(1)}).select("doc_id", "text", "next.text", F.spark_partition_id().alias("p")).collect()
    order = {r[1]: r[2] for r in got}
    at, seen = "text 0", set()
    while at not in seen:
        seen.add(at)
        at = order[at]
    assert len(seen) == len(order) == 1200  # one ring through all
    assert max(Counter(r["p"] for r in got).values()) < 400


def test_spotsigs_odd_tables(spark):
    assert spotsigs.fingerprints(frame(spark, [])).collect() == []
    rows = spotsigs.fingerprints(spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c"), (1 << 60, None)], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1152921504606846976", "7", "7", "None"]


# 9


def test_mixing(spark):
    df = frame(spark).withColumn("size", F.lit(1)).withColumn("copies", F.lit(9))
    got = known(mixing.mix(df))
    assert got == known(mixing.mix(df.repartition(7)))
    rows, total = texts(), 0
    src = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes = Counter()
    for i, t in enumerate(rows):
        sizes[src[3 * i]] += len(words(t))
    total = 1.5 * sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, left = set(), dict(weight)
    while True:
        share = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else share * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for i, t in enumerate(rows):
        g = got[3 * i]
        assert g["size"] == len(words(t)) and g["source_size"] == sizes[src[3 * i]]
        assert g["target"] == pytest.approx(target[src[3 * i]]) and g["taken"] == g["size"] * g["copies"] <= 2 * g["size"]
        taken[src[3 * i]] += g["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(20, 0.01 * target[s])


def hash64(*parts):
    """XXH64 over strings (UTF-8) and longs, each seeded by the one before, 42 first; signed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def plain_pivotal(rows, seed, fanout):
    """rows (size, id, x) of one source with equal x: decisions, by plain loops over the same tree."""

    def draw(seed, *names):
        return hash64(*names, seed) % (1 << 53) / (1 << 53)

    def leaf(rows, seed):
        x, rest, done = rows[0][2], sum(r[0] for r in rows), {}
        for k, (size, name, _) in enumerate(rows):
            rest -= size
            if k + 1 == len(rows):
                return (size, name, x), done
            up, down = min((1 - x) * size, x * rest), min(x * size, (1 - x) * rest)
            if draw(seed, name) * (up + down) < down:
                if (1 - x) * size <= x * rest:
                    x, done[name] = max(0.0, x - up / rest), 1
                else:
                    return (size, name, min(1.0, x + up / size)), done | {r[1]: 0 for r in rows[k + 1 :]}
            elif x * size <= (1 - x) * rest:
                x, done[name] = min(1.0, x + down / rest), 0
            else:
                return (size, name, max(0.0, x - down / size)), done | {r[1]: 1 for r in rows[k + 1 :]}

    def pairs(rows, seed):
        a, done = list(rows[0]), {}
        for b in map(list, rows[1:]):
            up, down = min((1 - a[2]) * a[0], b[2] * b[0]), min(a[2] * a[0], (1 - b[2]) * b[0])
            if draw(seed, a[1], b[1]) * (up + down) < down:
                whole, value, other, change = (a, 1, b, -up) if (1 - a[2]) * a[0] <= b[2] * b[0] else (b, 0, a, up)
            else:
                whole, value, other, change = (a, 0, b, down) if a[2] * a[0] <= (1 - b[2]) * b[0] else (b, 1, a, -down)
            done[whole[1]] = value
            other[2] = min(1.0, max(0.0, other[2] + change / other[0]))
            a = other
        return tuple(a), done

    def reduced(left, seed, leaves):
        decided, level = {}, 0
        while True:
            nodes = -(-len(left) // fanout)
            dealt = {}
            for r in left:
                dealt.setdefault(hash64(r[1], seed + level) % nodes, []).append(r)
            left = []
            for some in dealt.values():
                one, done = (leaf if leaves and level == 0 else pairs)(sorted(some, reverse=True), seed + level)
                left.append(one)
                decided |= done
            if nodes == 1:
                return left[0], decided
            level += 1

    rounded = lambda one: {one[1]: int(draw(seed - 1, one[1]) < one[2])}
    nodes = -(-len(rows) // fanout)
    cut = sum(r[0] for r in rows) / nodes / mixing.LARGE if nodes > 1 else math.inf
    small, large = [r for r in rows if r[0] <= cut], [r for r in rows if r[0] > cut]
    decided = {}
    if large:
        (s, name, x), decided = reduced(large, seed + 100, False)
        p, w = small[0][2], sum(r[0] for r in small)
        up, down = min((1 - x) * s, p * w), min(x * s, (1 - p) * w)
        if draw(seed - 2, name) * (up + down) < down:
            x, p = (1.0, max(0.0, p - up / w)) if (1 - x) * s <= p * w else (min(1.0, x + up / s), 0.0)
        else:
            x, p = (0.0, min(1.0, p + down / w)) if x * s <= (1 - p) * w else (max(0.0, x - down / s), 1.0)
        decided |= rounded((s, name, x))
        small = [(r[0], r[1], p) for r in small]
    if small[0][2] in (0.0, 1.0):
        return decided | {r[1]: int(r[2]) for r in small}
    last, done = reduced(small, seed, True)
    return decided | done | rounded(last)


@pytest.mark.parametrize("n, fanout", [(40, 256), (900, 8), (1, 256), (2, 256)])
def test_pivotal_against_plain_one(spark, n, fanout):
    r = random.Random(4)
    data = [("a", f"k{i}", float(int(r.paretovariate(1) * 20)), 0.37) for i in range(n)]
    got = {x["id"]: x["up"] for x in mixing.pivotal(spark.createDataFrame(data, "g string, id string, size double, x double"), fanout=fanout).collect()}
    assert got == plain_pivotal([(s, i, x) for _, i, s, x in data], 42, fanout)


def test_pivotal_chances():
    """Over many seeds each of 200 documents is taken as often as its chance says, and every mix comes near its words."""
    r = random.Random(4)
    rows = [(float(min(2000, int(r.paretovariate(1) * 20))), f"k{i}", 0.37) for i in range(200)]
    total, n = sum(s for s, _, _ in rows), 1500
    taken = Counter()
    for seed in range(n):
        up = plain_pivotal(rows, 1000 + seed * 1000, 256)
        taken.update(i for i, x in up.items() if x)
        assert abs(sum(s for s, i, _ in rows if up[i]) - 0.37 * total) <= 40
    sd = math.sqrt(0.37 * 0.63 / n)
    assert max(abs(taken[i] / n - 0.37) for _, i, _ in rows) < 4.5 * sd


@pytest.mark.parametrize("ids", ["half null", "five"])
def test_mixing_without_own_ids(spark, ids):
    r = random.Random(6)
    rows = [(None if ids == "half null" and i % 2 else i if ids == "half null" else i % 5, " ".join(["w"] * int(r.paretovariate(1.3) * 20)) + f" {i % 1500}", "ab"[i % 3 == 0]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3000
    for t in {x["target"] for x in got}:
        assert abs(sum(x["taken"] for x in got if x["target"] == t) - t) < 0.005 * t


def test_mixing_many_equal_rows(spark):
    df = spark.createDataFrame([(7, "a b c", "s")] * 2500 + [(None, "d", None)] * 3 + [(1, "e f", "t")], "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = mixing.mix(df).collect()
    assert len(got) == 2504 and abs(sum(x["taken"] for x in got if x["doc_id"] == 7) - next(x["target"] for x in got if x["doc_id"] == 7)) <= 3
    copies = Counter((r["doc_id"], r["text"], r["n"], r["key"]) for r in mixing.mixed(df).collect())
    want = Counter()
    for x in got:
        want[x["doc_id"]] += x["copies"]
    assert {k[0]: v for k, v in copies.items()} == {k: v for k, v in want.items() if v}


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0, 0]


# 10


def plain_removal(rows, n=200):
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[s : s + n] for b in raw for s in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = True
        gone = gone[:-1]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [repeats.LARGEST, 3, 1])
def test_repeats(spark, largest):
    r = random.Random(11)
    a, b = ("".join(r.choice("klmnopqé") for _ in range(260)) for _ in "ab")
    rows = [*texts(), a + " between " + b, b + " or " + a]
    got = known(repeats.remove_repeats(frame(spark, rows).withColumn("spans", F.lit(1)), largest=largest, keep_text=True, carry=["lang"]))
    want = plain_removal(rows)
    assert [tuple(got[3 * i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(rows))] == want
    assert sum(w[1] for w in want) > 5000 and sum(w[2] > 1 for w in want)


def test_repeats_over_pieces(spark, monkeypatch):
    import pyarrow as pa

    r = random.Random(6)
    part = "".join(r.choice("abcdefgh") for _ in range(700))
    rows = ["".join(r.choice("abcdefgh") for _ in range(3000)) + part + "x" * 300, part[100:] + "".join(r.choice("abcdefgh") for _ in range(2500)) + part[:350]]
    whole = [sorted(zip(*(x.tolist() for x in p))) for p in repeats.places(pa.array(rows))]
    monkeypatch.setattr(repeats, "PIECE", 500)
    cut = [sorted(zip(*(x.tolist() for x in p))) for p in repeats.places(pa.array(rows))]
    assert sorted(sum(whole, [])) == sorted(sum(cut, []))


def test_repeat_groups_are_maximal():
    r = random.Random(8)
    for n in [9] * 40 + [150] * 6:
        core = bytes(r.choice(b"ab") for _ in range(4))
        ctx = list({(bytes(r.choice(b"ab") for _ in range(r.randint(0, 5))), core + bytes(r.choice(b"ab") for _ in range(r.randint(0, 5)))) for _ in range(n)})
        got = {(a, b, tuple(sorted(m))) for a, b, m in repeats.repeat_groups(ctx, 6, 4)}
        want = set()
        for i in range(len(ctx)):
            for j in range(i):
                a, b = repeats.common(ctx[i][0], ctx[j][0]), repeats.common(ctx[i][1], ctx[j][1])
                if a + b >= 6:
                    want.add((a, b, tuple(k for k in range(len(ctx)) if ctx[k][0].startswith(ctx[i][0][:a]) and ctx[k][1].startswith(ctx[i][1][:b]))))
        assert got == want
        counts = [r.choice([1, 1, 1, 2]) for _ in ctx]
        leaves = {(len(x[0]), len(x[1]), (i,)) for i, x in enumerate(ctx) if counts[i] > 1 and len(x[0]) + len(x[1]) >= 6}
        reach = [(max((a for a, _, m in want | leaves if i in m), default=0), max((b for _, b, m in want | leaves if i in m), default=0)) for i in range(len(ctx))]
        assert repeats.reaches(ctx, counts, 6, 4) == reach


def test_large_groups_are_split(spark):
    """One gram with 300 surroundings, of which some repeat around it: split trees against one tree."""
    r = random.Random(18)
    word = lambda n, of="ab": bytes(r.choice(of.encode()) for _ in range(n))
    core, lefts, rights = b"c" * 80, [word(120) for _ in range(5)], [word(120) for _ in range(5)]
    rows = []
    for i in range(300):
        left, right = r.choice(lefts), r.choice(rights)
        left = left[: r.randint(0, 120)] + word(r.choice([0, 40, 120]), "xyz")
        right = core + right[: r.randint(0, 120)] + word(r.choice([0, 40, 120]), "xyz")
        rows.append((7, i, r.choice([1, 1, 1, 2]), left[:120], right[:200]))
    rows = [x for k, x in enumerate(rows) if (x[3], x[4]) not in {(y[3], y[4]) for y in rows[:k]}]
    df = spark.createDataFrame([(g, c, n, bytearray(a), bytearray(b)) for g, c, n, a, b in rows], "g long, c long, n long, l binary, r binary")
    want = {x[1]: (-a, b) for x, (a, b) in zip(rows, repeats.reaches([(x[3], x[4]) for x in rows], [x[2] for x in rows])) if b}
    assert 20 < len(want) < 290
    for largest, steps in ((10_000, (4, 1)), (100, (4, 1)), (2, (4, 1)), (2, (7, 1))):
        got = {x["c"]: (x["lo"], x["hi"]) for x in repeats._reaches(df, 200, 80, largest, steps).collect()}
        assert got == want, (largest, steps)


def test_groups_have_all_occurrences(spark):
    r = random.Random(19)
    part = "".join(r.choice("abcd") for _ in range(240))
    rows = [f"{i} " + "".join(r.choice("efgh") for _ in range(50)) + part + "".join(r.choice("efgh") for _ in range(50)) for i in range(5)]
    texts_ = repeats.distinct_texts(frame(spark, rows))
    of = {x["tid"]: repeats.zstandard.ZstdDecompressor().decompress(x["z"]).decode() for x in texts_.collect()}
    found = {}
    for x in repeats.Repeats(texts_).groups().collect():
        found.setdefault((x["gram"], x["node"]), []).append((x["tid"], of[x["tid"]][x["lo"] : x["hi"]]))
    assert found
    for members in found.values():
        assert len({t for _, t in members}) == 1 and len(members[0][1]) >= 200
        assert sorted(i for i, _ in members) == sorted(i for i, t in of.items() if members[0][1] in t)
    assert any(len(m) == len(rows) for m in found.values())


@pytest.mark.parametrize("one_letter", [False, True])
def test_many_equal_rows_without_ids(spark, one_letter, n=1000):
    """A text a thousand times without ids, beside others: of random letters, or of one letter each, which repeat within themselves."""

    def text(seed, letters, size):
        r = random.Random(seed)
        return r.choice(letters) * size if one_letter else "".join(r.choice(letters) for _ in range(size))

    t = text(9, "abcdefghij", 900)
    rows = [(None, t)] * n + [(None, f"{i} " + text(i, "klmnop", 300)) for i in range(30)] + [(4, "x" + t[:250] + "y" * 40)]
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"]) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, *of[:3]) for (i, _), of in zip(rows, plain_removal([t for _, t in rows])))
    if not one_letter:
        assert got == {(None, 900, 900, 1): n, (None, 302, 0, 0): 10, (None, 303, 0, 0): 20, (4, 291, 250, 1): 1}


def test_repeated_rows_remove_each_other(spark):
    t = "".join(random.Random(9).choice("abcdefghij") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (1, "other " + t[:150]), (None, None), (None, "x" + t[:250]), (2**60 + 1, t[:220])], "doc_id long, text string")
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(df).collect()]
    assert sorted(got) == [("1", 156, 0), ("1", 300, 300), ("1", 300, 300), (str(2**60 + 1), 220, 220), ("None", 0, 0), ("None", 251, 250)]
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


# 1


def test_url_rules(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://www.Example.com/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1#t": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "x://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "x://b.net/fr/a://c.com/": ("b.net", "/fr/a://c.com/", "net/fr/", "block"),
        "x://com": ("com", "", None, None),
        "x://a.org/y": ("a.org", "/y", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://É.COM/Ü": ("É.com", "/Ü", "com/", "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    rows += [(0, "http://a.com/x", "h")] + [(100 + i, f"http://good{i}.com/nice/{i}", "") for i in range(40)] + [(200 + i, f"http://spam{i}.net/es/{i}", "") for i in range(40)]
    rows += [(300, "http://spam7.org/es/3", ""), (301, "http://good9.org/nice/2", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("score", F.lit(1))
    out = url_filter.url_filter(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    for i, want in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == want[:3]
        assert got[i]["verdict"] == want[3] or want[3] is None and got[i]["verdict"] in ("allow", "block")
    assert got[301]["score"] > got[300]["score"] and got[301]["verdict"] == "allow" and got[300]["verdict"] == "block"


@pytest.mark.parametrize("limit", [100_000, 10])
def test_url_models_against_plain_ones(spark, limit):
    r = random.Random(21)
    spelt = lambda ends: "^" + "".join(r.choice("abc./") for _ in range(r.randint(3, 14))) + r.choice(ends) + "$"
    rows = [(spelt(["xx", "y"]), "allow") for _ in range(60)] + [(spelt(["zz", "y"]), "block") for _ in range(40)]
    order, back = url_filter.ORDER, url_filter.BACK
    seen, total = Counter(), Counter()
    for text, side in rows:
        for i in range(1, len(text)):
            for o in range(min(order, i) + 1):
                seen[side, text[i - o : i], text[i]] += 1
                total[side, text[i - o : i]] += 1

    def chance(side, c, x):
        shorter = chance(side, c[1:], x) if c else 1 / url_filter.SYMBOLS
        return (seen[side, c, x] + back * shorter) / (total[side, c] + back)

    def plain(text):
        out = 0.0
        for i in range(1, len(text)):
            found = [text[i - o : i] for o in range(min(order, i) + 1) if any(seen[v, text[i - o : i], text[i]] for v in ("allow", "block"))]
            if found:
                out += math.log(chance("allow", found[-1], text[i]) / chance("block", found[-1], text[i]))
        return out / (len(text) - 1)

    model = url_filter.train(spark.createDataFrame(rows, "s string, verdict string"))
    texts_ = [spelt(["xx", "zz", "q"]) for _ in range(40)] + ["^$"]
    got = {x["id"]: x["score"] for x in url_filter.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "id long, s string"), model, limit).collect()}
    for i, t in enumerate(texts_):
        assert got[i] == pytest.approx(plain(t), abs=1e-9), t


def test_url_cutoff(spark):
    scores = spark.createDataFrame([(x / 100,) for x in range(-300, 700)], "score double")
    cut = url_filter.calibrate(scores, 0.05)
    assert sum(x / 100 < cut for x in range(-300, 700)) <= 50 and cut == pytest.approx(-2.5, abs=0.02)
    assert url_filter.calibrate(scores.limit(0)) == 0


def test_url_filter_without_labels(spark):
    df = spark.createDataFrame([(1, "a://x.org/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.url_filter(df).collect()] == ["allow"]
    assert url_filter.url_filter(df.limit(0)).collect() == []


# 4


def test_license_scan(spark):
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", apache),
        (2, "a/x/1.txt", "plain words"),
        (3, "a/x/y/2.txt", "many other words of a text that is long enough\nand goes on for a while, so that a notice is a header\n" + gpl),
        (4, "a/x/COPYING", gpl + "\n" + gpl),
        (5, "a/x/y/3.txt", None),
        (6, "b/4.txt", ""),
        (7, None, "a licence is a word in this sentence only"),
        (8, "a/5.txt", "nothing"),
        (8, "a/5.txt", "nothing"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("n", F.lit(0))
    out = licenses.scan(df).collect()
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"]) for r in out}
    assert len(out) == 9
    assert got == {
        1: ("Apache-2.0", "file", None),
        2: ("GPL-3.0", "inherited", "a/x"),
        3: ("GPL-3.0", "header", None),
        4: ("GPL-3.0", "file", None),
        5: ("GPL-3.0", "inherited", "a/x"),
        6: (None, None, None),
        7: (None, None, None),
        8: ("Apache-2.0", "inherited", "a"),
    }
    assert licenses.scan(df.limit(0)).collect() == []



def test_short_notices(spark):
    """Each short notice below prose, by the license that it names."""
    want: dict = {"All rights reserved.": "proprietary", "SPDX-License-Identifier: ISC": "ISC", "no license is named here": None}
    want |= {f"{lead}SPDX-License-Identifier: {x}": x for lead in ("", "# ", "// ") for x in ("Apache-2.0", "MIT", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0")}
    want |= {f"SPDX-License-Identifier: {x}{end}": x for x in ("GPL-2.0", "GPL-3.0", "LGPL-3.0") for end in ("", "-only", "-or-later")}
    want |= {"All rights reserved.\n" + licenses.TEXTS[2][1]: "BSD-3-Clause"}
    rows = [(i, f"d{i}/x", "some words of a text\n" * 20 + t) for i, t in enumerate(want)]
    got = known(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert {t: got[i]["license"] for i, t in enumerate(want)} == want


def wrapped(text, width=80, lead=""):
    import textwrap

    return "\n".join(lead + x for x in textwrap.wrap(text, width - len(lead)))


def test_license_files_and_headers(spark):
    """Whole licenses, wrapped, and headers above code, in nested directories."""
    texts_ = {}
    for t in licenses.TEXTS:
        texts_.setdefault(t[0], []).append(t[1:])
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 Some One", *(wrapped(p) for p in texts_["MIT"][0])])
    bsd = "\n\n".join(["Copyright 2021, Other People", *(wrapped(p, 60) for p in texts_["BSD-3-Clause"][0])])
    apache = "\n#\n".join(wrapped(p, 79, "# ") for p in texts_["Apache-2.0"][1])
    gpl = wrapped(texts_["GPL-3.0"][0][0], 70, " * ")
    code = "import os\nprint(os.getcwd())\n"
    rows = [
        (1, "a/anything.txt", mit),
        (2, "a/b/c/x.py", code),
        (3, "b/x.py", f"{apache}\n{code}"),
        (4, "b/y.py", code),
        (5, "c/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "Many more words of sections follow, which no template here has. " * 40),
        (6, "c/d/z.c", f"/*\n{gpl}\n */\n" + "int main(void) { return 0; }\n" * 30),
        (7, "c/d/e.c", code * 20),
        (8, "d/f.txt", bsd),
        (9, "d/g/h.txt", "prose about nothing in particular " * 30),
        (10, "e/i.txt", ("some words of a text that go on\n" * 60) + wrapped(texts_["MIT"][0][0], 50) + ("\nand on and on they go" * 60)),
        (11, "e/j.txt", None),
    ]
    got = known(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("units", F.lit(1)).withColumn("whole", F.lit(2))))
    assert {i: (r["license"], r["how"], r["from_dir"]) for i, r in got.items()} == {
        1: ("MIT", "file", None),
        2: ("MIT", "inherited", "a"),
        3: ("Apache-2.0", "header", None),
        4: (None, None, None),
        5: ("GPL-3.0", "file", None),
        6: ("GPL-3.0", "header", None),
        7: ("GPL-3.0", "inherited", "c"),
        8: ("BSD-3-Clause", "file", None),
        9: ("BSD-3-Clause", "inherited", "d"),
        10: ("MIT", "header", None),
        11: (None, None, None),
    }


def test_license_cues_are_complete():
    """A text without cues stays below the least cosine, whatever else of a template it has."""
    for seen in ({}, {"the": 10_000, "of": 9000, "license": 5}):
        rows, _, _ = licenses._weights(licenses.TEMPLATES, seen, 20_000)
        found = licenses.cues(rows, licenses.LEAST, seen)
        for i in {r[0] for r in rows}:
            assert math.sqrt(sum(w * w for t, _, term, w in rows if t == i and term not in found)) < licenses.LEAST
    pattern = licenses._any_of(found)
    assert all(re.search(pattern, f"x_{t}") and re.search(pattern, t) for t in found) and not re.search(pattern, "zzz")


# 5


def test_marginals_against_all_paths():
    r = np.random.default_rng(2)
    counts = np.array([1, 4, 2, 4])
    starts = np.cumsum(counts) - counts
    score, move = r.normal(size=counts.sum()), r.normal(size=(2, 2))
    p, both, log_z = quality_crf.marginals(score, starts, counts, move)
    want, pairs, total = [], np.zeros((2, 2)), 0.0
    for s, n in zip(starts, counts):
        z, m = 0.0, np.zeros(n)
        local = np.zeros((2, 2))
        for path in range(1 << n):
            y = [path >> i & 1 for i in range(n)]
            v = math.exp(sum(score[s + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            z += v
            m += v * np.array(y)
            for i in range(n - 1):
                local[y[i], y[i + 1]] += v
        want += list(m / z)
        pairs += local / z
        total += math.log(z)
    assert np.allclose(p, want) and np.allclose(both, pairs) and abs(log_z - total) < 1e-9


def test_likelihood_by_all_paths_and_small_steps():
    """The value against a sum over all labellings, its gradients against differences."""
    r = np.random.default_rng(5)
    counts = np.array([3, 1, 4])
    starts = np.cumsum(counts) - counts
    x, y = r.integers(0, 2, (8, 3)).astype(float), np.repeat([1.0, 0.0, 1.0], counts)
    w, move = r.normal(size=3), r.normal(size=(2, 2))

    def plain(w, move):
        out = -quality_crf.RIDGE / 2 * (w @ w + (move * move).sum())
        for s, n in zip(starts, counts):
            def path(v):
                return sum(x[s + i] @ w * v[i] for i in range(n)) + sum(move[v[i], v[i + 1]] for i in range(n - 1))

            every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
            out += path([int(v) for v in y[s : s + n]]) - math.log(sum(math.exp(path(v)) for v in every))
        return out

    value, by_w, by_move = quality_crf.likelihood(x, y, starts, counts, w, move)
    assert value == pytest.approx(plain(w, move))
    e = 1e-5
    for i in range(3):
        d = e * (np.arange(3) == i)
        assert by_w[i] == pytest.approx((plain(w + d, move) - plain(w - d, move)) / (2 * e), abs=1e-6)
    for i in range(4):
        d = e * (np.arange(4) == i).reshape(2, 2)
        assert by_move.ravel()[i] == pytest.approx((plain(w, move + d) - plain(w, move - d)) / (2 * e), abs=1e-6)


def test_classifier_uses_long_texts(spark):
    """A sample of texts of thousands of lines is used whole."""
    rows = ["\n".join("A calm line of words goes here." if i % 2 else "$$$ BUY!! | free |" for _ in range(2500)) for i in range(8)]
    labels = spark.createDataFrame([(3 * i, i % 2) for i in range(8)], "doc_id long, quality int")
    out = known(quality_crf.classify(frame(spark, rows), labels))
    assert all((out[3 * i]["predicted"] == 1) == bool(i % 2) for i in range(8))


def test_classifier_learns(spark):
    good = "The quick words of a calm sentence go on here.\nAnother calm line follows it."
    bad = "BUY!! NOW!! $$$ ***\nfree | free | free | free | free | free"
    rows = [good + f" Then {i} ends." if i % 3 else bad + f" $$$ {i}" for i in range(150)] + [None, "", "\n \n", good * 300]
    labels = spark.createDataFrame([(3 * i, int(i % 3 > 0)) for i in range(150)] + [(3, None), (9999, 1)], "doc_id long, quality int")
    df = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(0))
    out = known(quality_crf.classify(df, labels))
    assert all((out[3 * i]["predicted"] == 1) == (i % 3 > 0) for i in range(150))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[3 * 150]["score"] == out[3 * 151]["score"] == out[3 * 152]["score"]
    assert {r["score"] for r in quality_crf.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality_crf.classify(frame(spark, []), labels).collect() == []


# 7


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    html = ["<p>a</p>", None, "", "é" * 1000, "<p>a</p>", "b", "<p>a</p>"]
    rows = [(i, f"http://h{i % 3}.Example.com:80/p {i % 2}\n", h) for i, h in enumerate(html)] + [(10 + i, "http://same.org/", "hot") for i in range(20)] + [(50, None, "x"), (50, None, "x"), (-4, "u", "neg")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("last", F.lit(2))
    out = warc.archive_pages(df).collect()
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(p, last.get(h or "", p))
    want = []
    for p, u, h in rows:
        b = (h or "").encode()
        rev = last[h or ""] != p
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if rev else "response", last[h or ""] if rev else None))
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r[c] for c in cols) for r in out], key=str) == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_surt():
    assert warc.surt("http://Blog.A.com/x y?q") == "com,a,blog)/x%20y?q" and warc.surt(None) == ")"


def test_warc_spans():
    entries = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 40, 100), ("a", 150, 3), ("b", 153, 4), ("b", 157, 1)]
    got = list(warc.spans(iter(entries), stretch=30, gap=5))
    assert got == [("a", [(0, 10), (10, 5), (20, 5)]), ("a", [(40, 100)]), ("a", [(150, 3)]), ("b", [(153, 4), (157, 1)])]
    assert [(n, *p) for n, ps in got for p in ps] == entries and list(warc.spans(iter([]))) == []
