"""The pipeline, stage by stage, against plain versions of what each stage keeps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import bpe, mixing, quality_crf, simhash

from .test_operators import DOCS, plain_removal, roots, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocab = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    passage = say(60)
    docs, labels = [], []
    for i in range(120):
        t = "\n".join(say(r.randint(8, 30)) for _ in range(r.randint(2, 6)))
        if i % 4 == 0:
            t = "\n".join("*** ".join(r.choice(vocab).upper() + "!!" for _ in range(30)) + " | | $$$" for _ in range(3))
        elif i % 10 == 1:
            t += "\n" + passage + "\n" + say(10)
        elif i % 10 == 2 and i > 10:
            t = docs[-10][1]
        docs.append((i, t, "en", "sabc"[i % 4] if i % 7 else None, len(t)))
        if i < 80:
            labels.append((i, int(i % 4 > 0), 0))
    docs += [(200, None, None, "a", None), (201, "", "en", "a", 0), (7, docs[7][1], "en", "a", 5)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def shingle_set(t):
    w = words((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=str)
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = sorted(docs.collect(), key=str)
        ids = [r["doc_id"] for r in after]
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality_classifier":
            bad = {r["text"] for r in before if r["doc_id"] < 120 and r["doc_id"] % 4 == 0}
            assert {r["doc_id"] for r in before if r["doc_id"] < 120 and r["text"] not in bad} == {i for i in ids if i < 120}
            assert [r for r in before if r in after] == after
        elif name == "simhash_near_duplicates":
            s = [shingle_set(r["text"]) for r in before]
            root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])])
            least = {}
            for i, r in enumerate(before):
                least[root[i]] = min(r["doc_id"], least.get(root[i], 1 << 60))
            assert sorted(ids) == sorted(least.values())
        elif name == "suffix_array_repeats":
            want = {}
            for r, (_, gone, _, _) in zip(before, plain_removal([r["text"] for r in before])):
                if not gone or gone < len((r["text"] or "").encode()):
                    want[r["doc_id"]] = gone
            assert set(ids) == set(want) and any(want.values())
            for r in after:
                assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) == len((next(b["text"] for b in before if b["doc_id"] == r["doc_id"]) or "").encode()) - want[r["doc_id"]]
        elif name == "mixing":
            copies = Counter()
            for r in mixing.mix(spark.createDataFrame(before, DOCS), tell=["lang", "n_chars"]).collect():
                copies[r["doc_id"]] += r["copies"]
            assert {i: ids.count(i) for i in copies if copies[i]} == {i: n for i, n in copies.items() if n}
            assert max(copies.values()) == 2 and min(copies.values()) >= 0
            kept = after
        else:
            tool = bpe.Bpe(bpe.vocabulary())
            assert sorted(ids) == sorted(r["doc_id"] for r in kept)
            text = {r["doc_id"]: r["text"] for r in kept}
            assert all(len(tool.encode(text[r["doc_id"]])) == 4 * r["n_tokens"] == 4 * len(r["ids"]) for r in after)


def test_run(spark, folder):
    a, b = (sorted(corpus_pipeline.run(spark, folder).collect(), key=str) for _ in range(2))
    assert a == b and len(a) > 60


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_words():
    assert words(" a\tb\x0bc ") == ["a", "b", "c"] and quality_crf.GOOD == 0.3 and F is not None


def test_near_copies_of_five_words(spark):
    """Pairs at and just below 0.8 by five words, with a passage in every text, against all pairs."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(6))
    common, rows = [word() for _ in range(30)], []
    for i in range(40):
        base = [word() for _ in range(104)]
        rows += [base + common, base[: r.randint(70, 103)] + common, base[:52] + [word() for _ in range(r.randint(1, 14))] + base[52:] + common]
        if i % 4 == 0:  # a chain, whose ends aren't alike
            rows += [base[k:] + [word() for _ in range(k)] + common for k in (12, 24, 36)]
    rows += [base[:12], base[:11], ["a"], ["A"], ["a", "b"]]
    text = [" ".join(x) for x in rows] + ["", None]

    s = [shingle_set(t) for t in text]
    root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])])
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(text)], DOCS)
    kept = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(root) and 40 < len(kept) < len(text) - 30


def test_repeated_and_null_ids(spark):
    r = random.Random(32)
    say = lambda: " ".join("".join(r.choice("aeioubcdfg") for _ in range(6)) for _ in range(60))
    a, b, c, d = (say() for _ in range(4))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b.upper()), (3, c), (3, d), (None, a), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((x["doc_id"], x["text"]) for x in kept), key=str) == sorted([(1, a), (2, min(b, b.upper())), (3, c), (3, d), (None, a), (None, d)], key=str)


def test_near_copies_in_many_tiles(spark, monkeypatch):
    """A large group whose members share 0.9 with their origin but less with each other, in small tiles."""
    r = random.Random(33)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(3)]
    rows = [" ".join(w if r.random() > 0.015 else word() for w in base[i % 3]) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], DOCS)
    s = [shingle_set(t) for t in rows]
    root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])])
    for tile, most in ((10, simhash.COPY_BYTES), (1 << 15, simhash.COPY_BYTES), (1 << 15, 3000)):
        monkeypatch.setattr(simhash, "COPY_BYTES", most)
        got = {bytes(x["key"]): x["root"] for x in simhash.near_copies(docs, tile=tile, verify=tile).collect()}
        keyed = {x["doc_id"]: bytes(x["_key"]) for x in simhash.with_words_key(docs).collect()}
        mine = [got.get(keyed[i], f"own {i}") for i in range(len(rows))]
        assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine)) < 100


def test_copies_of_repeated_and_null_ids(spark):
    text = [" ".join(f"w{i}" for _ in range(40)) for i in range(40)]
    rows = [(None if i % 5 == 0 else i // 4, t, "en", [None, "a", "b"][i % 3], len(t)) for i, t in enumerate(text)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(x["text"] for x in corpus_pipeline.mixed(spark, docs, "").collect())
    assert max(got.values()) == 2 and any(i is None and t in got for i, t, *_ in rows)
    target = {x["target"]: 0 for x in mixing.mix(docs).collect()}
    by_source = Counter()
    for _, t, _, source, _ in rows:
        by_source[source] += 40 * got[t]
    assert all(min(abs(n - t) for t in target) <= 40 for n in by_source.values())
