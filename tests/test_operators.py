import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.codec import rans
from loomspan.functions import affine
from loomspan.operators import compress, profile, quantizers, routing, symbols, transforms
from loomspan.operators.cells import beside, coordinate, strided
from loomspan.sources.tables import SCHEMA
from loomspan.streaming import encode as streaming

RNG = np.random.default_rng(7)


def test_bounds_and_storage():
    assert [affine.bounds(b) for b in (1, 2, 4, 8)] == [(-1, 1), (-1, 1), (-7, 7), (-127, 127)] and affine.bounds(3, "asymmetric") == (0, 7)
    assert [affine.storage(b) for b in (4, 8, 9, 17, 32)] == ["int8", "int8", "int16", "int32", "int32"] and affine.storage(8, "asymmetric") == "uint8"
    for bad in (0, 33):
        with pytest.raises(ValueError):
            affine.bounds(bad)


@pytest.mark.parametrize("mode, bits", [("symmetric", 4), ("asymmetric", 8)])
@pytest.mark.parametrize("rows", [[0.0] * 4, [-3.0] * 4, [2.0, 2.0], [-1.5, 0.2, 3.0, 0.0]])
def test_quantize(spark, mode, bits, rows):
    df = spark.createDataFrame([("t", float(x)) for x in rows], "t string, x double")
    q = quantizers.quantize(df, ["t"], bits, mode).collect()
    for r in q:
        assert abs(r["x"] - r["y"]) <= r["scale"] / 2 + 1e-6


def test_not_finite_raises(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", float("nan"))], "t string, x double")
    with pytest.raises(Exception, match="not finite"):
        quantizers.quantize(df, ["t"], 4).collect()


def moved(df, metric="shuffleRecordsWritten"):
    """Rows (or by another metric) that a query shuffles, at most in one exchange."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange":
            most = max(most, p.metrics().apply(metric).value())
        todo += [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.fixture
def cells_are_large(spark):
    """No table is small enough to be broadcast by its size alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_of_few_groups_stay_where_they_are(spark, cells_are_large):
    df = spark.range(20_000).selectExpr("concat('t', id % 2) as t", "id as i", "float(id % 100) as x")
    assert moved(quantizers.quantize(df, ["t"], 8).groupBy("q").count()) < 2000
    assert moved(transforms.normalize(df, ["t"]).groupBy("y").count()) < 2000
    assert moved(symbols.arithmetic(df, ["t"], "i", "x")) < 2000
    assert moved(routing.mask_values(df, ["t"], "i", "x")) < 2000
    assert moved(profile.histogram_entropy(df, ["t"])) < 2000


def test_chunks_of_few_tensors_stay_where_they_are(spark, cells_are_large):
    chunk = np.arange(25_000, dtype="<f4").tobytes()
    df = spark.createDataFrame([("t", "<f4", [500_000], i, 20, i * 25_000, bytearray(chunk)) for i in range(20)], SCHEMA).repartition(4).localCheckpoint()
    assert moved(compress.entropies(df), "dataSize") < len(chunk) and moved(compress.encode(df), "dataSize") < len(chunk)


@pytest.mark.parametrize("few", [0, 3, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_beside(spark, few, how):
    rows = "values (1, timestamp '2024-11-03 01:30:00', 'a'), (2, null, null), (3, timestamp '2024-11-03 02:30:00', 'ä'), (4, timestamp '1900-01-01 00:00:00', 'a')"
    df = spark.sql(f"select * from {rows} t(n, at, k)")
    p = df.filter("n < 4").groupBy("at", "k").agg(F.max("n").alias("m"), F.min(F.col("n").cast("decimal(9,2)")).alias("d"))
    got = sorted((r["n"], r["m"], r["d"]) for r in beside(df, p, ["at", "k"], how, few).collect())
    assert got == sorted((r["n"], r["m"], r["d"]) for r in df.join(p, ["at", "k"], how).collect()) and len(got) == (2 if how == "inner" else 4)
    assert beside(df.filter("n > 9"), p.filter("m > 9"), ["at", "k"], how, few).collect() == []


@pytest.mark.parametrize("gathered", [profile.GATHERED, 50])
def test_percentiles(spark, gathered):
    v = np.concatenate([RNG.normal(size=3000), [1e6, 1e6, -5e3], np.zeros(500)])
    rows = [("a", float(x)) for x in v] + [("b", 4.0)] * 100 + [("c", float(i)) for i in range(7)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    at = [0.0, 0.005, 0.5, 0.999, 1.0]
    got = {r["k"]: [r[f"p{i}"] for i in range(5)] for r in profile.percentiles(df, ["k"], "x", at, gathered).collect()}
    assert got["a"] == pytest.approx(np.percentile(v, [p * 100 for p in at]).tolist(), rel=1e-9)
    assert got["b"] == [4.0] * 5 and got["c"] == pytest.approx([0, 0.03, 3, 5.994, 6])


def test_percentiles_of_large_groups_stay_where_they_are(spark, cells_are_large):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'even', null) as k", "double(id) as x")
    out = profile.percentiles(df, ["k"], "x", [0.005, 0.5, 0.999], 100)
    assert {r["k"]: [r["p0"], r["p1"], r["p2"]] for r in out.collect()} == {k: pytest.approx([a + 99.99, a + 9999, a + 19978.002]) for k, a in (("even", 0), (None, 1))}
    assert moved(out) < 2000


@pytest.fixture
def gathers_few(monkeypatch):
    """Groups of over 100 values count as large."""
    monkeypatch.setattr(profile.percentiles, "__defaults__", (100,))


def test_tails_of_large_groups(spark, cells_are_large, gathers_few):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'even', 'odd') as k", "id - 1000D as x")
    out = quantizers.calibrate(df, ["k"], 4, affine.ASYMMETRIC, policy=quantizers.Policy("percentile", 99.0))
    got = {r["k"]: [r["lo"], r["hi"], r["scale"], r["zero"]] for r in out.collect()}
    for k, a in (("even", -1000), ("odd", -999)):
        lo, hi = np.percentile(np.arange(a, 19_000, 2), [0.5, 99.5])
        assert got[k] == pytest.approx([lo, hi, (hi - lo) / 15, np.rint(-lo / ((hi - lo) / 15))])
    assert moved(out) < 2000


def test_magnitudes_of_large_groups(spark, cells_are_large, gathers_few):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'even', 'odd') as k", "id - 1000D as x")
    out = quantizers.calibrate(df, ["k"], 8, policy=quantizers.Policy("percentile", 99.9))
    got = {r["k"]: [r["lo"], r["hi"], r["scale"], r["zero"]] for r in out.collect()}
    for k, a in (("even", -1000), ("odd", -999)):
        top = np.percentile(np.abs(np.arange(a, 19_000, 2)), 99.9)
        assert got[k] == pytest.approx([-top, top, top / 127, 0])
    assert moved(out) < 2000


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_of_odd_values(spark, keys):
    """Narrowed and gathered alike: over all magnitudes, both zeros, infinite, long runs of one value."""
    v = np.concatenate([10.0 ** RNG.uniform(-300, 300, 2000), -(10.0 ** RNG.uniform(-320, 10, 1000)), [0.0, -0.0] * 40, [float("inf")] * 60, [-float("inf")] * 5, [2.5] * 300])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", None)], "k string, x double")
    at = [0.001, 0.002, 0.3, 0.31, 0.5, 0.7, 0.99, 1.0]
    got, plain = ([list(r) for r in profile.percentiles(df, keys, "x", at, n).collect()] for n in (20, 10**6))
    assert len(got) == 1 and got[0][:-len(at)] == plain[0][:-len(at)] and got[0][-len(at):] == pytest.approx(plain[0][-len(at):], rel=1e-12)


@pytest.mark.parametrize("counts", [[5, 4, 3, 2, 1], [1] * 600 + [10**7], [1] * 300, [7], [1, 1, 10**9], [3] * 200 + [10**6] * 2])
@pytest.mark.parametrize("total", [65_536, 1024])
def test_normalized_frequencies_agree(spark, counts, total):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(counts)], "k int, symbol int, c long")
    got = [r["f"] for r in symbols.normalized(df, ["k"], total).orderBy("symbol").collect()]
    assert sum(got) == total and got == rans.normalize(np.array(counts), total).tolist()


@pytest.mark.parametrize("h, target", [([0.0, 1.0, 5.0], 4), ([1.0] * 5, 3), ([9.0, 0.1, 0.1], 4), ([9.0, 8.9, 0.0, 0.0], 6), ([5.0, 1.0], 8), ([2.0], 4)])
def test_allocation(spark, h, target):
    df = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(h)], "n string, bits double")
    got = [r["bits"] for r in symbols.allocate_bits(df, "n", target).orderBy("n").collect()]
    # one at a time, in turn
    share = np.maximum(h, 1e-9) / np.maximum(h, 1e-9).sum() * (target - 2) * len(h)
    want = np.minimum(np.floor(share), 6)
    turn = sorted(range(len(h)), key=lambda i: (-(share[i] - np.floor(share[i])), -max(h[i], 1e-9), f"t{i}"))
    left = min((target - 2) * len(h), 6 * len(h)) - want.sum()
    while left > 0:
        for i in turn:
            if left > 0 and want[i] < 6:
                want[i] += 1
                left -= 1
    assert got == (want + 2).astype(int).tolist() and sum(got) <= target * len(h)


def test_runs_and_null(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([None, None, "a", "a", "b", None])], "k int, i int, s string")
    got = [(r["symbol"], r["start"], r["length"]) for r in symbols.runs(df, ["k"], "i", "s").orderBy("run").collect()]
    assert got == [(None, 0, 2), ("a", 2, 2), ("b", 4, 1), (None, 5, 1)]


def test_coordinates(spark):
    shape = [2, 3, 4]
    df = spark.range(24).select(*[coordinate(F.col("id"), shape, a).alias(f"c{a}") for a in range(3)], coordinate(F.col("id"), shape, -1).alias("last"), "id")
    for r in df.collect():
        assert (r["c0"], r["c1"], r["c2"]) == tuple(int(x) for x in np.unravel_index(r["id"], shape)) and r["last"] == r["c2"]
    assert strided(df, "id", 24, 10).count() == 8


def test_components(spark):
    a = RNG.normal(size=(200, 3)) @ RNG.normal(size=(3, 8)) + 0.001 * RNG.normal(size=(200, 8)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i int, v array<double>")
    c = transforms.fit_components(df, "v", 0.99)
    assert c.k <= 3 and c.ratio.sum() >= 0.99
    back = np.array([r["restored"] for r in transforms.restore(transforms.project(df, "v", c), c).orderBy("i").collect()])
    assert np.abs(back - a).max() < 0.7 and transforms.effective_rank(df, "v") < 4
    assert transforms.effective_rank(spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>"), "v") == pytest.approx(1)


def test_normalize_back(spark):
    rows = [(c, i, float(np.float32(x))) for c, line in enumerate([[1, 2, 4], [-1, 0.5, 3], [0, 0, 0], [-3, -2, -2.5]]) for i, x in enumerate(line)]
    df = spark.createDataFrame(rows, "c int, i int, x double")
    n = transforms.normalize(df, ["c"])
    assert n.agg(F.max(F.abs("y"))).first()[0] <= 1
    back = transforms.denormalize(n.withColumnRenamed("x", "was")).filter(F.abs(F.col("x") - F.col("was")) > 1e-6)
    assert back.count() == 0


def test_pipeline_names():
    p = transforms.Pipeline().add("a", lambda d: d, lambda d: d)
    with pytest.raises(ValueError):
        p.add("a", lambda d: d, lambda d: d)


def test_strategies(spark):
    df = spark.createDataFrame([(t,) for t in routing.TYPES], "t string").select("t", routing.strategy(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()}["UNKNOWN"] == 255 and df.agg(F.count_distinct("s")).first()[0] == 9


def test_encode_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    a = {f"w{i}.weight": RNG.normal(size=(64, 32)).astype(np.float32) for i in range(3)}
    for n, x in list(a.items())[:2]:
        np.save(folder / f"{n}.npy", x)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streaming.encode_stream(spark, str(folder), out, mark).awaitTermination(120)
    np.save(folder / "w2.weight.npy", a["w2.weight"])
    streaming.encode_stream(spark, str(folder), out, mark).awaitTermination(120)
    from loomspan.operators import compress

    back = {r["tensor_name"]: np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]) for r in compress.decode(spark.read.parquet(out).drop("batch")).collect()}
    assert set(back) == set(a) and all(np.abs(back[n] - a[n]).max() < 0.5 for n in a)


def test_difference_stream(spark, tmp_path):
    rows = [(k, i, float(i * i + k)) for i in range(6) for k in (1, 2)]
    schema = "k long, i long, x double"
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streaming.difference_stream(s, "k", "i", "x").writeStream.format("memory").queryName("deltas").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], r["i"]): r["delta"] for r in spark.table("deltas").collect()}
    assert len(got) == 12 and sum(v for (k, _), v in got.items() if k == 1) in (25.0, 25.0 - 0.0)


def test_components_far_from_zero(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(300, 4)) * [3, 2, 1, 0.5]
    near, far = (transforms.fit_components(spark.createDataFrame([(x.tolist(),) for x in a + shift], "x array<double>"), "x", 1.0) for shift in (0, 1e8))
    want = np.linalg.eigvalsh(np.cov(a.T, bias=True))[::-1]
    assert np.allclose(near.ratio, want / want.sum()) and np.allclose(far.ratio, near.ratio, atol=1e-6) and np.allclose(far.mean, a.mean(0) + 1e8)
