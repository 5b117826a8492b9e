"""Every query of the engine by name: a function of (spark, folder of tables) and SQL for an independent engine.

Sums and means are rounded in both, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import affine
from loomspan.operators import finetune, profile, quantizers, reports, routing, symbols, transforms
from loomspan.operators.cells import array_cells, column_tensors


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def embedding_cells(spark: SparkSession, d: str) -> DataFrame:
    return array_cells(table(spark, d, "embeddings"), "vec_id", "embedding")


#: The same cells in SQL.
CELLS = "cells as (select vec_id, cast(unnest(range(len(embedding))) as int) as dim, cast(unnest(embedding) as double) as x from embeddings)"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# statistics


@query(f"""with {CELLS} select dim, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, min(x) as lo, max(x) as hi,
  cast(count_if(abs(x) < 1e-6) as bigint) as near_zero, round(avg(case when abs(x) < 1e-6 then 1.0e0 else 0.0e0 end), 6) as sparsity from cells group by dim""")
def tensor_profile(spark, d):
    return rounded(profile.profile(embedding_cells(spark, d), ["dim"]), 6, "mean", "std", "sparsity")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COLUMNS = "t as (" + " union all ".join(f"select '{c}' as tensor_name, cast({c} as double) as x from lineitem" for c in NUMERIC) + ")"


@query(f"""with {COLUMNS}, r as (select tensor_name, count(*) as n, min(x) as lo, max(x) as hi from t group by 1),
b as (select t.tensor_name, r.n, case when hi > lo then least(floor((x - lo) / (hi - lo) * least(256, greatest(8, floor(sqrt(n))))), least(256, greatest(8, floor(sqrt(n)))) - 1) else 0 end as bin from t join r using (tensor_name)),
c as (select tensor_name, bin, n, count(*) as c from b group by all)
select tensor_name, n, round(greatest(0, -sum(c / cast(n as double) * log2(c / cast(n as double)))), 6) as bits from c group by tensor_name, n""")
def entropy_histogram(spark, d):
    return rounded(profile.histogram_entropy(column_tensors(table(spark, d, "lineitem"), NUMERIC), ["tensor_name"]), 6, "bits")


STREAMS = """s as (select 'line' as stream, cast(l_linenumber as varchar) as symbol from lineitem union all
  select 'flag', l_returnflag from lineitem union all select 'event', event_type from events union all select 'priority', o_orderpriority from orders)"""


def streams(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), lambda df, n, c: df.select(F.lit(n).alias("stream"), F.col(c).cast("string").alias("symbol"))
    return (
        part(line, "line", "l_linenumber")
        .unionByName(part(line, "flag", "l_returnflag"))
        .unionByName(part(table(spark, d, "events"), "event", "event_type"))
        .unionByName(part(table(spark, d, "orders"), "priority", "o_orderpriority"))
    )


@query(f"""with {STREAMS}, c as (select stream, symbol, count(*) as c from s group by all), n as (select *, sum(c) over (partition by stream) as n from c)
select stream, cast(n as bigint) as n, count(*) as symbols, round(-sum(c / cast(n as double) * log2(c / cast(n as double))), 6) as bits,
  round(-sum(c / cast(n as double) * log2(c / cast(n as double))) * n, 3) as total_bits from n group by stream, n""")
def entropy_symbols(spark, d):
    return rounded(rounded(profile.value_entropy(streams(spark, d), ["stream"], "symbol"), 6, "bits"), 3, "total_bits")


@query(f"""with {COLUMNS} select tensor_name, round(quantile_cont(x, 0.001), 6) as p0, round(quantile_cont(x, 0.5), 6) as p1, round(quantile_cont(x, 0.999), 6) as p2 from t group by 1""")
def exact_percentiles(spark, d):
    return rounded(profile.percentiles(column_tensors(table(spark, d, "lineitem"), NUMERIC), ["tensor_name"], "x", [0.001, 0.5, 0.999]), 6, "p0", "p1", "p2")


@query(f"""with {CELLS}, m as (select vec_id, x, avg(x) over (partition by vec_id) as m from cells),
s as (select vec_id, count(*) as n, avg((x - m) ** 2) as v, avg((x - m) ** 3) as t, avg((x - m) ** 4) as q from m group by 1)
select vec_id, n, round(t / v ** 1.5, 6) as skew, round(q / v ** 2, 6) as kurt,
  n >= 16 and sqrt(v) > 1e-12 and abs(t / v ** 1.5) <= 0.5 and q / v ** 2 between 2.0 and 4.5 as near_gaussian from s""")
def near_gaussian(spark, d):
    return rounded(profile.gaussian(embedding_cells(spark, d), ["vec_id"]), 6, "skew", "kurt").drop("std")


# quantization


@query(f"""with {CELLS}, p as (select vec_id, max(abs(x)) / 7.0e0 as s from cells group by 1)
select cast(least(greatest(round_even(x / case when s = 0 then 1.0e0 else s end, 0), -7), 7) as int) as q, count(*) as n from cells join p using (vec_id) group by 1""")
def quantize_channels(spark, d):
    q = quantizers.quantize(embedding_cells(spark, d), [], 4, layout=quantizers.Layout("per_channel", "vec_id"))
    return q.groupBy("q").agg(F.count("*").alias("n"))


@query("""with p as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
z as (select *, (hi - lo) / 255.0e0 as s, least(greatest(round_even(-lo / ((hi - lo) / 255.0e0), 0), 0), 255) as z from p)
select cast(least(greatest(round_even(l_extendedprice / s, 0) + z, 0), 255) as int) as q, count(*) as n from lineitem, z group by 1""")
def quantize_tensor(spark, d):
    cells = column_tensors(table(spark, d, "lineitem"), ["l_extendedprice"])
    return quantizers.quantize(cells, ["tensor_name"], 8, affine.ASYMMETRIC).groupBy("q").agg(F.count("*").alias("n"))


@query(f"""with {CELLS}, b as (select cast(vec_id // 128 as bigint) as block, min(x) as lo, max(x) as hi, count(*) as n from cells group by 1)
select block, lo, hi, round(greatest(abs(lo), abs(hi)) / 127.0e0, 12) as scale, 0.0e0 as zero from b""")
def blockwise_parameters(spark, d):
    return rounded(quantizers.calibrate(embedding_cells(spark, d), [], 8, layout=quantizers.Layout("blockwise", "vec_id", 128)), 12, "scale")


@query("""with p as (select l_returnflag, quantile_cont(abs(l_extendedprice), 0.999) as p from lineitem group by 1)
select l_returnflag, round(-p, 6) as lo, round(p, 6) as hi, round(p / 127.0e0, 9) as scale, 0.0e0 as zero from p""")
def percentile_parameters(spark, d):
    cells = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    return rounded(rounded(quantizers.calibrate(cells, ["l_returnflag"], 8, policy=quantizers.Policy("percentile", 99.9)), 6, "lo", "hi"), 9, "scale")


@query("""with p as (select l_returnflag, quantile_cont(l_extendedprice, 0.005) as lo, quantile_cont(l_extendedprice, 0.995) as hi from lineitem group by 1),
s as (select *, (hi - lo) / 15.0e0 as s from p)
select l_returnflag, round(lo, 6) as lo, round(hi, 6) as hi, round(s, 9) as scale, least(greatest(round_even(-lo / s, 0), 0), 15) as zero from s""")
def percentile_tails(spark, d):
    cells = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    return rounded(rounded(quantizers.calibrate(cells, ["l_returnflag"], 4, affine.ASYMMETRIC, policy=quantizers.Policy("percentile", 99.0)), 6, "lo", "hi"), 9, "scale")


@query(f"""with {CELLS}, p as (select vec_id, max(abs(x)) / 7.0e0 as s from cells group by 1),
y as (select vec_id, x, least(greatest(round_even(x / case when s = 0 then 1.0e0 else s end, 0), -7), 7) * case when s = 0 then 1.0e0 else s end as y from cells join p using (vec_id))
select vec_id, count(*) as n, round(avg((x - y) ** 2), 9) as mse, round(max(abs(x - y)), 9) as max_abs, round(max(abs(x - y)) / max(abs(x)), 6) as relative,
  round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as cosine from y group by vec_id""")
def roundtrip_error(spark, d):
    """Each embedding quantized to 4 bits and back. The groups of the parameters and of the errors are the same vectors, so
    the largest magnitude comes from the array itself and nothing is joined: one shuffle, of sums."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("scale", affine.usable(F.array_max(F.transform("v", lambda x: F.abs(x))) / 7.0))
    cells = v.select("vec_id", "scale", F.explode("v").alias("x"))
    y = affine.dequantize(affine.quantize(F.col("x"), F.col("scale"), F.lit(0.0), 4), F.col("scale"), F.lit(0.0))
    e = profile.errors(cells.withColumn("y", y), ["vec_id"], F.col("x"), F.col("y"))
    return rounded(rounded(e, 9, "mse", "max_abs"), 6, "relative", "cosine")


@query(f"""with {CELLS}, p as (select vec_id, max(abs(x)) / 7.0e0 as s from cells group by 1),
y as (select vec_id, x, least(greatest(round_even(x / case when s = 0 then 1.0e0 else s end, 0), -7), 7) * case when s = 0 then 1.0e0 else s end as y from cells join p using (vec_id)),
e as (select vec_id % 4 as bundle, vec_id, avg((x - y) ** 2) as mse, max(abs(x - y)) as m, max(abs(x - y)) / max(abs(x)) as r, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as c from y group by vec_id)
select bundle, round(avg(mse), 9) as mse, round(max(m), 9) as max_abs, round(max(r), 6) as relative, round(min(c), 6) as cosine from e group by 1""")
def bundle_error(spark, d):
    q = quantizers.quantize(embedding_cells(spark, d), [], 4, layout=quantizers.Layout("per_channel", "vec_id"))
    e = profile.errors(q, ["vec_id"], F.col("x"), F.col("y")).withColumn("bundle", F.col("vec_id") % 4)
    return rounded(rounded(profile.bundle_errors(e, ["bundle"]), 9, "mse", "max_abs"), 6, "relative", "cosine")


# transforms


@query("""with c as (select vec_id, cast(unnest(range(len(embedding))) as int) as dim, cast(unnest(embedding) as float) as x from embeddings),
p as (select vec_id, case when min(x) <= 0 and max(x) >= 0 then greatest(abs(min(x)), abs(max(x))) else max(x) - min(x) end as s, case when min(x) <= 0 and max(x) >= 0 then cast(0 as float) else min(x) end as z from c group by 1)
select vec_id, dim, round(cast((x - z) / case when s > 0 then s else cast(1 as float) end as double), 9) as y from c join p using (vec_id)""")
def normalize_channels(spark, d):
    n = transforms.normalize(embedding_cells(spark, d), ["vec_id"])
    return n.select("vec_id", "dim", F.round(F.col("y").cast("double"), 9).alias("y"))


def event_cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))


@query("""with c as (select user_id, event_id, ts, cast(round(value * 100) as bigint) as x from events)
select event_id, coalesce(x - lag(x) over w, 0) as delta, first_value(x) over w as anchor from c window w as (partition by user_id order by ts, event_id)""")
def delta_encode(spark, d):
    return transforms.difference(event_cents(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "delta", "anchor")


@query("select event_id, cast(round(value * 100) as bigint) as x from events")
def delta_decode(spark, d):
    """Each event's cents, from differences and anchors alone."""
    e = transforms.difference(event_cents(spark, d), ["user_id"], ["ts", "event_id"]).drop("x")
    return transforms.accumulate(e, ["user_id"], ["ts", "event_id"]).select("event_id", F.col("restored").alias("x"))


SPARSE = f"with {CELLS}, s as (select vec_id, dim, vec_id * 64 + dim as idx, x from cells where abs(x) >= 0.1)"


def sparse_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = embedding_cells(spark, d).withColumn("idx", F.col("vec_id") * 64 + F.col("dim"))
    return transforms.sparse(cells.withColumn("x", F.when(F.abs("x") >= 0.1, F.col("x")).otherwise(0.0)))


@query(f"{SPARSE} select idx, x from s")
def sparse_form(spark, d):
    return sparse_cells(spark, d).select("idx", "x")


@query(f"{SPARSE} select vec_id, idx, dim - coalesce(lag(dim) over (partition by vec_id order by dim), 0) as step from s")
def sparse_index_steps(spark, d):
    return transforms.index_steps(sparse_cells(spark, d), ["vec_id"], "dim").select("vec_id", "idx", "step")


@query(f"with {CELLS} select count(*) as n, round(sum(case when abs(x) >= 0.1 then x else 0 end), 6) as total from cells")
def sparse_decode(spark, d):
    sizes = table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"))
    coo = sparse_cells(spark, d).select("vec_id", F.col("dim").cast("long").alias("dim"), "x")
    return transforms.dense(coo, sizes, ["vec_id"], "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


@query(None)
def pca_ratio(spark, d):
    """Explained variance of each principal component of the embeddings, and the error of the restored rows."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    c = transforms.fit_components(df, "embedding", 0.9)
    back = transforms.restore(transforms.project(df, "embedding", c), c)
    e = back.select(F.explode(F.zip_with("embedding", "restored", lambda a, b: (a - b) * (a - b))).alias("e")).agg(F.avg("e").alias("mse"))
    ratio = spark.createDataFrame([(i, float(r)) for i, r in enumerate(c.ratio)], "component int, ratio double")
    return ratio.join(e.withColumn("component", F.lit(0)), "component", "left").select("component", F.round("ratio", 6).alias("ratio"), F.round("mse", 6).alias("mse"))


@query("""with m as (select var_pop(l_quantity) as a, var_pop(l_tax * 100) as c, covar_pop(l_quantity, l_tax * 100) as b from lineitem),
e as (select a + c as total, sqrt(((a - c) / 2) ** 2 + b ** 2) as r, (a + c) / 2 as h from m)
select cast(0 as int) as component, round((h + r) / total, 6) as ratio from e union all select 1, round((h - r) / total, 6) from e""")
def pca_pair(spark, d):
    """Explained variance of two columns, far from 0: eigenvalues of a 2 x 2 matrix."""
    df = table(spark, d, "lineitem").select(F.array(F.col("l_quantity") + 1e6, F.col("l_tax") * 100 + 1e6).alias("v"))
    c = transforms.fit_components(df, "v", 1.0)
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(c.ratio)], "component int, ratio double")


@query(None)
def effective_rank(spark, d):
    return spark.createDataFrame([(round(transforms.effective_rank(table(spark, d, "embeddings"), "embedding"), 6),)], "rank double")


@query("""with c as (select user_id, event_id, ts, cast(round(value * 100) as bigint) as x from events)
select event_id, x, first_value(x + 7) over w as anchor, coalesce(x - lag(x) over w, 0) as delta from c window w as (partition by user_id order by ts, event_id)""")
def transform_pipeline(spark, d):
    """Shift, then difference, and back: what is kept in between, and what comes back."""
    key, order = ["user_id"], ["ts", "event_id"]
    p = transforms.Pipeline().add("shift", lambda x: x.withColumn("x", F.col("x") + 7), lambda x: x.withColumn("x", F.col("x") - 7))
    p = p.add("difference", lambda x: transforms.difference(x, key, order).drop("x"), lambda x: transforms.accumulate(x, key, order).withColumnRenamed("restored", "x"))
    return p.inverse(p.forward(event_cents(spark, d))).select("event_id", "x", "anchor", "delta")


# symbols


@query("""with f as (select l_linenumber as symbol, count(*) as c from lineitem group by 1), t as (select sum(c) as n, count(*) as k from f),
s as (select symbol, c, greatest(1, cast(floor(c * 65536.0e0 / n) as bigint)) as f, k from f, t), g as (select 65536 - sum(f) as gap from s),
r as (select symbol, c, f, k, gap, row_number() over (order by c desc, symbol) - 1 as rk from s, g)
select symbol, c, cast(f + gap // k + case when rk < gap % k then 1 else 0 end as bigint) as f from r""")
def normalized_frequencies(spark, d):
    f = symbols.frequencies(table(spark, d, "lineitem").withColumn("stream", F.lit(0)), ["stream"], "l_linenumber")
    return symbols.normalized(f, ["stream"]).drop("stream")


@query(f"""with {STREAMS}, c as (select stream, symbol, count(*) as c from s group by all)
select stream, symbol, c, cast(coalesce(sum(c) over (partition by stream order by symbol rows between unbounded preceding and 1 preceding), 0) as bigint) as before from c""")
def cumulative_frequencies(spark, d):
    return symbols.cumulative(symbols.frequencies(streams(spark, d), ["stream"], "symbol"), ["stream"])


@query("""with e as (select user_id, event_id, event_type, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as new from events),
r as (select *, sum(new) over (partition by user_id order by event_id) as run from e)
select user_id, cast(run as bigint) as run, any_value(event_type) as symbol, min(event_id) as start, count(*) as length from r group by user_id, run""")
def run_lengths(spark, d):
    return symbols.runs(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("""with o as (select o_custkey % 3 as g, row_number() over (partition by o_custkey % 3 order by o_orderkey) - 1 as i, o_orderkey as x from orders union all
  select 9, o_orderkey, 5 + 3 * o_orderkey from orders), e as (select g, min_by(x, i) as s, (max_by(x, i) - min_by(x, i)) / cast(max(i) as double) as t from o group by g)
select g, cast(s as double) as start, round(t, 9) as step, count(*) as n, bool_and(x = s + i * t) as arithmetic from o join e using (g) group by g, s, t""")
def arithmetic_sequences(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    g = o.select((F.col("o_custkey") % 3).alias("g"), F.col("o_orderkey").alias("x"))
    g = g.withColumn("i", (F.row_number().over(W.partitionBy("g").orderBy("x")) - 1).cast("long")).select("g", "i", "x")
    g = g.unionByName(o.select(F.lit(9).cast("long").alias("g"), F.col("o_orderkey").alias("i"), (5 + 3 * F.col("o_orderkey")).alias("x")))
    return rounded(symbols.arithmetic(g.withColumn("x", F.col("x").cast("double")), ["g"], "i", "x"), 9, "step")


@query(f"""with {COLUMNS}, c as (select tensor_name, x, count(*) as c from t group by all), n as (select *, sum(c) over (partition by tensor_name) as n from c),
h as (select tensor_name, greatest(-sum(c / cast(n as double) * log2(c / cast(n as double))), 1e-9) as h from n group by 1),
s as (select *, h / sum(h) over () * (count(*) over () * 2) as s, count(*) over () as k from h),
e as (select *, least(floor(s), 6) as e, row_number() over (order by s - floor(s) desc, h desc, tensor_name) as rn from s)
select tensor_name, round(h, 6) as h, cast(2 + e + case when rn <= k * 2 - sum(e) over () then 1 else 0 end as int) as bits from e""")
def bit_allocation(spark, d):
    h = profile.value_entropy(column_tensors(table(spark, d, "lineitem"), NUMERIC), ["tensor_name"], "x")
    return rounded(symbols.allocate_bits(h, "tensor_name", 4), 6, "h")


@query("""with n as (select s_nationkey, s_suppkey, 1000 + s_nationkey as total, count(*) over (partition by s_nationkey) as k, row_number() over (partition by s_nationkey order by s_suppkey) as r from supplier)
select s_nationkey, s_suppkey, cast(total // k + case when r <= total % k then 1 else 0 end as bigint) as share from n""")
def shared_bytes(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_nationkey") + 1000).cast("long").alias("total"))
    return symbols.share_bytes(s, ["s_nationkey"], "s_suppkey", "total").drop("total")


@query("""with b as (select doc_id, octet_length(encode(text)) as n from documents), i as (select *, unnest(range(0, greatest(1, n), 1000)) as start from b)
select doc_id, cast(start // 1000 as int) as index, least(n - start, 1000) as size from i""")
def payload_chunks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))
    return symbols.chunks(t, "data", 1000).select("doc_id", "index", F.octet_length("part").cast("long").alias("size"))


@query("select doc_id, sha256(text) as sum from documents")
def checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sum"))


@query(None)
def crc_checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


# routing

NAMES = [
    "transformer.wte.weight", "lm_head.weight", "h.0.attn.q_proj.weight", "h.0.attn.k_proj.weight", "h.0.self.value.weight", "h.0.c_attn.weight", "h.0.out_proj.weight", "mlp.fc1.weight",
    "mlp.down_proj.weight", "mlp.gate_proj.weight", "proj.bias", "h.0.ln_1.weight", "layer_0.k_cache", "optimizer.exp_avg", "block.activation", "causal_mask", "score", "input_layernorm.weight", "final.norm.bias", "a.to_out.0",
]
NAME_SQL = "names as (select unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) as name)"


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


#: Roles in SQL, written out so that a wrong list of the engine's shows.
ROLE_SQL = r"""case when regexp_matches(lower(name), 'embed|wte|wpe') then 'embedding' when lower(name) like '%lm_head%' then 'lm_head'
  when regexp_matches(lower(name), 'q_proj|query|\.q\.|to_q') then 'attn_q_proj' when regexp_matches(lower(name), 'k_proj|key|\.k\.|to_k') then 'attn_k_proj'
  when regexp_matches(lower(name), 'v_proj|value|\.v\.|to_v') then 'attn_v_proj' when regexp_matches(lower(name), 'qkv|c_attn') then 'attn_qkv_proj'
  when regexp_matches(lower(name), 'o_proj|out_proj|c_proj|to_out') then 'attn_o_proj' when regexp_matches(lower(name), 'up_proj|fc1|dense_h_to_4h|wi|intermediate\.dense') then 'mlp_up_proj'
  when regexp_matches(lower(name), 'down_proj|fc2|dense_4h_to_h|wo|output\.dense') then 'mlp_down_proj' when lower(name) like '%gate\_proj%' escape '\' then 'mlp_gate_proj'
  when lower(name) like '%bias%' then 'bias' when regexp_matches(lower(name), 'norm|ln_') then 'norm' else 'other' end"""


@query(f"with {NAME_SQL} select name, {ROLE_SQL} as role from names")
def tensor_roles(spark, d):
    return names(spark).select("name", routing.tensor_role(F.col("name")).alias("role"))


@query(f"""with {NAME_SQL}, n as (select name, {ROLE_SQL} as role from names), r as (select name, role, row_number() over (order by sha256('7:' || name)) as k from n where role = 'other')
select name, role, 'role' as chosen_as from n where role <> 'other' union all select name, role, 'extra' from r where k <= 2""")
def sampled_names(spark, d):
    return routing.sampled_names(names(spark), "name", 7, 2)


@query(f"""with {NAME_SQL} select name, regexp_matches(lower(name), 'layer_?norm|rms_?norm|\\.ln_|^ln_|\\.norm|norm\\.(weight|bias)$') or length(name) * 128 <= 2048 as lossless from names""")
def lossless_names(spark, d):
    return names(spark).select("name", routing.lossless(F.col("name"), F.length("name") * 128).alias("lossless"))


@query(f"""with {CELLS}, t as (select vec_id % 8 as g, case when vec_id % 8 in (0, 3) and dim % 10 < 8 then 0 else x end as x from cells),
s as (select g, count(*) as n, avg(case when x = 0 then 1.0e0 else 0.0e0 end) as z, min(x) as lo from t group by g)
select g, case when g % 2 = 0 then 'EMBEDDING' else 'ACTIVATION' end as tensor_type, round(z, 6) as zero_share,
  case when g % 2 = 0 then n >= 4096 and z >= 0.30 else n >= 2048 and z >= 0.75 end as sparse, case when lo >= 0 then 'asymmetric' else 'symmetric' end as mode from s""")
def sparse_routes(spark, d):
    t = embedding_cells(spark, d).withColumn("g", F.col("vec_id") % 8)
    t = t.withColumn("x", F.when(F.col("g").isin(0, 3) & (F.col("dim") % 10 < 8), 0.0).otherwise(F.col("x")))
    s = t.groupBy("g").agg(F.count("*").alias("n"), F.avg((F.col("x") == 0).cast("double")).alias("zero_share"), F.min("x").alias("lo"))
    s = s.withColumn("tensor_type", F.when(F.col("g") % 2 == 0, "EMBEDDING").otherwise("ACTIVATION"))
    sparse = routing.sparse_route(F.col("tensor_type"), F.col("n"), F.col("zero_share"))
    return s.select("g", "tensor_type", F.round("zero_share", 6).alias("zero_share"), sparse.alias("sparse"), routing.activation_mode(F.col("lo")).alias("mode"))


#: Name, type of elements, axes (n is the number of embeddings, all of whose cells make up each), and what becomes of the values.
DECLARED = [
    ("token_embed.weight", "float32", "n,64", 0), ("optimizer.exp_avg", "float32", "n,64", 0), ("half.weight", "float16", "n,64", 0), ("causal", "float32", "n,64", 1), ("proj.bias", "float32", "n", 0),
    ("layer_0.k_cache", "float32", "1,n,1,64", 0), ("mlp.fc", "float32", "n,64", 0), ("relu", "float32", "n,64", 2), ("plain", "float32", "n,64", 0), ("past", "float32", "1,n,4,16", 0), ("odd", "float32", "n,1,1,64", 0), ("vector", "float32", "n", 0),
]
DECLARED_SQL = "declared as (select unnest(names) as tensor_name, unnest(dtypes) as dtype, unnest(shapes) as axes, unnest(kinds) as kind from (select " + ", ".join(
    f"[{', '.join(repr(t[i]) for t in DECLARED)}] as {n}" for i, n in enumerate(("names", "dtypes", "shapes", "kinds"))
) + ")), tensors as (select declared.*, list_transform(string_split(replace(axes, 'n', cast(e.n as varchar)), ','), lambda q: cast(q as bigint)) as shape from declared, (select count(*) as n from embeddings) e)"
KIND = "case kind when 1 then case when dim <= vec_id then 1.0e0 else 0.0e0 end when 2 then greatest(x - 0.1e0, 0.0e0) else x end"


@query(f"""with {CELLS}, {DECLARED_SQL}, v as (select tensor_name, dtype, shape, vec_id * 64 + dim as idx, {KIND} as x from tensors, cells),
m as (select *, avg(x) over (partition by tensor_name) as m, count(*) over (partition by tensor_name) as n from v),
s as (select tensor_name, any_value(dtype) as dtype, any_value(shape) as shape, any_value(n) as n, avg(case when abs(x) < 1e-6 then 1.0e0 else 0.0e0 end) as sparsity, sqrt(avg((x - m) ** 2)) as sd,
  avg((x - m) ** 3) / nullif(sqrt(avg((x - m) ** 2)) ** 3, 0) as skew, avg((x - m) ** 4) / nullif(avg((x - m) ** 2) ** 2, 0) as kurt,
  count(distinct x) filter (idx % greatest(1, n // 4096) = 0) as k, coalesce(bool_and(x in (0, 1) or isinf(x)) filter (idx % greatest(1, n // 4096) = 0), false) as plain from m group by tensor_name)
select tensor_name, case when regexp_matches(tensor_name, 'exp_avg|adam|moment|state|optimizer|velocity') then 'OPTIMIZER_STATE' when dtype <> 'float32' then 'MIXED_PRECISION' when contains(tensor_name, 'embed') then 'EMBEDDING'
  when len(shape) >= 2 and (k = 1 or k <= 4 and plain) then 'MASK' when contains(tensor_name, 'bias') then 'BIAS' when len(shape) = 4 and regexp_matches(tensor_name, '[kv]_cache|key|value') then 'KV_CACHE'
  when regexp_matches(tensor_name, 'weight|lm_head|mlp|attn') then 'WEIGHT' when sparsity > 0.5 then 'ACTIVATION'
  when len(shape) = 2 and n >= 16 and sd > 1e-12 and abs(skew) <= 0.5 and kurt between 2.0 and 4.5 then 'WEIGHT'
  when len(shape) >= 4 and len(list_filter(shape[2:], lambda q: q >= 64)) > 0 and len(list_filter(shape[2:-2], lambda q: q between 2 and 128)) > 0 and shape[-1] <= 256 then 'KV_CACHE'
  when len(shape) >= 4 then 'ACTIVATION' else 'UNKNOWN' end as tensor_type from s""")
def detected_types(spark, d):
    n = table(spark, d, "embeddings").count()
    rows = [(name, dtype, [n if a == "n" else int(a) for a in axes.split(",")], kind) for name, dtype, axes, kind in DECLARED]
    t = spark.createDataFrame(rows, "tensor_name string, dtype string, shape array<long>, kind int")
    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("tensor_name"), F.lit(r[3]).alias("kind")) for r in rows]))
    v = embedding_cells(spark, d).select("*", each.alias("t")).select("t.*", "vec_id", "dim", "x")
    v = v.select("tensor_name", (F.col("vec_id") * 64 + F.col("dim")).alias("idx"), F.expr(KIND.replace("e0", "D")).alias("x"))
    key = ["tensor_name"]
    s = profile.profile(v, key).select(*key, "n", "sparsity")
    s = s.join(profile.gaussian(v, key).select(*key, "near_gaussian"), key).join(routing.mask_values(v, key), key).join(t.drop("kind"), key)
    return routing.detect(s).select("tensor_name", "tensor_type")


@query("""with t as (select unnest(['float32', 'int8', 'complex64', 'bfloat16', 'object', 'float32']) as dtype, unnest([5, 5, 5, 5, 5, 0]) as n),
r as (select case when n = 0 then 'empty_tensor' when not regexp_full_match(dtype, '(bool|u?int(8|16|32|64)|b?float(16|32|64))') then 'unsupported_dtype:' || dtype end as reason from t)
select reason, count(*) as n from r where reason is not null group by 1""")
def skip_reasons(spark, d):
    t = spark.createDataFrame([("float32", 5), ("int8", 5), ("complex64", 5), ("bfloat16", 5), ("object", 5), ("float32", 0)], "dtype string, n int")
    return reports.reasons(t.select(routing.skip_reason(F.col("n"), F.col("dtype")).alias("reason")))


# fine-tuned models

GROUPS = """b as (select vec_id, cast(unnest(range(len(embedding))) as int) as dim, cast(unnest(embedding) as float) as b from embeddings),
f as (select vec_id, dim, vec_id % 4 as g, b, cast(b + case vec_id % 4 when 0 then 0.0e0 when 1 then case when dim = 0 then p else 0.0e0 end else p end as float) as t
  from (select *, ((vec_id * 31 + dim * 17) % 101 - 50) / 50000.0e0 as p from b)),
diff as (select *, t - b as d from f)"""


def tuned_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Base and fine-tuned embeddings: four tensors by vec_id, one unchanged, one in one column only, two all over."""
    base = embedding_cells(spark, d).withColumn("g", F.col("vec_id") % 4)
    p = ((F.col("vec_id") * 31 + F.col("dim") * 17) % 101 - 50) / F.lit(50000.0)
    shift = F.when(F.col("g") == 0, 0.0).when((F.col("g") == 1) & (F.col("dim") != 0), 0.0).otherwise(p)
    return base, base.withColumn("x", (F.col("x") + shift).cast("float"))


@query(f"""with {GROUPS}, s as (select g, count(*) as n, avg(case when abs(cast(d as double)) < 1e-7 then 1.0e0 else 0.0e0 end) as none, max(abs(cast(d as double))) as mx, avg(abs(cast(d as double))) as ma, stddev_pop(abs(cast(d as double))) as sa from diff group by g),
r as (select *, case when mx < 1e-8 then 'zero' when n >= 1024 and g <> 3 and ma >= 1e-10 and sa / ma < 2 then 'sign_scale' when none > 0.85 and n >= 512 then 'sparse' when n < 512 then 'lossless' else 'quantize' end as route from s)
select g, n, round(none, 6) as share_none, round(mx, 9) as max_abs, round(ma, 9) as mean_abs, round(sa, 9) as std_abs, route, case route when 'sign_scale' then 1 when 'sparse' then 4 when 'quantize' then 2 else 0 end as bits from r""")
def delta_routes(spark, d):
    base, tuned = tuned_cells(spark, d)
    diff = finetune.differences(base, tuned, ["g", "vec_id", "dim"])
    return rounded(rounded(finetune.analyze(diff, ["g"], F.col("g") != 3), 9, "max_abs", "mean_abs", "std_abs"), 6, "share_none")


@query(f"with {GROUPS} select vec_id, round(avg(abs(cast(d as double))), 9) as scale, cast(count_if(d >= 0) as bigint) as up, count(*) as n from diff group by vec_id")
def delta_signs(spark, d):
    base, tuned = tuned_cells(spark, d)
    diff = finetune.differences(base, tuned, ["g", "vec_id", "dim"])
    return rounded(finetune.sign_scale(diff, ["vec_id"]), 9, "scale")


@query(f"""with {GROUPS}, s as (select vec_id, avg(abs(cast(d as double))) as s from diff where g = 2 group by 1),
sp as (select max(abs(cast(d as double))) / 7.0e0 as s from diff where g = 1 and abs(d) >= cast(1e-7 as float)), q as (select vec_id, max(abs(cast(d as double))) / 1.0e0 as s from diff where g = 3 group by 1),
a as (select g, t, b, case g when 0 then 0.0e0 when 1 then case when abs(d) >= cast(1e-7 as float) then least(greatest(round_even(d / sp.s, 0), -7), 7) * sp.s else 0.0e0 end
  when 2 then case when d >= 0 then s.s else -s.s end else least(greatest(round_even(d / q.s, 0), -1), 1) * q.s end as a from diff left join s using (vec_id) left join q using (vec_id), sp),
e as (select g, cast(t as double) as t, cast(cast(b + cast(a as float) as float) as double) as y from a)
select g, count(*) as n, round(max(abs(t - y)), 5) as max_abs, round(sum(t * y) / sqrt(sum(t * t) * sum(y * y)), 6) as cosine from e group by g""")
def delta_apply(spark, d):
    base, tuned = tuned_cells(spark, d)
    diff = finetune.differences(base, tuned, ["g", "vec_id", "dim"])
    out = None
    for g, route in enumerate(("zero", "sparse", "sign_scale", "quantize")):
        a = finetune.apply(finetune.approximate(diff.filter(F.col("g") == g), ["vec_id"], ["g"], route))
        part = a.select("g", (F.col("base") + F.col("d")).cast("float").cast("double").alias("t"), F.col("tuned").cast("double").alias("y"))
        out = part if out is None else out.unionByName(part)
    return rounded(rounded(profile.errors(out, ["g"], F.col("t"), F.col("y")), 5, "max_abs"), 6, "cosine").select("g", "n", "max_abs", "cosine")


@query("""select coalesce(b.n, f.n) as tensor_name, case when b.n is null then 'added' when f.n is null then 'removed' else 'shared' end as membership
from (select c_custkey as n from customer) b full join (select c_custkey + 100 as n from customer) f using (n)""")
def delta_membership(spark, d):
    c = table(spark, d, "customer")
    return finetune.membership(c.select(F.col("c_custkey").alias("tensor_name")), c.select((F.col("c_custkey") + 100).alias("tensor_name")))


@query("select c_custkey as tensor_name from customer where c_custkey not in (select s_suppkey from supplier)")
def missing_records(spark, d):
    return finetune.missing_records(table(spark, d, "customer").select(F.col("c_custkey").alias("tensor_name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("tensor_name")))


@query("select o_custkey as name, count(*) as n from orders group by 1 having count(*) > 1")
def duplicate_names(spark, d):
    return routing.duplicates(table(spark, d, "orders").select(F.col("o_custkey").alias("name")), "name")


@query("select o_custkey as name, max(o_orderkey) as seq from orders group by 1")
def last_record_wins(spark, d):
    return routing.last_wins(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq")), "name", "seq")


# reports

RESULT = {
    "benchmark_name": "'b' || cast(p_partkey as {s})",
    "tensor_name": "p_name",
    "tensor_type": "p_type",
    "model_id": "case when p_size % 5 = 0 then '' else p_brand end",
    "model_revision": "'r' || cast(p_size % 2 as {s})",
    "raw_bytes": "cast(p_size * 512 as bigint)",
    "compressed_bytes": "cast(p_size * 100 + p_partkey % 17 as bigint)",
    "container_bytes": "case when p_partkey % 4 = 0 then cast(p_size * 110 * (p_partkey % 8) as bigint) end",
    "container_overhead_bytes": "case when p_partkey % 4 = 0 then cast(p_size % 13 as bigint) end",
    "payload_bytes": "cast(p_size * 90 as bigint)",
    "metadata_bytes": "cast(p_partkey % 90 as bigint)",
    "header_bytes": "cast(64 as bigint)",
    "zstd_raw_bytes": "case when p_partkey % 3 > 0 then cast(p_size * 130 as bigint) end",
    "zstd_quantized_bytes": "case when p_partkey % 5 > 0 then cast(p_size * 99 + p_partkey % 31 as bigint) end",
    "compression_ratio": "p_size * 512.0e0 / (p_size * 100 + p_partkey % 17)",
    "mse": "p_partkey % 10 / 1000.0e0",
    "max_abs_error": "p_partkey % 10 / 100.0e0",
    "relative_error": "p_partkey % 10 / 200.0e0",
    "cosine_similarity": "case when p_partkey % 11 > 0 then 1 - p_partkey % 100 / 1000.0e0 end",
    "encode_rate": "p_retailprice * 1000",
    "decode_rate": "p_retailprice * 3000",
    "exact_kind": "case p_partkey % 6 when 0 then 'const' when 1 then 'rans' end",
}


def result_sql(kind: str) -> str:
    return "select " + ", ".join(f"{v.format(s=kind)} as {k}" for k, v in RESULT.items()) + " from part"


RESULTS = f"r as ({result_sql('varchar')})"
CURRENT = f"cur as ({result_sql('varchar').replace('p_retailprice * 1000', 'p_retailprice * (850 + p_partkey % 200)').replace('p_partkey % 10 / 1000.0e0', 'p_partkey % 10 / (950.0e0 - p_partkey % 100)').replace("'b' || cast", "case when p_partkey % 50 = 0 then 'new' else 'b' end || cast")})"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows made from the part table."""
    p = table(spark, d, "part")
    return p.select(*[F.expr(v.format(s="string").replace("e0", "D")).alias(k) for k, v in RESULT.items()])


def current_results(spark: SparkSession, d: str) -> DataFrame:
    p = results(spark, d).withColumn("k", F.substring("benchmark_name", 2, 20).cast("long"))
    p = p.withColumn("benchmark_name", F.when(F.col("k") % 50 == 0, F.concat(F.lit("new"), "k")).otherwise(F.col("benchmark_name")))
    p = p.withColumn("encode_rate", F.col("encode_rate") / 1000 * (850 + F.col("k") % 200))
    return p.withColumn("mse", F.col("k") % 10 / (950.0 - F.col("k") % 100)).drop("k")


def _aggregate_sql() -> str:
    def ratio(a: str, b: str) -> str:
        return f"cast({a} as double) / nullif({b}, 0)"

    m = [
        "count(*) as rows", "cast(sum(raw_bytes) as bigint) as raw_bytes_total", "cast(sum(eff) as bigint) as compressed_bytes_total", "cast(sum(zstd_raw_bytes) as bigint) as zstd_raw_bytes_total",
        "cast(sum(zstd_quantized_bytes) as bigint) as zstd_quantized_bytes_total", f"round({ratio('sum(raw_bytes)', 'sum(eff)')}, 6) as aggregate_compression_ratio", f"round({ratio('sum(raw_bytes)', 'sum(zstd_raw_bytes)')}, 6) as aggregate_zstd_raw_ratio",
        f"round({ratio('sum(raw_bytes)', 'sum(zstd_quantized_bytes)')}, 6) as aggregate_zstd_quantized_ratio", "round(max(max_abs_error), 6) as max_abs_error_max", "round(max(relative_error), 6) as relative_error_max", "round(quantile_cont(cosine_similarity, 0.05), 6) as p5_cosine_similarity",
    ]
    for name, c in (("compression_ratio", f"coalesce({ratio('raw_bytes', 'eff')}, 0)"), ("mse", "mse"), ("cosine_similarity", "cosine_similarity"), ("encode_rate", "encode_rate"), ("decode_rate", "decode_rate"), ("overhead_bytes", '"over"')):
        m += [f"round(avg({c}), 6) as mean_{name}", f"round(median({c}), 6) as median_{name}"]
    for o in ("raw", "quantized"):
        z, s = f"(zstd_{o}_bytes - eff)", ratio(f"(zstd_{o}_bytes - eff)", f"zstd_{o}_bytes")
        m += [f"cast(coalesce(count_if({z} > 0), 0) as bigint) as wins_vs_zstd_{o}", f"round(avg({z}), 6) as mean_saved_vs_zstd_{o}", f"round(median({z}), 6) as median_saved_vs_zstd_{o}", f"round(avg({s}), 6) as mean_share_saved_vs_zstd_{o}", f"round(median({s}), 6) as median_share_saved_vs_zstd_{o}"]
    return f"""with {RESULTS}, e as (select *, coalesce(nullif(container_bytes, 0), compressed_bytes) as eff, coalesce(container_overhead_bytes, metadata_bytes + header_bytes) as "over",
  coalesce(nullif(model_id, ''), 'synthetic') as model, model_revision as revision from r)
select model, revision, tensor_type, case when grouping(model) = 0 then 'model' when grouping(tensor_type) = 0 then 'type' else 'run' end as level, {', '.join(m)}
from e group by grouping sets ((model, revision), (tensor_type), ())"""


@query(_aggregate_sql())
def bench_aggregates(spark, d):
    a = reports.aggregates(results(spark, d))
    return rounded(a, 6, *[c for c, t in a.dtypes if t == "double"])


@query(f"""with {RESULTS}, {CURRENT}, j as (select coalesce(r.benchmark_name, cur.benchmark_name) as name, r.benchmark_name as rb, cur.benchmark_name as cb, list_filter([case when r.benchmark_name is null then 'missing baseline' end,
  case when cur.compression_ratio < r.compression_ratio * 0.95e0 then 'compression ratio' end, case when cur.mse > r.mse * 1.1e0 then 'mse' end, case when cur.max_abs_error > r.max_abs_error * 1.1e0 then 'max abs error' end,
  case when cur.encode_rate < r.encode_rate * 0.9e0 then 'encode rate' end, case when cur.decode_rate < r.decode_rate * 0.9e0 then 'decode rate' end], lambda f: f is not null) as f from cur left join r on r.benchmark_name = cur.benchmark_name)
select name as benchmark_name, unnest(f) as failure from j""")
def bench_compare(spark, d):
    return reports.compare(results(spark, d), current_results(spark, d))


@query(f"""with {RESULTS}, e as (select benchmark_name, coalesce(nullif(container_bytes, 0), compressed_bytes) as eff, zstd_quantized_bytes as zq, zstd_raw_bytes as zr from r where zstd_quantized_bytes is not null)
select benchmark_name, eff - zq as loss_quantized, eff - coalesce(zr, 0) as loss_raw from e order by 2 desc, 3 desc, 1 limit 10""")
def bench_worst(spark, d):
    return reports.worst_vs_quantized(results(spark, d), 10).select("benchmark_name", "loss_quantized", "loss_raw")


@query(f"""with {RESULTS}, {CURRENT} select cur.benchmark_name, cur.tensor_type, r.compressed_bytes - cur.compressed_bytes + cur.raw_bytes as saved from cur join r using (benchmark_name)
where cur.tensor_type in (select min(tensor_type) from r union all select max(tensor_type) from r) order by 3 desc, 2 desc, 1 desc limit 10""")
def bench_spotlights(spark, d):
    r = results(spark, d)
    types = list(r.agg(F.min("tensor_type"), F.max("tensor_type")).first())
    c = current_results(spark, d).withColumn("compressed_bytes", F.col("compressed_bytes") - F.col("raw_bytes"))
    return reports.spotlight_deltas(r, c, types, 10).select("benchmark_name", "tensor_type", "saved")


#: Whether a row is exact, and the bytes of its record with the texts around it.
EXACT_SQL = "case when exact_kind is not null then exact_kind in ('raw', 'const', 'aseq', 'bseq', 'lossless', 'constant', 'sequence', 'along', 'bytes', 'integers', 'mask_constant', 'mask_triangle', 'mask_palette', 'mask_bits', 'mask_runs') else mse = 0 and max_abs_error = 0 and relative_error = 0 end"
STORED_SQL = """48 + payload_bytes + length('{"chunk_count":1,"chunk_lengths":[' || payload_bytes || '],"header":{"__bytes__":true,"data":"' || repeat('A', 88) || '"},"metadata":{"__bytes__":true,"data":"' || repeat('A', 4 * cast((metadata_bytes + 2) // 3 as int))
  || '"},"name":"' || tensor_name || '","original_nbytes":' || raw_bytes || ',"record_id":0}') + length('{"index":0,"length":' || payload_bytes || ',"record_id":0}')"""


@query(f"""with {RESULTS}, e as (select benchmark_name, cast(case when container_bytes is not null then container_bytes when raw_bytes <= 4096 and ({EXACT_SQL}) then {STORED_SQL} else compressed_bytes end as bigint) as eff,
  zstd_raw_bytes as zr, zstd_quantized_bytes as zq from r where tensor_type in (select min(tensor_type) from r union all select max(tensor_type) from r))
select benchmark_name, eff from e order by case when zr <> 0 then eff - zr end desc nulls last, case when zq <> 0 then eff - zq end desc nulls last, eff desc, benchmark_name limit 10""")
def bench_spotlight_losses(spark, d):
    r = results(spark, d)
    types = list(r.agg(F.min("tensor_type"), F.max("tensor_type")).first())
    return reports.spotlights(r, types, 10).select("benchmark_name", "eff")


@query(f"""with {RESULTS}, t as (select coalesce(container_overhead_bytes, metadata_bytes + header_bytes) as o, coalesce(nullif(container_bytes, 0), compressed_bytes) as e from r where raw_bytes <= 8192
  and {EXACT_SQL}), s as (select o, coalesce(cast(o as double) / nullif(e, 0), 0) as s from t)
select count(*) as rows, round(avg(s), 6) as mean_share, round((list_sort(list(s)))[count(*) // 2 + 1], 6) as median_share, round(avg(o), 6) as mean_overhead from s""")
def bench_tiny_cohort(spark, d):
    return rounded(reports.tiny_cohort(results(spark, d), 8192), 6, "mean_share", "median_share", "mean_overhead")


@query(f"""with {RESULTS}, k as (select p_name as t, cast(sum(p_size * 3) as bigint) as s, cast(sum(p_size) as bigint) as p from part where p_size > 25 group by 1)
select benchmark_name, coalesce(s, container_bytes) as container_bytes, coalesce(s - p, container_overhead_bytes) as container_overhead_bytes from r left join k on r.tensor_name = k.t""")
def bench_container_metrics(spark, d):
    k = table(spark, d, "part").filter("p_size > 25").select(F.col("p_name").alias("tensor_name"), (F.col("p_size") * 3).cast("long").alias("storage_bytes"), F.col("p_size").cast("long").alias("payload_bytes"))
    return reports.with_container(results(spark, d), k).select("benchmark_name", "container_bytes", "container_overhead_bytes")


# codec


def embedding_tensors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a table of tensors: chunks of up to 256 vectors of one float32 matrix per vec_id div 1000."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 1000).alias("t"), F.floor(F.col("vec_id") / 256).cast("int").alias("c"))
    rows = e.groupBy("t", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]).alias("rows"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t, c, rows in zip(*(x.to_pylist() for x in b.columns)):
                a = np.array(rows, np.float32)
                cols = {"t": pa.array([t]), "c": pa.array([c], pa.int32()), "n": pa.array([len(a)], pa.int64()), "data": pa.array([a.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(cols)

    p = rows.mapInArrow(pack, "t long, c int, n long, data binary")
    whole = p.groupBy("t").agg(F.sum("n").alias("rows"), F.count("*").cast("int").alias("chunks"), F.min("c").alias("c0"), F.sort_array(F.collect_list(F.struct("c", "n"))).alias("parts"))
    j = p.join(whole, "t")
    before = F.aggregate(F.filter("parts", lambda x: x["c"] < F.col("c")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    at = F.size(F.filter("parts", lambda x: x["c"] < F.col("c")))
    return j.select(F.concat(F.lit("embed."), F.col("t").cast("string")).alias("tensor_name"), F.lit("float32").alias("dtype"), F.array("rows", F.lit(64).cast("long")).alias("shape"), at.alias("chunk"), "chunks", before.alias("first"), "data")


TENSOR_SQL = "with t as (select 'embed.' || cast(vec_id // 1000 as varchar) as tensor_name, count(*) as n from embeddings group by 1)"
#: The same rows in SQL: sums of the source's cells, plain and weighted by their places.
ROW_SQL = f"""with {CELLS}, v as (select vec_id, sum(x) as total, sum(x * (dim + 1)) as weighted, max(x) as top from cells group by 1)
select 'embed.' || cast(vec_id // 1000 as varchar) as tensor_name, row_number() over (partition by vec_id // 1000 order by vec_id) - 1 as row, round(total, 6) as total, round(weighted, 5) as weighted, top from v"""


def vectors(df: DataFrame) -> DataFrame:
    """A table of float32 tensors of 64 columns to its rows: (tensor_name, row, v)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, first, data in zip(b.column("tensor_name").to_pylist(), b.column("first").to_pylist(), b.column("data")):
                x = np.frombuffer(data.as_buffer(), np.float32)
                n = len(x) // 64
                v = pa.ListArray.from_arrays(np.arange(0, 64 * n + 1, 64, dtype=np.int32), pa.array(x.astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(first + np.arange(n), pa.int64()), v], ["tensor_name", "row", "v"])

    return df.select("tensor_name", "first", "data").mapInArrow(run, "tensor_name string, row long, v array<double>")


def row_sums(df: DataFrame) -> DataFrame:
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vectors(df).select("tensor_name", "row", F.round(total, 6).alias("total"), F.round(weighted, 5).alias("weighted"), F.array_max("v").alias("top"))


@query(f"{TENSOR_SQL} select tensor_name, n * 64 as n, n * 64 as within, true as smaller from t")
def codec_roundtrip(spark, d):
    """Encoded to 8 bits and back: cells within half a step of the source's, and under half of the bytes."""
    from loomspan.config import Config
    from loomspan.operators import compress

    df = embedding_tensors(spark, d)
    records = compress.encode(df, Config(bits=8))
    j = vectors(df).join(vectors(compress.decode(records)).withColumnRenamed("v", "y"), ["tensor_name", "row"])
    most, off = F.array_max(F.transform("v", lambda x: F.abs(x))), F.zip_with("v", "y", lambda x, y: F.abs(x - y))
    rows = j.select("tensor_name", F.explode(off).alias("off"))
    half = vectors(df).groupBy("tensor_name").agg((F.max(most) / 254).alias("half"))
    e = rows.join(half, "tensor_name").groupBy("tensor_name").agg(F.count("*").alias("n"), F.count_if(F.col("off") <= F.col("half") * 1.01).alias("within"))
    return e.join(compress.summary(records), "tensor_name").select("tensor_name", "n", "within", (F.col("ratio") > 2).alias("smaller"))


@query(ROW_SQL)
def codec_lossless(spark, d):
    """Exactly encoded and back: sums of the decoded rows."""
    from loomspan.config import Config
    from loomspan.operators import compress

    return row_sums(compress.decode(compress.encode(embedding_tensors(spark, d), Config(lossless=True))))


@query(f"""with {CELLS}, f as (select *, vec_id // 1000 as t, min(vec_id // 256) over (partition by vec_id // 1000) as c0 from cells), g as (select * from f where vec_id // 256 = c0),
m as (select *, avg(x) over (partition by t) as m from g), s as (select t, count(*) as n, sqrt(avg((x - m) ** 2)) as sd, avg((x - m) ** 3) as k3, avg((x - m) ** 4) as k4, avg(case when abs(x) < 1e-6 then 1.0e0 else 0.0e0 end) as zero from m group by t)
select name || '.' || cast(t as varchar) as tensor_name, case name when 'embed' then 2 when 'adam' then 4 when 'mlp' then 0 when 'bias' then 6
  else case when zero > 0.5 then 3 when n >= 16 and sd > 1e-12 and abs(k3 / sd ** 3) <= 0.5 and k4 / sd ** 4 between 2.0 and 4.5 then 0 else 5 end end as tensor_type
from s, (select unnest(['embed', 'adam', 'mlp', 'bias', 'plain']) as name)""")
def codec_types(spark, d):
    """Codes of the types of the embeddings under five names, one of which says nothing."""
    from loomspan.operators import compress

    e = embedding_tensors(spark, d).filter("chunk = 0")
    named = e.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ("embed", "adam", "mlp", "bias", "plain")])))
    named = named.withColumn("tensor_name", F.concat("n", F.substring("tensor_name", 6, 30))).drop("n")
    return named.mapInArrow(compress._types, "tensor_name string, tensor_type int")


@query("""with l as (select l_returnflag, cast(l_linenumber as bigint) as symbol, row_number() over (partition by l_returnflag, l_orderkey // 20000 order by l_orderkey, l_linenumber) as i from lineitem)
select l_returnflag, symbol, count(*) as n, cast(sum(i) as bigint) as places, true as near_bound from l group by all""")
def rans_roundtrip(spark, d):
    """Line numbers of each return flag through the range coder, in chunks by the order's number: what is decoded, and where it is."""
    li = table(spark, d, "lineitem").select("l_returnflag", F.floor(F.col("l_orderkey") / 20_000).alias("chunk"), "l_orderkey", "l_linenumber")

    def run(pdf):
        import numpy as np
        import pandas as pd

        from loomspan.codec import rans

        values = pdf.sort_values(["l_orderkey", "l_linenumber"])["l_linenumber"].to_numpy()
        model, places = rans.Model.of(values)
        data = rans.encode(places, model)
        again = rans.Model.from_bytes(model.to_bytes())
        back = again.symbols[rans.decode(data, again)]
        near = len(data) <= 1.1 * model.bits(np.bincount(places)) * len(values) / 8 + 64
        out = pd.DataFrame({"symbol": back, "i": np.arange(1, len(back) + 1)}).groupby("symbol")["i"].agg(n="count", places="sum").reset_index()
        return out.assign(l_returnflag=pdf["l_returnflag"].iloc[0], near=near)[["l_returnflag", "symbol", "n", "places", "near"]]

    parts = li.groupBy("l_returnflag", "chunk").applyInPandas(run, "l_returnflag string, symbol long, n long, places long, near boolean")
    return parts.groupBy("l_returnflag", "symbol").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.bool_and("near").alias("near_bound"))


@query("""with e as (select user_id, event_id % 8 as v, row_number() over (partition by user_id order by event_id) - 1 as i from events),
b as (select user_id, i * 3 + j as p, (v >> j) & 1 as bit from e, (select unnest([0, 1, 2]) as j)),
y as (select user_id, p // 8 as k, cast(sum(bit << (p % 8)) as int) as byte from b group by all),
h as (select user_id, string_agg(printf('%02x', byte), '' order by k) as packed from y group by 1)
select user_id, count(*) as n, cast(sum(v) as bigint) as total, any_value(packed) as packed from e join h using (user_id) group by 1""")
def pack_bits(spark, d):
    """Event numbers modulo 8 in 3 bits each, by user: the bytes, and the sum of what is unpacked from them."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 8).alias("v"))

    def run(pdf):
        import pandas as pd

        from loomspan.codec import bits

        v = pdf.sort_values("event_id")["v"].to_numpy()
        data = bits.pack(v, 3)
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "n": [len(v)], "total": [int(bits.unpack(data, 3, len(v)).sum())], "packed": [data.hex()]})

    return e.groupBy("user_id").applyInPandas(run, "user_id long, n long, total long, packed string")


@query(ROW_SQL)
def container_roundtrip(spark, d):
    """Written to one container file and read again by the data source: sums of the rows."""
    from loomspan.config import Config
    from loomspan.operators import compress
    from loomspan.sources import tables

    df = embedding_tensors(spark, d)
    path = _scratch(spark, "container.qnc")
    compress.write_container(compress.encode(df, Config(lossless=True)), path)
    back = tables.read_tensors(spark, path)
    back = back.select(F.split("tensor_name", "#")[0].alias("tensor_name"), F.coalesce(F.try_element_at(F.split("tensor_name", "#"), F.lit(2)).cast("int"), F.lit(0)).alias("chunk"), "data")
    return row_sums(back.join(df.select("tensor_name", "chunk", "first"), ["tensor_name", "chunk"]))


@query(f"{TENSOR_SQL} select tensor_name, n * 64 as n, true as closer from t")
def finetune_roundtrip(spark, d):
    """Embeddings scaled by a thousandth kept as differences: what comes back is nearer to them than the base is."""
    from loomspan.operators import compress, finetune_codec

    base = embedding_tensors(spark, d)

    def scale(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = [(np.frombuffer(x.as_buffer(), np.float32) * np.float32(1.001)).tobytes() for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(data, pa.binary())], b.schema.names)

    tuned = base.mapInArrow(scale, base.schema)
    back = finetune_codec.restore(base, finetune_codec.compress(base, tuned))
    near, far = compress.errors(tuned, back), compress.errors(tuned, base).select(F.col("tensor_name").alias("_n"), F.col("mse").alias("far"))
    return near.join(far, F.col("tensor_name") == F.col("_n")).select("tensor_name", "n", (F.col("mse") < F.col("far")).alias("closer"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    path = f"{root.rstrip('/')}/loomspan/{uuid.uuid4().hex}/{name}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path
