"""Which tensor is what, and how it is treated: types, roles, predicates and samples from names, shapes and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.cells import beside
from loomspan.operators.profile import any_of

#: The codes of the tensor types.
TYPES = {
    "WEIGHT": 0,
    "KV_CACHE": 1,
    "EMBEDDING": 2,
    "ACTIVATION": 3,
    "OPTIMIZER_STATE": 4,
    "UNKNOWN": 5,
    "BIAS": 6,
    "MIXED_PRECISION": 7,
    "MASK": 8,
}
#: Parts of names that tell a type.
OPTIMIZER_NAMES = ("exp_avg", "exp_avg_sq", "adam", "momentum", "moments", "state", "optimizer", "velocity")
KV_NAMES = ("k_cache", "v_cache", "key", "value")
WEIGHT_NAMES = ("weight", "lm_head", "mlp", "attn")
NORM_NAMES = ("layernorm", "layer_norm", "rmsnorm", "rms_norm")
#: Parts of names that tell a role, in the order in which they are tried.
ROLES = (
    ("embedding", ("embed", "wte", "wpe")),
    ("lm_head", ("lm_head",)),
    ("attn_q_proj", ("q_proj", "query", ".q.", "to_q")),
    ("attn_k_proj", ("k_proj", "key", ".k.", "to_k")),
    ("attn_v_proj", ("v_proj", "value", ".v.", "to_v")),
    ("attn_qkv_proj", ("qkv", "c_attn")),
    ("attn_o_proj", ("o_proj", "out_proj", "c_proj", "to_out")),
    ("mlp_up_proj", ("up_proj", "fc1", "dense_h_to_4h", "wi", "intermediate.dense")),
    ("mlp_down_proj", ("down_proj", "fc2", "dense_4h_to_h", "wo", "output.dense")),
    ("mlp_gate_proj", ("gate_proj",)),
    ("bias", ("bias",)),
    ("norm", ("norm", "ln_", "layernorm")),
)
LOSSLESS_BYTES = 2048


def has_any(name: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(name)
    return any_of([low.contains(p) for p in parts])


def tensor_role(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for role, parts in ROLES:
        out = out.when(has_any(name, parts), role)
    return out.otherwise("other")


def kv_shape(shape: Column) -> Column:
    """A shape that a cache of keys and values may have: 4 axes, one long, a middle one of head size, the last not wide."""
    inner = F.slice(shape, 2, F.greatest(F.lit(0), F.size(shape) - 2))
    rest = F.slice(shape, 2, F.greatest(F.lit(0), F.size(shape) - 1))
    return (F.size(shape) >= 4) & F.exists(rest, lambda d: d >= 64) & F.exists(inner, lambda d: d.between(2, 128)) & (F.element_at(shape, -1) <= 256)


def mask_values(cells: DataFrame, keys: list[str], idx: str = "idx", x: str = "x", most: int = 4096) -> DataFrame:
    """constant_or_mask of each tensor, from an even sample: four values at most, all one or all of 0, 1 and infinities."""
    size = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
    s = beside(cells, size, keys).filter(F.pmod(F.col(idx), F.greatest(F.lit(1), F.floor(F.col("_n") / most))) == 0)
    plain = F.col(x).isin(0.0, 1.0) | (F.abs(x) == float("inf"))
    # the sample has about most cells, so the distinct values of a tensor are bounded
    out = s.groupBy(*keys).agg(F.count_distinct(x).alias("d"), F.bool_and(plain).alias("plain"))
    return out.select(*keys, ((F.col("d") == 1) | (F.col("d") <= 4) & F.col("plain")).alias("constant_or_mask"))


def detect(tensors: DataFrame) -> DataFrame:
    """tensors (tensor_name, dtype, shape, n, sparsity, near_gaussian, constant_or_mask) with tensor_type.

    The rules run in order: empty, optimizer names, other types than float32, embedding names, masks, bias names, cache
    names of 4 axes, weight names, sparse values, normal matrices, then shapes.
    """
    name, ndim = F.coalesce(F.col("tensor_name"), F.lit("")), F.size("shape")
    return tensors.withColumn(
        "tensor_type",
        F.when(F.col("n") == 0, "UNKNOWN")
        .when(has_any(name, OPTIMIZER_NAMES), "OPTIMIZER_STATE")
        .when(F.col("dtype") != "float32", "MIXED_PRECISION")
        .when(has_any(name, ("embed",)), "EMBEDDING")
        .when((ndim >= 2) & F.col("constant_or_mask"), "MASK")
        .when(has_any(name, ("bias",)), "BIAS")
        .when((ndim == 4) & has_any(name, KV_NAMES), "KV_CACHE")
        .when(has_any(name, WEIGHT_NAMES), "WEIGHT")
        .when(F.col("sparsity") > 0.5, "ACTIVATION")
        .when((ndim == 2) & F.col("near_gaussian"), "WEIGHT")
        .when((ndim >= 4) & kv_shape(F.col("shape")), "KV_CACHE")
        .when(ndim >= 4, "ACTIVATION")
        .otherwise("UNKNOWN"),
    )


def lossless(name: Column, nbytes: Column) -> Column:
    """Small tensors, and those of normalization layers by name, are kept exactly."""
    low = F.lower(F.coalesce(name, F.lit("")))
    norm = has_any(low, NORM_NAMES) | low.contains(".ln_") | low.startswith("ln_") | low.contains(".norm") | low.endswith("norm.weight") | low.endswith("norm.bias")
    return (nbytes <= LOSSLESS_BYTES) | norm


def sparse_route(tensor_type: Column, n: Column, zero_share: Column) -> Column:
    """Whether the sparse form is taken, by type, size and the share of exact zeros."""
    return F.when(tensor_type == "EMBEDDING", (n >= 4096) & (zero_share >= 0.30)).when(tensor_type == "ACTIVATION", (n >= 2048) & (zero_share >= 0.75)).otherwise(F.lit(False))


def activation_mode(lo: Column) -> Column:
    return F.when(lo >= 0, "asymmetric").otherwise("symmetric")


def strategy(tensor_type: Column) -> Column:
    """Id of a type's strategy; 255 for the default one."""
    ids = {"WEIGHT": 1, "KV_CACHE": 2, "EMBEDDING": 3, "ACTIVATION": 4, "OPTIMIZER_STATE": 5, "BIAS": 6, "MIXED_PRECISION": 7, "MASK": 8}
    out = F.when(F.lit(False), F.lit(0))
    for t, i in ids.items():
        out = out.when(tensor_type == t, i)
    return out.otherwise(255)


def skip_reason(n: Column, dtype: Column) -> Column:
    numeric = dtype.rlike("^(bool|u?int(8|16|32|64)|b?float(16|32|64))$")
    return F.when(n == 0, "empty_tensor").when(~numeric, F.concat(F.lit("unsupported_dtype:"), dtype))


def sampled_names(names: DataFrame, name: str, seed: int, extras: int) -> DataFrame:
    """All names with a role, and the first extras others in the order of a hash of seed and name: role, chosen_as."""
    n = names.select(F.col(name).alias("name"), tensor_role(F.col(name)).alias("role"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256)
    # the top extras of the rest; sorting by limit keeps only so many a task
    rest = n.filter("role = 'other'").withColumn("hash", rank).orderBy("hash").limit(extras).drop("hash")
    return n.filter("role <> 'other'").withColumn("chosen_as", F.lit("role")).unionByName(rest.withColumn("chosen_as", F.lit("extra")))


def duplicates(records: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once."""
    return records.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def last_wins(records: DataFrame, name: str, seq: str) -> DataFrame:
    return records.withColumn("_r", F.row_number().over(W.partitionBy(name).orderBy(F.desc(seq)))).filter("_r = 1").drop("_r")
