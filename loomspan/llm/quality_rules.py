"""Quality rules with risk-controlled cutoffs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dimension_join, staged, table, words

#: A text fails outright below 50 words, or if over half its words are in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[^#*$%&|<>]+"
#: The rules: a text is rejected if the measure is above the cutoff. Measures are whole numbers per thousand.
RULES = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_words, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
}
#: Cutoffs tried, strictest first.
GRID = {
    "symbols": [2, 5, 10, 20, 40, 80, 160, 320],
    "dup_lines": [0, 2, 5, 10, 20, 50, 100, 200],
    "repeats": [20, 40, 80, 120, 160, 240, 320, 420],
    "word_length": [600, 700, 800, 900, 1000, 1200, 1500, 2000],
}


def repeat_words(w: Column, n: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array w of n words.

    Each window becomes one long, its hash above its position, so that a sort of primitive longs brings equal windows
    together; neighbours are then compared word by word, so that a chance equality of hashes counts nothing.
    """
    bits = F.ceil(F.log2(n + 1)).cast("int")

    def call(name: str, *args: Column) -> Column:
        return F.call_function(name, *args)

    keyed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    mask = call("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.struct(F.sort_array(keyed).alias("s"))

    def covered(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            return (
                (call("shiftright", x, bits) == call("shiftright", y, bits))
                & (F.get(w, a) == F.get(w, b))
                & (F.get(w, a + 1) == F.get(w, b + 1))
                & (F.get(w, a + 2) == F.get(w, b + 2))
            )

        flagged = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)),
                    x.bitwiseAND(mask),
                ).otherwise(F.lit(-1).cast("long")),
            ),
            lambda p: p >= 0,
        )
        places = F.sort_array(flagged)
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last")),
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum"), p.alias("last")),
            lambda a: a["sum"],
        )

    # the array of one struct gives the sorted longs a name, so that they are made once
    return F.when(n >= 3, F.get(F.transform(F.array(packed), lambda r: covered(r["s"])), F.lit(0))).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs).

    A null text has no words and counts 0 everywhere. Only doc_id and lang are carried along, so that further columns
    of docs can't clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", F.col("lang").alias("stratum"), words("text").alias("_w"), lines.alias("_l"), F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"))
    w, n = F.col("_w"), F.size("_w")
    return base.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(w, n).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at the given rate, summed exactly term by term in logarithms. 1 for k >= rate * n."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log(F.lit(1 - rate))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] + F.log((n - i + 1) / i * odds)).alias("term"),
            (a["sum"] + F.exp(a["term"] + F.log((n - i + 1) / i * odds))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, max_false_rejection: float = 0.04, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n, k): for each stratum and rule the strictest cutoff that is shown to be safe.

    Safe: among n texts labelled good that the base rules pass, k are above the cutoff, and the exact (Clopper-Pearson)
    upper bound of the rate of rejection, at an error divided by the number of all tests (strata x rules x cutoffs), is
    within max_false_rejection divided by the number of rules. So with probability 1 - error no stratum loses more than
    max_false_rejection of its good texts to the rules. A rule without a safe cutoff in a stratum has no row and rejects
    nothing there. Rows of labels with a null quality are not used; a doc_id labelled more than once counts as good if
    any of its labels says so.
    """
    rate = max_false_rejection / len(RULES)
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    held = measured.filter("not base_failed").join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    above = [F.count_if(F.expr(f"{RULES[r]} > {c}")).alias(f"{r}_{c}") for r in RULES for c in GRID[r]]
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for c in GRID[r]]))
    cells = staged(counted.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*"), "cells", small=True)
    m = max(1, cells.count())
    safe = cells.filter(binomial_tail(F.col("k"), F.col("n"), rate) <= error / m)
    return safe.groupBy("stratum", "rule").agg(F.min_by(F.struct("cutoff", "n", "k"), "cutoff").alias("x")).select("stratum", "rule", "x.*")


def quality_rules(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """One row per row of docs: the measures, base_failed and kept.

    Strata are the languages; a null language is a stratum of its own. Repeated rows and ties each get their own row.
    An empty table gives an empty result.
    """
    measured = staged(measures(docs), "measures")
    wide = cutoffs(measured, labels, **risk).groupBy(F.col("stratum").alias("_s")).pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = staged(wide, "cutoffs", small=True)
    joined = dimension_join(measured, wide, F.col("stratum").eqNullSafe(F.col("_s")))
    rejected = F.lit(False)
    for r, measure in RULES.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(f"`{r}`"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    """The same result in DuckDB's SQL, without hashes: windows are compared as they are."""
    cells = " union all ".join(f"select stratum, '{r}' as rule, {c} as cutoff, count(*) as n, count_if({RULES[r].replace('div', '//')} > {c}) as k from held group by stratum" for r in RULES for c in GRID[r])
    rate = 0.04 / len(RULES)
    tail = f"list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}e0) + (n - i) * ln(1 - {rate}e0))))"
    rejected = " or ".join(f"coalesce({RULES[r].replace('div', '//')} > (select min(cutoff) from safe s where s.rule = '{r}' and s.stratum is not distinct from m.stratum), false)" for r in RULES)
    return f"""
with d as (select row_number() over () as rid, doc_id, lang as stratum, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
win as (select rid, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
c as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c from win),
r as (select rid, count(distinct i + j) as n_repeat_words from c, (select unnest([0, 1, 2]) as j) where c > 1 group by rid),
b as (select doc_id, stratum, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (rid)),
m as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from b),
held as (select * from m where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
cells as ({cells}),
safe as (select * from cells where k < n * {rate}e0 and {tail} <= 0.05e0 / (select count(*) from cells))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({rejected}) as kept from m
"""


OP3_SQL = _sql()
