"""URL filter: rules by host and path, then two character models of accepted and rejected URLs; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, staged, table

#: The rules, each a host and a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Longest context, the weight of the shorter context, and the share of accepted URLs that may be blocked.
ORDER, BACK, FALSE_BLOCK = 4, 4.0, 0.01
#: Contexts of so many characters have at most SYMBOLS ** (SHORT + 1) entries, which may be broadcast; rows that a hot longer one is spread over.
SHORT, SALTS = 2, 16
#: Characters that the models know.
SYMBOLS = 45
#: Scores are binned to so many steps per nat, within so many nats, to calibrate.
STEPS, WIDEST = 500, 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    p = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, p, 1), UPPER, LOWER), F.regexp_extract(u, p, 2)


def matched(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        then = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<verdict: string, rule: string>")


def _spelt(host: Column, path: Column) -> Column:
    """What the models read: host and path in at most SYMBOLS characters; a run of digits is one 0, anything else unknown is ~."""
    s = F.lower(F.concat(host, path))
    s = F.regexp_replace(s, "[0-9]+", "0")
    return F.concat(F.lit("^"), F.regexp_replace(s, r"[^a-z0./_%=&:;,+@!()-]", "~"), F.lit("$"))


def _places(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character of s to be told and per length of context: keep, o (length), c (context), x (character)."""
    s = F.col("s")

    def at(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.least(F.lit(ORDER), i - 1)),
            lambda o: F.struct(o.alias("o"), F.substring(s, i - o, o).alias("c"), F.substring(s, i, F.lit(1)).alias("x")),
        )

    return rows.select(*keep, F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.length(s)), at))).alias("p")).select(*keep, "p.*")


def train(labelled: DataFrame) -> DataFrame:
    """labelled (s, verdict) to the model (c, x, gain).

    Both models count every character after each of its contexts of 0 to ORDER characters, over all labelled URLs, and
    keep all of them, so that the model grows with the input. The probability after a context is smoothed by that after
    the context without its first character, down to a uniform one. gain is the log of the accepted over the rejected
    probability, less the same for the shorter context: summed over the contexts of a place it gives the log ratio
    at the longest of them in which the character was seen, so the order varies from place to place.
    """
    counted = _places(labelled, ["verdict"]).groupBy("o", "c", "x").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    counted = staged(counted, "grams")
    ctx = counted.groupBy("o", "c").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    kept = staged(counted.join(ctx, ["o", "c"]), "contexts")

    def smooth(n: str, t: str, p: Column) -> Column:
        return (F.col(n) + BACK * p) / (F.col(t) + BACK)

    longer, out = None, None
    for o in range(ORDER + 1):
        here = kept.filter(F.col("o") == o)
        if longer is None:
            here = here.withColumns({"qa": F.lit(1 / SYMBOLS), "qb": F.lit(1 / SYMBOLS), "base": F.lit(0.0)})
        else:
            # what a context has seen, its shorter one has seen too
            shorter = longer.select(F.col("c").alias("_c"), F.col("x").alias("_x"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.log(F.col("pa") / F.col("pb")).alias("base"))
            here = here.join(shorter, (F.substring("c", 2, ORDER) == F.col("_c")) & (F.col("x") == F.col("_x")))
        longer = staged(here.select("c", "x", smooth("a", "ca", F.col("qa")).alias("pa"), smooth("b", "cb", F.col("qb")).alias("pb"), "base"), f"order{o}", small=o <= SHORT)
        gain = longer.select("c", "x", (F.log(F.col("pa") / F.col("pb")) - F.col("base")).alias("gain"))
        out = gain if out is None else out.unionByName(gain)
    return out


def score(urls: DataFrame, model: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """urls (id, s) to (id, score): the log ratio summed over a URL's characters, divided by their number.

    A model of up to BROADCAST_ROWS rows (counted) is broadcast. Of a larger one only the short contexts are, whose number
    no input moves; longer ones are joined by a shuffle, each salted, as some are in a large part of all URLs. Rows of an id that
    repeat with the same s leave its mean as it is.
    """
    m = model.select(F.col("c").alias("_c"), F.col("x").alias("_x"), "gain")
    places, same = _places(urls, ["id"]), (F.col("c") == F.col("_c")) & (F.col("x") == F.col("_x"))
    if m.limit(limit + 1).count() <= limit:
        hit = places.join(F.broadcast(m), same, "left").select("id", "o", "gain")
    else:
        short, long = (m.filter(F.length("_c") <= SHORT), m.filter(F.length("_c") > SHORT))
        hit = places.filter(F.col("o") <= SHORT).join(F.broadcast(short), same, "left").select("id", "o", "gain")
        salted = long.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = places.filter(F.col("o") > SHORT).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        hit = hit.unionByName(rest.join(salted, same & (F.col("salt") == F.col("_salt")), "left").select("id", "o", "gain"))
    return hit.groupBy("id").agg((F.coalesce(F.sum("gain"), F.lit(0.0)) / F.count_if(F.col("o") == 0)).alias("score"))


def calibrate(accepted: DataFrame, false_block: float = FALSE_BLOCK) -> float:
    """The highest cutoff under which at most false_block of the accepted scores lie; 0 if that is above or there are none.

    A URL that the accepted model explains better than the other one is never blocked.

    Scores are counted in at most 2 * WIDEST * STEPS bins, so that neither the sort nor the running sum grows.
    """
    bins = accepted.groupBy(F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score"))) * STEPS).alias("bin")).count()
    upto = F.sum("count").over(W.orderBy("bin"))
    total = F.sum("count").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = bins.select("bin", (upto > false_block * total).alias("over")).filter("over").agg(F.min("bin")).first()[0]
    return 0.0 if first is None else min(0.0, first / STEPS)


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, false_block: float = FALSE_BLOCK) -> DataFrame:
    """pages (page_id, url): page_id, host, path, rule, verdict, score, one row per row of pages.

    The longest rule that fits decides. Where none fits, the models do, trained on all URLs that rules decide but every
    fifth, which calibrate the cutoff: block if the score is below it. With no URL on one of the two sides the models
    know nothing and allow. A null url, or one without ://, has an empty host and path, fits no rule and is scored by
    its empty text. Further columns are left out; an empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("m", matched(F.col("host"), F.col("path"), rules)).withColumn("s", _spelt(F.col("host"), F.col("path")))
    p = staged(p.select("page_id", "host", "path", "m.rule", "m.verdict", "s"), "urls")
    known = p.filter("verdict is not null").withColumn("fold", F.conv(F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 6), 16, 10).cast("long") % 5)
    sides = known.agg(F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")).first()
    if not (sides[0] and sides[1]):
        return p.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = staged(train(known.filter("fold <> 0")), "model")
    held = known.filter("fold = 0 and verdict = 'allow'").select(F.struct("page_id", "s").alias("id"), "s")
    cutoff = calibrate(score(held, model), false_block)
    unknown = p.filter("verdict is null")
    scored = score(unknown.select(F.struct("page_id", "s").alias("id"), "s"), model).select(F.col("id.page_id").alias("_id"), F.col("id.s").alias("_s"), "score")
    judged = unknown.join(scored, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("s") == F.col("_s")), "left")
    judged = judged.withColumn("verdict", F.when(F.col("score") < cutoff, "block").otherwise("allow")).withColumn("score", F.round("score", 9))
    cols = ["page_id", "host", "path", "rule", "verdict", "score"]
    return p.filter("verdict is not null").withColumn("score", F.lit(None).cast("double")).select(cols).unionByName(judged.select(cols))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same result in DuckDB's SQL."""
    by_length = sorted(RULES, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        h, slash, p = rule.partition("/")
        return f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{slash}{p}')"

    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in by_length) + " end"
    verdict = "case rule " + " ".join(f"when '{r}' then '{v}'" for v, r in by_length) + " end"
    orders = [f"o0 as (select c, x, (a + {BACK}e0 / {SYMBOLS}) / (ca + {BACK}e0) as pa, (b + {BACK}e0 / {SYMBOLS}) / (cb + {BACK}e0) as pb, 0.0e0 as base from kept where o = 0)"]
    for o in range(1, ORDER + 1):
        orders.append(
            f"o{o} as (select k.c, k.x, (a + {BACK}e0 * q.pa) / (ca + {BACK}e0) as pa, (b + {BACK}e0 * q.pb) / (cb + {BACK}e0) as pb, ln(q.pa / q.pb) as base "
            f"from kept k join o{o - 1} q on substr(k.c, 2) = q.c and k.x = q.x where k.o = {o})"
        )
    model = " union all ".join(f"select c, x, ln(pa / pb) - base as gain from o{o}" for o in range(ORDER + 1))
    return f"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from u),
r as (select *, {rule} as rule from p), v as (select *, {verdict} as verdict,
  '^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]+', '0', 'g'), '[^a-z0./_%=&:;,+@!()-]', '~', 'g') || '$' as s, cast('0x' || substr(md5(host || path), 1, 6) as bigint) % 5 as fold from r),
texts as (select page_id, s, verdict, fold from v), i as (select *, unnest(range(2, length(s) + 1)) as i from texts), io as (select *, unnest(range(0, least({ORDER}, i - 1) + 1)) as o from i),
places as (select page_id, s, verdict, fold, cast(o as int) as o, substr(s, cast(i - o as int), cast(o as int)) as c, substr(s, cast(i as int), 1) as x from io),
g as (select o, c, x, count_if(verdict = 'allow') as a, count_if(verdict = 'block') as b from places where verdict is not null and fold <> 0 group by all),
ctx as (select o, c, sum(a) as ca, sum(b) as cb from g group by all), kept as (select g.*, ca, cb from g join ctx using (o, c)),
{", ".join(orders)}, model as ({model}),
score as (select page_id, s, coalesce(sum(gain), 0) / count_if(o = 0) as score from places left join model using (c, x) where verdict is null or verdict = 'allow' and fold = 0 group by page_id, s),
held as (select distinct page_id, s from texts where verdict = 'allow' and fold = 0),
bins as (select cast(floor(greatest(-{WIDEST}, least({WIDEST}, score)) * {STEPS}) as bigint) as bin, count(*) as n from held join score using (page_id, s) group by 1),
cut as (select least(0, coalesce(min(bin) / {STEPS}.0e0, 0)) as cut from (select bin, sum(n) over (order by bin) > {FALSE_BLOCK} * sum(n) over () as over_ from bins) where over_),
known as (select count(distinct verdict) = 2 as known from v)
select page_id, host, path, rule, coalesce(verdict, case when known and score < cut then 'block' else 'allow' end) as verdict, case when verdict is null and known then round(score, 9) end as score
from v left join score using (page_id, s), cut, known
"""


OP1_SQL = _sql()
