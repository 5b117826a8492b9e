"""Mixing sources to target weights by pivotal rounding over a reduction tree, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dimension_join, drop_staged, staged, table, words

WEIGHTS, SHARE, MOST_COPIES = (3.0, 1.0, 2.0), 1.5, 2
#: Documents that meet in one node of the reduction tree, on average.
FANOUT = 256
#: A document with more than this part of a node's words is large.
LARGE = 8
#: Rows that a row which stands for many becomes in one task.
BLOCK = 1000


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by these columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.md5(F.col(c).cast("string").cast("binary"))), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("/", *parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, size, n: how many rows like it) to (source, source_size, target): one row per source.

    Sources in order of code points, null last, take the weights in turn. The targets add up to share times all sizes;
    none is above most times its source's size, and what is cut off goes to the others by weight. That end state is
    target = min(level * weight, most * source_size) for one level, which the sources sorted by the level at which they
    are full give directly. If share > most, every source is full.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights)).cast("int"))
    s = s.select("source", "source_size", w.alias("w")).withColumn("full_at", most * F.col("source_size") / F.col("w"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    # the first source that is not yet full at the level of its suffix fixes the level of all that follow
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"], F.lit(float("inf")))
    return s.select("source", "source_size", F.least(level * F.col("w"), (most * F.col("source_size")).cast("double")).alias("target"))


_DONE = "array<struct<id: string, up: int>>"
_LEFT = "struct<size: double, id: string, x: double>"
_ODDS = 1 << 53


def _draw(seed: int, *ids: str) -> str:
    return f"pmod(xxhash64({', '.join(ids)}, {seed}L), {_ODDS}) / {_ODDS}"


def _deal_out(rows: str, seed: int) -> Column:
    """The pivotal method in a leaf of the tree, over an array of (size, id, x) from the largest down, all x equal.

    The document in hand is paired with all that follow, taken as one unit whose fractions move together. Words are moved
    between the two until one of them is whole; in which direction is drawn with the odds that keep the expected words of
    both as they were, so that no document's chance changes. A document alone against smaller ones is whole at once, and
    what is left over in the end is a small one. Gives struct(left: the one left over, done: array of (id, up)).
    """
    return F.expr(
        f"""aggregate({rows}, named_struct('x', {rows}[0].x, 'rest', aggregate({rows}, 0D, (t, r) -> t + r.size), 'all', -1,
      'left', cast(null as {_LEFT}), 'done', cast(array() as {_DONE})),
      (a, b) -> transform(array(named_struct('w', a.rest - b.size, 'u', {_draw(seed, 'b.id')},
          'up', least((1 - a.x) * b.size, a.x * (a.rest - b.size)), 'down', least(a.x * b.size, (1 - a.x) * (a.rest - b.size)))),
        m -> CASE
          WHEN a.all >= 0 THEN named_struct('x', a.x, 'rest', m.w, 'all', a.all, 'left', a.left, 'done', concat(a.done, array(named_struct('id', b.id, 'up', a.all))))
          WHEN m.w <= 0 THEN named_struct('x', a.x, 'rest', 0D, 'all', -1, 'left', named_struct('size', b.size, 'id', b.id, 'x', a.x), 'done', a.done)
          WHEN m.u * (m.up + m.down) < m.down AND (1 - a.x) * b.size <= a.x * m.w
            THEN named_struct('x', greatest(0D, a.x - m.up / m.w), 'rest', m.w, 'all', -1, 'left', a.left, 'done', concat(a.done, array(named_struct('id', b.id, 'up', 1))))
          WHEN m.u * (m.up + m.down) < m.down
            THEN named_struct('x', a.x, 'rest', m.w, 'all', 0, 'left', named_struct('size', b.size, 'id', b.id, 'x', least(1D, a.x + m.up / b.size)), 'done', a.done)
          WHEN a.x * b.size <= (1 - a.x) * m.w
            THEN named_struct('x', least(1D, a.x + m.down / m.w), 'rest', m.w, 'all', -1, 'left', a.left, 'done', concat(a.done, array(named_struct('id', b.id, 'up', 0))))
          ELSE named_struct('x', a.x, 'rest', m.w, 'all', 1, 'left', named_struct('size', b.size, 'id', b.id, 'x', greatest(0D, a.x - m.down / b.size)), 'done', a.done)
        END)[0],
      a -> named_struct('left', a.left, 'done', a.done))"""
    )


def _combine(rows: str, seed: int) -> Column:
    """The pivotal method over what leaves left over, an array of (size, id, x): struct(left, done) as above.

    The document in hand meets the next. Words are moved between the two until one of them is taken or left whole.
    """
    return F.expr(
        f"""aggregate(slice({rows}, 2, greatest(size({rows}) - 1, 0)),
      named_struct('size', {rows}[0].size, 'id', {rows}[0].id, 'x', {rows}[0].x, 'done', cast(array() as {_DONE})),
      (a, b) -> transform(array(named_struct(
          'up', least((1 - a.x) * a.size, b.x * b.size), 'down', least(a.x * a.size, (1 - b.x) * b.size), 'u', {_draw(seed, 'a.id', 'b.id')})),
        m -> CASE
          WHEN m.u * (m.up + m.down) < m.down AND (1 - a.x) * a.size <= b.x * b.size
            THEN named_struct('size', b.size, 'id', b.id, 'x', greatest(0D, b.x - m.up / b.size), 'done', concat(a.done, array(named_struct('id', a.id, 'up', 1))))
          WHEN m.u * (m.up + m.down) < m.down
            THEN named_struct('size', a.size, 'id', a.id, 'x', least(1D, a.x + m.up / a.size), 'done', concat(a.done, array(named_struct('id', b.id, 'up', 0))))
          WHEN a.x * a.size <= (1 - b.x) * b.size
            THEN named_struct('size', b.size, 'id', b.id, 'x', least(1D, b.x + m.down / b.size), 'done', concat(a.done, array(named_struct('id', a.id, 'up', 0))))
          ELSE named_struct('size', a.size, 'id', a.id, 'x', greatest(0D, a.x - m.down / a.size), 'done', concat(a.done, array(named_struct('id', b.id, 'up', 1))))
        END)[0],
      a -> named_struct('left', named_struct('size', a.size, 'id', a.id, 'x', a.x), 'done', a.done))"""
    )


def _reduce(units: DataFrame, seed: int, fanout: int, leaves: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """units (g, id, size, x) through a tree of nodes: the decisions (id, up), and the unit of each group that is left over at its root.

    leaves: units of a group share one x, and are dealt out; else all levels pair unit with unit.
    """
    left, done, last, level = units, None, None, 0
    while True:
        n = staged(left.groupBy("g").agg(F.ceil(F.count("*") / fanout).alias("nodes")), "nodes", small=True)
        most, groups = n.agg(F.max("nodes"), F.count("*")).first()
        if most is None:
            return done, last
        dealt = dimension_join(left, n.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g"), "inner", groups)
        node = F.pmod(F.xxhash64("id", F.lit(seed + level).cast("long")), F.col("nodes"))
        rows = dealt.groupBy("g", node.alias("node"), "nodes").agg(F.sort_array(F.collect_list(F.struct("size", "id", "x")), False).alias("rows"))
        fold = (_deal_out if leaves and level == 0 else _combine)("rows", seed + level)
        folded = staged(rows.select("g", "nodes", fold.alias("f")).select("g", "nodes", "f.left", "f.done"), "folded")
        decided = folded.select(F.explode("done").alias("d")).select("d.id", "d.up")
        rest = folded.select("g", "nodes", "left.id", "left.size", "left.x")
        root = rest.filter("nodes = 1").drop("nodes")
        done, last = (decided, root) if done is None else (done.unionByName(decided), last.unionByName(root))
        left, level = rest.filter("nodes > 1").drop("nodes"), level + 1
        drop_staged(n)


def _rounded(last: DataFrame, seed: int) -> DataFrame:
    return last.select("id", F.expr(f"IF({_draw(seed - 1, 'id')} < x, 1, 0)").alias("up"))


def pivotal(units: DataFrame, seed: int = 42, fanout: int = FANOUT) -> DataFrame:
    """units (g, id string, size double > 0, x in (0, 1)): whole decisions (id, up 0 or 1), each with its chance x.

    ids are unique, and a group's units share one x. Units of a group are dealt by hash to nodes of about fanout units.
    Each node leaves one unit over, and those meet in the next level, until a group fits in one node, whose last unit is
    rounded at random. So no node grows with the group, and a hot group only has more nodes. Units with more than a
    LARGE part of a node's words would be left over themselves, so those go first, through a tree of their own; the
    one that it leaves over is paired with all small units of the group, whose x moves together. A group's sum of size * x
    is missed by less than its last unit's size, a small one but where one unit outweighs all others. The same ids and
    seed give the same decisions on any number of partitions.
    """
    words_of = units.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("words")).filter(F.col("n") > fanout)
    cut = words_of.select(F.col("g").alias("_g"), (F.col("words") / F.ceil(F.col("n") / fanout) / LARGE).alias("cut"))
    cut = staged(cut, "cuts", small=True)
    parted = dimension_join(units, cut, F.col("g") == F.col("_g")).withColumn("large", F.coalesce(F.col("size") > F.col("cut"), F.lit(False))).drop("_g", "cut")
    parted = staged(parted, "units")
    small, large = (parted.filter(c).drop("large") for c in ("not large", "large"))
    none = units.select("id", F.lit(0).alias("up")).limit(0)
    done, last = _reduce(large, seed + 100, fanout, False)
    if done is None:
        done = none
    else:
        pool = small.groupBy(F.col("g").alias("_g")).agg(F.sum("size").alias("w"), F.first("x").alias("p"))
        m = last.join(pool, F.col("g") == F.col("_g")).withColumns({"raise": F.expr("least((1 - x) * size, p * w)"), "lower": F.expr("least(x * size, (1 - p) * w)")})
        m = m.withColumn("up", F.expr(f"{_draw(seed - 2, 'id')} * (raise + lower) < lower"))
        m = m.withColumn("p2", F.expr("IF(up, IF((1 - x) * size <= p * w, greatest(0D, p - raise / w), 0D), IF(x * size <= (1 - p) * w, least(1D, p + lower / w), 1D))"))
        m = staged(m.withColumn("x2", F.expr("IF(up, IF((1 - x) * size <= p * w, 1D, least(1D, x + raise / size)), IF(x * size <= (1 - p) * w, 0D, greatest(0D, x - lower / size)))")), "settled", small=True)
        done = done.unionByName(_rounded(m.select("id", F.col("x2").alias("x")), seed))
        moved = m.select("_g", "p2")
        small = dimension_join(small, moved, F.col("g") == F.col("_g")).withColumn("x", F.coalesce("p2", "x")).drop("_g", "p2")
    open_ = (F.col("x") > 0) & (F.col("x") < 1)
    done = done.unionByName(small.filter(~open_).select("id", F.col("x").cast("int").alias("up")))
    more, last = _reduce(small.filter(open_), seed, fanout, True)
    return done if more is None else done.unionByName(more).unionByName(_rounded(last, seed))


def _each(df: DataFrame, n: str, most: int, number: str) -> DataFrame:
    """df with n rows for each, numbered from 1; a row that stands for very many is dealt out in blocks."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {BLOCK}")))
    df = df.filter(F.col(n) > 0).withColumn("_block", block)
    if most > BLOCK:
        df = df.repartition(F.xxhash64(*df.columns))
    return df.withColumn(number, F.explode(F.expr(f"sequence(_block * {BLOCK} + 1, least({n}, _block * {BLOCK} + {BLOCK}))"))).drop("_block")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 42, tell: Iterable[str] | None = None) -> DataFrame:
    """docs (doc_id, source, text): doc_id, size, source_size, target, copies and taken = size * copies, a row per document.

    Every document of a source has the same expected copies, target / source_size; it gets that many rounded down or up,
    by the pivotal method. A null or empty text has size 0 and gets the copies rounded down. Each row is a unit of its
    own, told by doc_id, source and text, and by a number among rows that are equal in these; so null and repeated ids
    have their own decisions. An empty table gives an empty result. Further columns are left out. With tell, the
    columns named in it tell rows apart too, and source and key, which is equal for rows equal in all of these, are given.
    """
    # n: equal rows are counted before the shuffle; they are told apart by a number only where each is decided
    key = row_key("doc_id", "source", "text", *(tell or ()))
    d = docs.select("doc_id", "source", F.size(words("text")).cast("long").alias("size"), key.alias("key"))
    d = staged(d.groupBy(*d.columns).agg(F.count("*").alias("n")), "sizes")
    t = staged(targets(d, weights, share, most), "targets", small=True).withColumnRenamed("source", "_s")
    each = F.col("target") / F.col("source_size")
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(each + 1e-9)).otherwise(0)).withColumn("x", F.when(F.col("source_size") > 0, each - F.col("whole")).otherwise(0.0))
    j = _each(dimension_join(d, t, F.col("source").eqNullSafe(F.col("_s"))), "n", d.agg(F.max("n")).first()[0] or 0, "number")
    j = j.withColumn("unit", F.concat_ws("-", "key", "number"))
    units = j.filter("x > 1e-9 and size > 0").select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("g"), F.col("unit").alias("id"), F.col("size").cast("double").alias("size"), "x")
    up = pivotal(units, seed)
    copies = (F.col("whole") + F.coalesce(F.col("up"), F.lit(0))).cast("long")
    out = j.join(up, F.col("unit") == F.col("id"), "left").withColumn("copies", copies)
    also = [] if tell is None else ["source", "key"]
    return out.select("doc_id", *also, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as many times as the mix takes it. Rows that are equal in all columns are taken together."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    total = mix(docs, tell=others, **options)
    total = staged(total.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")), "copies")
    own = ["doc_id", "source", "text", *others]
    rows = dimension_join(docs.withColumn("_k", row_key(*own)), total.filter("_copies > 0"), F.col("_k") == F.col("_key"), "inner")
    most, again = total.agg(F.max("_copies"), F.max("_n")).first()
    if (again or 0) > 1:
        rows = rows.filter("_n = 1").unionByName(rows.filter("_n > 1").dropDuplicates(["_k"]))
    return _each(rows, "_copies", most or 0, "_number").select(docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
