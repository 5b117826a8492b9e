"""Document fingerprints: chains of content words that follow common words, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, dimension_join, spread, staged, table, words

#: A word is an anchor if it makes up at least this share of all words: so there are at most 1 / COMMON anchors.
COMMON = 1 / 400
#: Buckets in which words are counted first, to find those that can hold an anchor.
BUCKETS = 1 << 16
#: Least Jaccard similarity of linked sets, and sets in a tile that are compared in one place.
SIMILAR, TILE = 0.8, 512


def lowered(text: Column) -> Column:
    return words(F.lower(F.coalesce(text, F.lit(""))))


def anchors(docs: DataFrame, common: float = COMMON) -> list[str]:
    """The common words of all texts, in order. Exact, in two passes: only buckets that are common as a whole can hold one.

    The first pass sends BUCKETS counts a task at most, the second only the words of 1 / common buckets at most, however
    many words there are. The result has at most 1 / common words, so it may come to the driver.
    """
    w = docs.select(F.explode(lowered(F.col("text"))).alias("w")).withColumn("b", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)))
    counts = staged(w.groupBy("b").agg(F.count("*").alias("n")), "buckets", small=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    full = [r["b"] for r in counts.filter(F.col("n") >= common * total).select("b").collect()]
    rows = w.filter(F.col("b").isin(full)).groupBy("w").count().filter(F.col("count") >= common * total).collect() if full else []
    return sorted(r["w"] for r in rows)


def signatures(text: Column, common: list[str]) -> Column:
    """The distinct spot signatures of a text, sorted: a long for each anchor with the two content words that follow it.

    An anchor near the end, with fewer content words after it, gives none. A text without any signature has one of all its
    words; one without words has none at all. So equal texts have equal signatures.
    """
    parts = F.struct(lowered(text).alias("w"))

    def of(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(common)) if common else F.array().cast("array<int>")
        content = F.filter(w, lambda x: ~x.isin(common)) if common else w
        named = F.struct(places.alias("p"), content.alias("c"))
        # before the j-th anchor, at i, there are i - j content words
        found = F.transform(
            F.array(named),
            lambda r: F.transform(
                r["p"],
                lambda i, j: F.when(F.get(r["c"], i - j + 1).isNotNull(), F.xxhash64(F.get(w, i), F.get(r["c"], i - j), F.get(r["c"], i - j + 1))),
            ),
        )
        return F.array_sort(F.array_distinct(F.array_compact(F.get(found, F.lit(0)))))

    def whole(w: Column) -> Column:
        return F.transform(F.array(F.struct(of(w).alias("s"))), lambda r: F.when(F.size(r["s"]) > 0, r["s"]).otherwise(F.array(F.xxhash64(F.lit("all"), F.array_join(w, " ")))))[0]

    return F.transform(F.array(parts), lambda r: F.when(F.size(r["w"]) > 0, whole(r["w"])).otherwise(F.array().cast("array<bigint>")))[0]


def digest(sigs: Column) -> Column:
    return F.md5(F.array_join(F.transform(sigs, lambda x: F.hex(x)), ",").cast("binary"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all signatures of two distinct sets; 1 for two empty ones. Pruned: sets of which one is empty are not compared."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _order(doc_id: Column, text: Column) -> Column:
    """A string that sorts as doc_id does, null first, then by a hash of the text."""
    n = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), n), F.lit("0")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def with_next(docs: DataFrame, prepare: dict[str, Column], chunks: int | None = None) -> DataFrame:
    """docs (doc_id, text) with the columns of prepare, and next: a struct of text and those columns of the next document.

    Next in ascending doc_id, null first; rows that share a doc_id in the order of a hash of their texts; after the last
    the first. Documents are dealt to chunks of about as many rows, ranges of that order whose bounds a range partitioning
    of the keys alone gives (a few for each shuffle partition, whatever the input); a chunk's first document goes to the chunk
    before it too. So each text is shuffled once, and no window holds more than a chunk, however ids lie; only
    rows equal in doc_id and text stay together.
    """
    chunks = chunks or 4 * spread(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", _order(F.col("doc_id"), F.col("text")))
    first = d.select("order").repartitionByRange(chunks, "order").groupBy(F.spark_partition_id().alias("p")).agg(F.min("order").alias("order"))
    bounds = sorted({r["order"] for r in first.collect()}) or [""]
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.lit(bounds[step::step] or ["~"]), F.lit(bounds)
    # how many bounds lie at or below: by every step-th of them, then by those between
    below = F.size(F.filter(coarse, lambda x: x <= F.col("order"))) * step
    d = d.withColumn("below", below)
    chunk = F.col("below") + F.size(F.filter(F.slice(fine, F.col("below") + 1, step), lambda x: x <= F.col("order"))) - 1
    d = d.withColumn("chunk", chunk).drop("below")
    home = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("guest"))
    away = F.struct(F.pmod(F.col("chunk") - 1, F.lit(len(bounds))).alias("chunk"), F.lit(True).alias("guest"))
    head = F.col("order") == F.get(fine, F.col("chunk"))
    d = d.withColumn("at", F.explode(F.when(head, F.array(home, away)).otherwise(F.array(home)))).select("doc_id", "text", "order", "at.*")
    d = d.repartition(len(bounds), "chunk").withColumns(prepare)
    w = W.partitionBy("chunk").orderBy("guest", "order")
    return d.withColumn("next", F.lead(F.struct("text", *prepare)).over(w)).filter("not guest").drop("chunk", "guest", "order")


def _needed(n: Column, least: float) -> Column:
    """How many of its n signatures a set shares with any set that similar, at least."""
    return F.ceil(F.lit(least) * n - 1e-9)


def similar_sets(sets: DataFrame, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """sets (sid, n, sigs), each set once, to (node, root): sets joined by pairs with a Jaccard similarity of least or more.

    1. Two such sets share n - least * n + 1 first signatures in any order that holds for all: here the rarest come first. A
       signature that no other set has brings nobody together, so that most sets are out at once.
    2. Sets meet by those signatures within partitions of set length, whose lengths are least apart: each goes to its own
       and the next. Of a signature in a partition, each set is linked to the first one only; the components of these
       links hold all pairs that can be similar.
    3. Within a component sets are compared tile by tile, where each set gives the first similar set of another
       group; so at least half of the groups go in a round, until no set finds another. So no pairs are ever rows, and none is left out.
    """
    tokens = sets.select("sid", "n", F.explode("sigs").alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("t", "_t")
    shared = tokens.join(counts, F.col("t") == F.col("_t")).groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    shared = shared.filter(F.size("s") >= _needed(F.col("n"), least))
    first = F.slice("s", 1, (F.size("s") - _needed(F.col("n"), least) + 1).cast("int"))
    size = F.floor(F.log("n") / -math.log(least) + 1e-9).cast("int")
    keys = shared.select("sid", size.alias("size"), F.explode(first).alias("k"))
    keys = keys.select("sid", "k.t", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    keys = staged(keys, "keys")
    heads = keys.groupBy("t", "size").agg(F.min("sid").alias("head"), F.max("sid").alias("last")).filter("head < last").select(F.col("t").alias("_t"), F.col("size").alias("_size"), "head")
    meet = keys.join(heads, (F.col("t") == F.col("_t")) & (F.col("size") == F.col("_size"))).select(F.col("sid").alias("u"), F.col("head").alias("v")).distinct()
    clusters = components(meet)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    clusters = staged(clusters.withColumnsRenamed({"node": "_sid", "root": "cluster"}), "clusters")
    members = staged(dimension_join(sets, clusters, F.col("sid") == F.col("_sid"), "inner").select("cluster", "sid", "n", "sigs"), "members")
    large = members.groupBy(F.col("cluster").alias("_c")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).filter("tiles > 1")
    members = dimension_join(members, staged(large, "large", small=True), F.col("cluster") == F.col("_c")).withColumn("tiles", F.coalesce("tiles", F.lit(1))).drop("_c")
    members = staged(members.withColumn("k", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")), "members")
    links, roots = None, None
    while True:
        m = members.withColumn("root", F.col("sid")) if roots is None else dimension_join(members, roots.withColumnsRenamed({"node": "_n", "root": "_r"}), F.col("sid") == F.col("_n")).withColumn("root", F.coalesce("_r", "sid"))
        pairs = m.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("cluster", F.least("k", "x").alias("ka"), F.greatest("k", "x").alias("kb"), "k", F.struct("sid", "n", "root", "sigs").alias("m"))
        one = pairs.groupBy("cluster", "ka", "kb").agg(F.collect_list(F.when(F.col("k") == F.col("ka"), F.col("m"))).alias("a"), F.collect_list(F.when(F.col("k") == F.col("kb"), F.col("m"))).alias("b"))
        one = one.filter("size(a) + size(b) > 2 or ka <> kb").repartition(spread(sets.sparkSession))

        def alike(x: Column, y: Column) -> Column:
            able = (x["root"] != y["root"]) & (F.least(x["n"], y["n"]) >= least * F.greatest(x["n"], y["n"]) - 1e-9)
            return able & F.when(able, jaccard(x["sigs"], y["sigs"]) >= least - 1e-12).otherwise(False)

        def firsts(xs: str, ys: str) -> Column:
            return F.transform(xs, lambda x: F.struct(x["sid"].alias("u"), F.array_min(F.transform(F.filter(ys, lambda y: alike(x, y)), lambda y: y["sid"])).alias("v")))

        found = F.when(F.col("ka") == F.col("kb"), firsts("a", "b")).otherwise(F.concat(firsts("a", "b"), firsts("b", "a")))
        new = one.select("cluster", F.explode(F.filter(found, lambda e: e["v"].isNotNull())).alias("e")).select("cluster", "e.u", "e.v")
        new = staged(new, "links")
        if new.isEmpty():
            return sets.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots
        links = new.select("u", "v") if links is None else links.unionByName(new.select("u", "v"))
        roots = components(links)
        # a component in which no set found another is settled
        members = dimension_join(members, staged(new.select(F.col("cluster").alias("_c")).distinct(), "open"), F.col("cluster") == F.col("_c"), "left_semi")


def near_groups(docs: DataFrame, known: list[str], least: float = SIMILAR) -> DataFrame:
    """docs (doc_id, text) to (fingerprint, component_id): the least doc_id among documents whose sets are joined by similar pairs.

    Documents with equal sets are one, counted before the shuffle, so copies are never compared.
    """
    each = docs.select("doc_id", signatures(F.col("text"), known).alias("sigs"))
    sets = each.groupBy(digest(F.col("sigs")).alias("fingerprint")).agg(F.min("doc_id").alias("first"), F.first("sigs").alias("sigs"))
    sets = staged(sets.withColumns({"sid": F.monotonically_increasing_id(), "n": F.size("sigs")}), "sets")
    roots = similar_sets(sets.filter("n > 0").select("sid", "n", "sigs"), least).withColumnRenamed("node", "_sid")
    own = dimension_join(sets.select("fingerprint", "first", "sid"), staged(roots, "roots"), F.col("sid") == F.col("_sid"))
    own = staged(own.select("fingerprint", "first", F.coalesce("root", "sid").alias("root")), "groups")
    ids = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("_root"), "component_id")
    out = dimension_join(own, staged(ids, "ids"), F.col("root") == F.col("_root"))
    return out.select("fingerprint", F.when(F.col("_root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))


def fingerprints(docs: DataFrame, common: float = COMMON) -> DataFrame:
    """docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id, a row per row.

    The edited text has its last n_chars div 2 characters replaced by the first as many of the next document. Each text's
    fingerprint is a digest of its set of signatures; the two likenesses are Jaccard similarities of the sets.
    component_id is the least doc_id among documents that pairs of sets with a similarity of 0.8 or more join. A null
    text is empty; a null doc_id counts as larger than any other there. An only document is its own next. An empty table
    gives an empty result; further columns are left out.
    """
    known = anchors(docs, common)
    d = with_next(docs, {"sigs": signatures(F.col("text"), known)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sigs", signatures(F.col("edited"), known).alias("esigs"), F.col("next.sigs").alias("nsigs"))
    d = d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("sigs")).alias("fingerprint"),
        digest(F.col("esigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("esigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("nsigs")).alias("near_next"),
    )
    groups = near_groups(docs, known).withColumnRenamed("fingerprint", "_fingerprint")
    return d.join(groups, F.col("fingerprint") == F.col("_fingerprint")).drop("_fingerprint")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
