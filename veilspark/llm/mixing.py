"""Mixing sources to target weights by Pivotal dependent rounding (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import free_name, ordered_index, row_key, stage, union

#: Documents (then residuals) that one step of the reduction tree settles among themselves.
FAN_IN = 64


def words(text: Column) -> Column:
    """Words of a text: maximal runs free of ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share ``volume`` of all sizes. A
    target stops at ``most`` times its source's size; the excess is shared again by weight among the
    others until no target is above. Sources of size 0 get 0. Only two sums a round reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = ordered_index(sizes, order, "__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", weight.alias("__weight")))
    cap = F.col("source_size") * most
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * volume
    level, full = 0.0, F.lit(False)
    while True:
        open_weight, held = table.agg(
            F.sum(F.when(~full, F.col("__weight"))), F.sum(F.when(full, cap).otherwise(0.0))
        ).first()
        if not open_weight:
            break
        new = (total - held) / open_weight
        if new <= level:
            break
        level, full = new, F.col("__weight") * new >= cap
    return table.select("source", "source_size", F.when(full, cap).otherwise(F.col("__weight") * level).alias("target"))


def _settle(items: Column) -> Column:
    """Pair the items of an array one after another, moving mass until one of each pair is integral.

    An item has size s, probability p, a uniform u and a payload k. A pair keeps s1*p1 + s2*p2, and
    each item keeps its p in expectation. Returns the settled items and the one left over.
    """
    def let(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]

        def moved(r: Column) -> Column:
            rise = F.least(1 - a["p"], x["p"] * r["r"])
            fall = F.least(a["p"], (1 - x["p"]) * r["r"])
            up = x["u"] * (rise + fall) < fall
            a_ends = F.when(up, 1 - a["p"] <= x["p"] * r["r"]).otherwise(a["p"] <= (1 - x["p"]) * r["r"])
            return F.struct(up.alias("up"), a_ends.alias("a_ends"), r["r"].alias("r"))

        def outcome(m: Column) -> Column:
            settled = F.struct(
                F.when(m["a_ends"], a["k"]).otherwise(x["k"]).alias("k"),
                F.when(m["a_ends"] == m["up"], 1).otherwise(0).alias("c"),
            )
            p = (
                F.when(m["a_ends"] & m["up"], x["p"] - (1 - a["p"]) / m["r"])
                .when(m["a_ends"], x["p"] + a["p"] / m["r"])
                .when(m["up"], a["p"] + x["p"] * m["r"])
                .otherwise(a["p"] - (1 - x["p"]) * m["r"])
            )
            rest = F.struct(
                F.when(m["a_ends"], x["u"]).otherwise(a["u"]).alias("u"),
                F.when(m["a_ends"], x["s"]).otherwise(a["s"]).alias("s"),
                F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"),
                F.when(m["a_ends"], x["k"]).otherwise(a["k"]).alias("k"),
            )
            return F.struct(rest.alias("left"), F.concat(acc["done"], F.array(settled)).alias("done"))

        ratio = F.struct((x["s"] / a["s"]).alias("r"))
        return F.when(a.isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(
            let(let(ratio, moved), outcome)
        )

    first = F.struct(
        F.get(F.filter(items, lambda x: F.lit(False)), F.lit(0)).alias("left"),
        F.transform(F.filter(items, lambda x: F.lit(False)), lambda x: F.struct(x["k"].alias("k"), F.lit(0).alias("c"))).alias("done"),
    )
    return F.aggregate(items, first, step)


def pivotal_round(items: DataFrame, group: str, fan_in: int = FAN_IN, seed: int = 7) -> DataFrame:
    """Round the probabilities of ``items`` (group, k, s, p) to 0 or 1: Pivotal dependent rounding.

    ``k`` is any payload, ``s`` a size above 0, ``p`` in [0, 1]. Items of a group are dealt by size
    class (an eighth of a doubling) and, inside a class, to hash chunks of about ``fan_in``; a chunk
    settles its items pair by pair, and its one leftover goes on to the next level, ``fan_in`` chunks
    to one. When each class has one leftover, they are settled from the largest class down, so what
    is left at the very end is small; it is drawn by its own probability. A group's sum of s*p is
    kept but for that last item. A hot group only has more chunks; a chunk that repeated rows make
    long is cut by row number. Draws come from hashes of payload and seed, so reruns agree.
    Returns (group, k, c).
    """
    g = F.col(group)
    items = items.withColumn("__class", F.floor(F.log2("s") * 8).cast("int"))
    counts = items.groupBy(group, "__class").agg(F.ceil(F.count("*") / fan_in).cast("long").alias("__n"))
    counts = stage(counts.withColumnRenamed(group, "__g").withColumnRenamed("__class", "__c"))
    deepest = counts.agg(F.max("__n")).first()[0] or 0
    same = g.eqNullSafe(F.col("__g")) & (F.col("__class") == F.col("__c"))
    chunk = F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("__n"))
    dealt = items.join(counts, same).select(group, "__class", "k", "s", "p", chunk.alias("__chunk"))

    def drawn(level: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1 + level), "k"), 11) / float(1 << 53)

    dealt = dealt.withColumn("__u", drawn(0))
    order = Window.partitionBy(group, "__class", "__chunk").orderBy(F.col("s").desc(), "__u", "k")
    dealt = dealt.withColumn("__part", F.floor((F.row_number().over(order) - 1) / (4 * fan_in)))
    item = F.struct(F.col("__u").alias("u"), "s", "p", "k")

    def settle(df: DataFrame, by: list[str]) -> DataFrame:
        sized = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), item.alias("x"))))
        out = df.groupBy(group, *by).agg(F.transform(sized, lambda z: z["x"]).alias("__items"))
        return stage(out.select(group, *by, _settle(F.col("__items")).alias("__r")))

    now = settle(dealt, ["__class", "__chunk", "__part"])
    done = []
    while True:
        done.append(now.select(group, F.explode("__r.done").alias("__d")).select(group, "__d.k", "__d.c"))
        by = [c for c in now.columns if c in ("__class", "__chunk")]
        left = now.select(group, *by, "__r.left.*")
        if not by:
            break
        left = left.select(group, *by, "k", "s", "p", drawn(len(done)).alias("__u"))
        if deepest > 1 or "__part" in now.columns:
            now = settle(left.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in)), ["__class", "__chunk"])
            deepest = -(-deepest // fan_in)
        else:
            now = settle(left, [])
    done.append(left.select(group, "k", F.when(F.col("u") < F.col("p"), 1).otherwise(0).alias("c")))
    return union(done)


def mix(docs: DataFrame, weights=(3, 1, 2), volume: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies that each row of ``docs`` (text, source, any others) gets so that sources meet their targets.

    Returns the row's 128-bit ``row_key``, ``rows`` (how many equal rows there are, each counted),
    ``size``, ``source``, ``source_size``, ``target`` and ``copies`` (of all those rows together).
    A row's expected copies are target / source_size; the whole part is taken, the rest rounded by
    :func:`pivotal_round` with the size as mass, so a source's words come within one document of its
    target. Null and empty texts have size 0, no mass and their whole part of copies. A null source is a
    source of its own. An empty table gives no rows. Equal rows are settled one by one.
    """
    sized = docs.select(row_key(docs.columns).alias("row_key"), F.col("source"), words(F.col("text")).alias("size"))
    return mix_sizes(sized, ["row_key"], weights, volume, most, seed).groupBy("row_key").agg(
        F.count("*").alias("rows"), F.first("size").alias("size"), F.first("source").alias("source"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("copies").alias("copies"),
    )


def mix_sizes(sized: DataFrame, keys: list[str], weights=(3, 1, 2), volume=1.5, most=2.0, seed: int = 7) -> DataFrame:
    """:func:`mix` for rows (keys..., source, size) measured already; one row out for each row in."""
    sized = stage(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, volume, most)).withColumnRenamed("source", "__s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__whole", F.floor(share + 1e-12)).withColumn("__p", F.greatest(share - F.col("__whole"), F.lit(0.0)))
    live = (F.col("size") > 0) & (F.col("__p") > 1e-12)
    payload = F.struct(*keys, "size", "source_size", "target", F.col("__whole").alias("whole"))
    rounded = pivotal_round(
        rows.where(live).select("source", payload.alias("k"), F.col("size").cast("double").alias("s"), F.col("__p").alias("p")),
        "source", seed=seed,
    )
    plain = rows.where(~live).select("source", payload.alias("k"), F.lit(0).alias("c"))
    out = rounded.unionByName(plain)
    return out.select(
        *[F.col(f"k.{c}") for c in keys], "source", F.col("k.size").alias("size"), F.col("k.source_size").alias("source_size"),
        F.col("k.target").alias("target"), (F.col("k.whole") + F.col("c")).cast("long").alias("copies"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs`` repeated as often as :func:`mix` says, none if never."""
    name = free_name(docs, "__row_key")
    copies = mix(docs, **options).select(F.col("row_key").alias(name), "copies").where(F.col("copies") > 0)
    keyed = docs.withColumn(name, row_key(docs.columns)).dropDuplicates([name])
    count, time = free_name(keyed, "__copies"), free_name(keyed, "__n")
    joined = keyed.join(copies.withColumnRenamed("copies", count), name)
    times = F.explode(F.sequence(F.lit(1), F.col(count).cast("int")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], times.alias(time)).drop(time)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 3, 1, 2 to 150% of the corpus, at most twice each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    mixed = mix_sizes(sized, ["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
