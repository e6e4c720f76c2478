"""Sharding by k-d tree partitioning: distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stage, text_key

#: Bins of one histogram pass, a node; and the parts of a shard that are numbered apart.
BINS, PARTS = 1024, 64
#: A text whose copies exceed this share of a leaf is weighed by itself at every node: no median can cut it.
HEAVY = 0.05


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (a null has none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _groups(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One row a distinct text: its key, bytes of all copies, a tie hash, and its least copy's metadata."""
    row = docs.select(text_key(F.col("text")).alias("g"), byte_size(F.col("text")).alias("size"), F.struct(*[c.cast("double").alias(n) for n, c in dims.items()]).alias("m"))
    one = row.groupBy("g").agg(F.sum("size").alias("w"), F.min("m").alias("m"))
    return one.select("g", "w", *[F.coalesce(F.col(f"m.{n}"), F.lit(-1.0)).alias(n) for n in dims])


def kd_tree(groups: DataFrame, dims: list[str], leaves: int, near: float = 0.002) -> DataFrame:
    """(g, shard): a k-d tree over ``groups`` (g, w, dims...) with ``leaves`` leaves of near equal weight.

    A node covers a run of leaves; it is cut until it covers one. Its widest dimension, measured
    against the root's width, is cut at the weighted median of (value, tie hash): the point that
    leaves each half the weight of its leaves. The node's heavy groups, which a median would leave on one side whole, are
    first given one by one, the heaviest first, to the half that lacks more (one that outweighs a leaf of the node gets a leaf to itself); the cut through the others evens out the rest. There are
    ``leaves / HEAVY`` heavy groups at most, and only these are known to the driver. Medians are found by histograms: a pass sums the bytes of
    BINS bins a node on the executors and narrows every node's interval to the bin that holds the median,
    until that bin holds less than ``near`` of a leaf or one key. The driver sees BINS rows a node at
    most, no rows of the table; the nodes' intervals go back as a table of one row a node.
    """
    root = groups.agg(F.sum("w"), *[F.max(n) - F.min(n) for n in dims]).first()
    leaf = (root[0] or 0) / leaves
    spans = [s or 1.0 for s in root[1:]]
    heavy = {r["g"]: (0, r["w"]) for r in groups.where(F.col("w") > HEAVY * leaf).select("g", "w").collect()}
    now = groups.where(F.col("w") <= HEAVY * leaf).withColumn("node", F.lit(0)).withColumn("tie", F.xxhash64("g").cast("double"))
    ends = {0: leaves}  # a node is named by its first leaf; its end says how many it covers
    while True:
        wide = [(F.max(n) - F.min(n)) / s for n, s in zip(dims, spans, strict=True)]
        open_nodes = [n for n, end in ends.items() if end - n > 1]
        seen = {r["node"]: r for r in now.where(F.col("node").isin(open_nodes)).groupBy("node").agg(
            F.sum("w").alias("w"), F.array(*wide).alias("wide"), F.array(*[F.min(n) for n in dims]).alias("lo"), F.array(*[F.max(n) for n in dims]).alias("hi")
        ).collect()} if open_nodes else {}
        if not open_nodes:
            placed = groups.sparkSession.createDataFrame([(g, n) for g, (n, _) in heavy.items()], "g binary, shard int")
            return now.select("g", F.col("node").alias("shard")).unionByName(placed)
        todo = {}
        for node in open_nodes:
            own = sorted(((w, g) for g, (n, w) in heavy.items() if n == node), key=lambda x: (-x[0], bytes(x[1])))
            light = seen[node]["w"] if node in seen else 0
            total = light + sum(w for w, _ in own)
            alone = own and own[0][0] >= total / (ends[node] - node)  # it fills a leaf
            mid = node + 1 if alone else (node + ends[node]) // 2
            left = total * (mid - node) / (ends[node] - node)
            right = total - left
            if alone:
                left, own = left - own[0][0], own[1:]
            for w, g in own:
                heavy[g] = (node, w) if left >= right else (mid, w)
                left, right = (left - w, right) if left >= right else (left, right - w)
            todo[node] = {"mid": mid, "d": 0, "cut": (0.0, 0.0)}
            if node in seen:
                r = seen[node]
                d = r["wide"].index(max(r["wide"]))
                cut = (r["lo"][d], -math.inf) if left <= 0 else (math.nextafter(r["hi"][d], math.inf), -math.inf) if left >= light else None
                todo[node] = {"mid": mid, "d": d, "lo": r["lo"][d], "hi": r["hi"][d], "want": left, "below": 0.0, "value": None, "cut": cut}
        while any(t["cut"] is None for t in todo.values()):
            _narrow(now, dims, {n: t for n, t in todo.items() if t["cut"] is None}, near * leaf)
        cuts = groups.sparkSession.createDataFrame([(n, t["mid"], t["d"] + 1, *map(float, t["cut"])) for n, t in todo.items()], "node int, mid int, d int, value double, edge double")
        x = F.element_at(F.array(*dims), F.col("d"))
        high = (x > F.col("value")) | ((x == F.col("value")) & (F.col("tie") >= F.col("edge")))
        now = stage(now.join(F.broadcast(cuts), "node", "left").select(
            "g", "w", *dims, "tie", F.when(high, F.col("mid")).otherwise(F.col("node")).alias("node")
        ))
        for node, t in todo.items():
            ends[t["mid"]], ends[node] = ends[node], t["mid"]


def _narrow(rows: DataFrame, dims: list[str], todo: dict[int, dict], near: float) -> None:
    """One histogram pass over all the nodes of ``todo``; sets "cut" where a node's median is close enough."""
    spans = rows.sparkSession.createDataFrame(
        [(n, t["d"] + 1, float(t["lo"]), float(t["hi"]), t["value"]) for n, t in todo.items()],
        "node int, d int, lo double, hi double, value double",
    )
    of_dim = F.element_at(F.array(*dims), F.col("d"))
    x = F.when(F.col("value").isNull(), of_dim).when(of_dim == F.col("value"), F.col("tie"))
    step = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    got = (
        rows.join(F.broadcast(spans), "node").select("node", "w", "lo", "hi", x.alias("x"))
        .where(F.col("x").between(F.col("lo"), F.col("hi")))
        .groupBy("node", F.when(F.col("hi") > F.col("lo"), step).otherwise(0).alias("b"))
        .agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    )
    for node, t in todo.items():
        below = t["below"]
        for r in sorted((r for r in got if r["node"] == node), key=lambda r: r["b"]):
            if below + r["w"] >= t["want"]:
                break
            below += r["w"]
        over = below + r["w"] - t["want"] < t["want"] - below  # the far edge of the bin is nearer
        if t["value"] is not None and (r["w"] <= near or r["lo"] == r["hi"]):
            t["cut"] = (t["value"], math.nextafter(r["hi"], math.inf) if over else r["lo"])
        elif r["w"] <= near:
            t["cut"] = (math.nextafter(r["hi"], math.inf) if over else r["lo"], -math.inf)
        elif r["lo"] == r["hi"]:  # one value holds more than that: cut among its groups by their hash
            t.update(value=r["lo"], lo=-(2.0**63), hi=2.0**63, below=below)
        else:
            t.update(lo=r["lo"], hi=r["hi"], below=below)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source) with shard and slot under the law ``bytes``.

    A leaf's target is an equal part of all bytes. Equal texts go to one shard together, so sizes are near
    equal unless one text's copies outweigh a whole shard. Repeated rows are copies. A null doc_id, language or source counts as -1 or as a
    value of its own. Dimensions are the doc_id, the text's
    bytes (log), language and source (hashed) of a text's least copy; nulls count as -1. A null text has
    size 1 and goes with the empty ones. Ties are cut by a hash of the text. With fewer distinct
    texts than shards some shards stay empty; an empty table gives no rows. Slots are numbered in
    PARTS hash parts a shard and shifted by the parts' row counts, so no task numbers a whole shard.
    """
    dims = {
        "d_id": F.col("doc_id"), "d_size": F.log2(byte_size(F.col("text"))),
        "d_lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)), "d_source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)),
    }
    docs = docs.select("doc_id", "text", "lang", "source")
    groups = stage(_groups(docs, dims))
    place = kd_tree(groups, list(dims), shards)
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("g"))
    part = F.pmod(F.xxhash64("doc_id", "g"), F.lit(PARTS)).cast("int").alias("part")
    placed = stage(rows.join(place, "g").select("doc_id", "size", "text_crc32", "shard", part))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
