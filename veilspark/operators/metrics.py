"""Evaluation metrics as aggregates: rates, thresholds, curves, percentiles, costs, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import part_of, running

LABELS = ["direct", "strong_hint", "weak_hint", "benign"]


def label_counts(rows: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """(label, n) for every label, zeros too."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "label string")
    return every.join(rows.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def threshold_at_budget(rows: DataFrame, per_10k: float) -> DataFrame:
    """(threshold): the score above which deletions keep to ``per_10k`` of benign rows; 0 where the budget covers all.

    The k-th largest benign score, k from the count: scores are counted once each, and the one is taken that the
    counts of those above it lead up to.
    """
    benign = rows.where(F.col("label") == "benign").select("score")
    n = benign.count()
    allowed = int(n * per_10k / 10_000)
    if allowed >= n:
        return rows.sparkSession.createDataFrame([(0.0,)], "threshold double")
    at = benign.where(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"))
    above = running(at, part_of(at, -F.col("score")), [F.col("score").desc()], {"above": F.col("n")})
    return above.where((F.col("above") <= allowed) & (F.col("above") + F.col("n") > allowed)).agg(F.min("score").alias("threshold"))


def rates(rows: DataFrame, threshold: float) -> DataFrame:
    """(recall, fp_per_10k) of deleting scores above the threshold; null for a class without rows."""
    over = (F.col("score") > threshold).cast("int")
    benign = F.col("label") == "benign"
    return rows.agg(F.avg(F.when(~benign, over)).alias("recall"), (F.avg(F.when(benign, over)) * 10_000).alias("fp_per_10k"))


def breakdown(rows: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, n, deleted): share deleted of each group that has rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("score") > threshold).cast("int")).alias("deleted"))


def curve(rows: DataFrame) -> DataFrame:
    """(threshold, recall, fp_per_10k) at -1 and at every distinct score, strictly above it.

    Scores are counted once; how many lie above each is a running sum over the distinct scores.
    """
    benign = (F.col("label") == "benign").cast("int")
    at = rows.groupBy("score").agg(F.sum(1 - benign).alias("bad"), F.sum(benign).alias("good"))
    total = at.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    over = running(at, part_of(at, -F.col("score")), [F.col("score").desc()], {"b": F.col("bad"), "g": F.col("good")})
    points = over.select(F.col("score").alias("threshold"), F.col("b").cast("long").alias("b"), F.col("g").cast("long").alias("g"))
    floor = total.select(F.lit(-1.0).alias("threshold"), F.col("all_bad").alias("b"), F.col("all_good").alias("g"))
    both = points.where(F.col("threshold") != -1.0).unionByName(floor).crossJoin(F.broadcast(total))
    return both.select("threshold", F.try_divide("b", "all_bad").alias("recall"), (F.try_divide("g", "all_good") * 10_000).alias("fp_per_10k"))


def nearest_rank(value: str, by: list[str], ps: dict[str, float]) -> list[Column]:
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in ps.items()]


def eval_summary(cases: DataFrame) -> DataFrame:
    """One row of totals over cases (id, expected array, removed array, complete boolean, latency)."""
    missed = F.size(F.array_except("expected", "removed")) > 0
    false = F.size(F.array_except("removed", "expected")) > 0
    attacks = F.size("expected") > 0
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(attacks).alias("attacks"), F.count_if(attacks & missed).alias("missed"),
        F.count_if(false).alias("false_deletions"), F.count_if(~F.col("complete")).alias("incomplete"),
        F.try_divide(F.count_if(attacks & ~missed), F.count_if(attacks)).alias("recall"),
        *nearest_rank("latency", [], {"p50": 0.5, "p95": 0.95}),
    )


#: Kinds of tokens that a price list prices: cache writes by how long the cache holds them.
PRICED = ["input", "output", "cache_read", "cache_write_5m", "cache_write_1h"]


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, cost): dollars of each request (id, model, cache_write, and the kinds of PRICED); null where the model or a count is unknown.

    A model is priced by its own name or by one it continues after a dash. Prices (model, PRICED) are a short list.
    It is an error if the cache writes by kind don't add up to all of them. Missing counts of cache writes are 0.
    """
    listed = {r["model"]: [float(r[c]) for c in PRICED] for r in prices.collect()}
    parts = F.split("model", "-")
    names = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    table = F.create_map(*[x for m, p in listed.items() for x in (F.lit(m), F.array(*map(F.lit, p)))]) if listed else F.create_map().cast("map<string,array<double>>")
    price = F.get(F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda p: p.isNotNull()), F.lit(0))
    none = F.lit(0).cast("long")
    written = [F.coalesce(F.col(c), none) for c in PRICED[3:]]
    apart = written[0] + written[1] != F.coalesce(F.col("cache_write"), none)
    counts = [F.col(c) for c in PRICED[:3]] + written
    cost = sum((c * F.get("price", F.lit(i)) for i, c in enumerate(counts)), F.lit(0.0)) / 1e6
    priced = usage.withColumn("price", price)
    return priced.select("id", F.when(apart, F.raise_error(F.lit("cache writes by kind don't add up"))).otherwise(cost).alias("cost"))


def total_or_null(value: Column) -> Column:
    """Sum that is null if any part is, and 0 of nothing."""
    return F.when(F.count_if(value.isNull()) > 0, F.lit(None)).otherwise(F.coalesce(F.sum(value), F.lit(0.0)))


def detector_report(rows: DataFrame) -> DataFrame:
    """(style, n, caught, recall) of direct rows (label, style, hit), the worst style first by recall."""
    own = rows.where(F.col("label") == "direct").groupBy("style").agg(F.count("*").alias("n"), F.count_if("hit").alias("caught"))
    return own.withColumn("recall", F.col("caught") / F.col("n"))


def false_positives(rows: DataFrame) -> DataFrame:
    """Rows (label, style, hit, any others) that are hit though they aren't direct."""
    return rows.where((F.col("label") != "direct") & F.col("hit"))


def pass_through(rows: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """(label, n, passed) for every label: rows, and those without a hit, which the next layer sees."""
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    seen = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("passed"))
    return every.join(seen, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "passed")])


def ledger(attacks: DataFrame) -> DataFrame:
    """(technique, total, caught, lost, won) of attacks (technique, closed, caught): closed ones that slip through, and open ones that are caught now."""
    return attacks.groupBy("technique").agg(
        F.count("*").alias("total"), F.count_if("caught").alias("caught"),
        F.count_if(F.col("closed") & ~F.col("caught")).alias("lost"), F.count_if(~F.col("closed") & F.col("caught")).alias("won"),
    )


def outcome(intent: Column, caught: Column) -> Column:
    """Outcome of an attempt: a leak caught or missed, an innocent message caught or let through."""
    innocent = intent == "innocent"
    return F.when(innocent & caught, "false_alarm").when(innocent, "passed").when(caught, "caught").otherwise("missed")


def bootstrap(rows: DataFrame, threshold: float, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(measure, low, high): 95% intervals of recall and false positives by a Poisson bootstrap.

    Each row draws one Poisson(1) weight a round from a hash of its id, the round and the seed, so resampling is one pass
    without shuffling rows, and reruns agree. It is not the draw with replacement of a fixed n, whose intervals it approaches.
    """
    u = F.pmod(F.xxhash64("id", "round", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    edges = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080]
    weight = sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))
    over = F.col("score") > threshold
    drawn = rows.select("id", "label", over.alias("over"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    benign = F.col("label") == "benign"

    def share(cls: Column) -> Column:
        return F.try_divide(F.sum(F.when(cls & F.col("over"), F.col("w")).otherwise(0)), F.sum(F.when(cls, F.col("w")).otherwise(0)))

    each = drawn.groupBy("round").agg(share(~benign).alias("recall"), (share(benign) * 10_000).alias("fp_per_10k"))
    cols = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("recall", "fp_per_10k")]
    return each.select(F.explode(F.array(*cols)).alias("x")).groupBy("x.measure").agg(F.percentile("x.v", 0.025).alias("low"), F.percentile("x.v", 0.975).alias("high"))
