"""Conversation state as windows over events: context, fragments, gates, strikes, changes, alerts.

Event time stands in for the clock, so results can be repeated: "now" is the current row's time, and
a limit of m milliseconds is a range of m - 1. Every window is partitioned by its channel, user or key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tables as T
from . import derive as D

CONTEXT_MS, CONTEXT_ROWS, FRAGMENT_MS, STRIKE_MS, STRIKES, BACKLOG = 600_000, 24, 180_000, 600_000, 3, 50


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def recent_context(messages: DataFrame, within: int = CONTEXT_MS, most: int = CONTEXT_ROWS) -> DataFrame:
    """``messages`` (channel, id, ms, ...) with context: ids of the channel's last ``most`` messages within the time, itself last."""
    near = Window.partitionBy("channel").orderBy("ms").rangeBetween(-(within - 1), 0)
    upto = F.filter(F.array_sort(F.collect_list(F.struct("ms", "id")).over(near)), lambda s: (s["ms"] < F.col("ms")) | (s["id"] <= F.col("id")))
    rows = D.pinned(messages.withColumn("__near", upto), seen=F.col("__near"))
    last = F.slice("seen", F.greatest(F.size("seen") - most + 1, F.lit(1)), F.lit(most))
    return rows.withColumn("context", F.transform(last, lambda s: s["id"])).drop("__near", "seen")


def latest_versions(events: DataFrame) -> DataFrame:
    """The newest version of each message of a change stream (channel, id, ms, version, op, ...), deleted ones gone."""
    newest = Window.partitionBy("channel", "id").orderBy(F.col("version").desc())
    return events.withColumn("__n", F.row_number().over(newest)).where((F.col("__n") == 1) & (F.col("op") != "delete")).drop("__n")


def fragment(norm: Column) -> Column:
    """A message's letters if there are one to four, else empty."""
    letters = F.regexp_replace(norm, "[^a-z]", "")
    return F.when(F.length(letters).between(1, 4), letters).otherwise("")


def fragment_join(messages: DataFrame, answers: DataFrame, within: int = FRAGMENT_MS) -> DataFrame:
    """(channel, end_id, n, answer...): the shortest run of 2 to 5 messages, each a fragment, that ends here and spells an answer.

    Runs are neighbouring messages of a channel within ``within`` of their end; a message without a
    fragment breaks a run.
    """
    order = Window.partitionBy("channel").orderBy("ms", "id")
    rows = messages
    for k in range(1, 5):
        rows = rows.withColumn(f"f{k}", F.lag("fragment", k).over(order)).withColumn(f"m{k}", F.lag("ms", k).over(order))
    text, whole, runs = F.col("fragment"), F.col("fragment") != "", []
    for k in range(1, 5):
        text = F.concat(F.col(f"f{k}"), text)
        whole = whole & (F.col(f"f{k}") != "") & (F.col("ms") - F.col(f"m{k}") < within)
        runs.append(F.when(whole, F.struct(F.lit(k + 1).alias("n"), text.alias("joined"))))
    found = rows.select("channel", F.col("id").alias("end_id"), F.explode(F.array_compact(F.array(*runs))).alias("r"))
    hits = found.select("channel", "end_id", "r.n", "r.joined").join(D.small(answers.withColumn("joined", F.col("answer"))), "joined")
    return hits.groupBy("channel", "end_id").agg(F.min(F.struct("n", "answer_ord", "answer")).alias("h")).select("channel", "end_id", "h.n", "h.answer_ord", "h.answer")


def backlog(messages: DataFrame, most: int = BACKLOG) -> DataFrame:
    """The latest ``most`` messages of each channel (channel, id, ms, ...) with their place in time order."""
    newest = Window.partitionBy("channel").orderBy(F.col("ms").desc(), F.col("id").desc())
    kept = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy("ms", "id")))


def suspicious(text: Column) -> Column:
    return F.coalesce(text.rlike(T.SUSPICIOUS), F.lit(False))


def hot(events: DataFrame, flag: str, within: int = CONTEXT_MS) -> DataFrame:
    """``events`` (channel, id, ms, ...) with hot: a flagged event of the channel came at most ``within`` ago, this one's own included."""
    order = Window.partitionBy("channel").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(flag), F.col("ms")), ignorenulls=True).over(order)
    return events.withColumn("hot", F.coalesce(F.col("ms") - last < within, F.lit(False)))


def route(enabled: Column, every: Column, media: Column, suspect: Column, hot_: Column) -> Column:
    """Why a message goes to the judge, or ``skip``."""
    return F.when(~enabled, "skip").when(every, "all").when(media, "media").when(suspect, "suspicious").when(hot_, "hot").otherwise("skip")


def strikes(events: DataFrame, within: int = STRIKE_MS, most: int = STRIKES) -> DataFrame:
    """(user, id, ms, held, fired): strikes held after each event, and whether it was the ``most``-th within the time, which clears them.

    The clearing makes this a fold, not a frame. Events are dealt by user and sorted, and each task folds
    them as they stream by, holding ``most`` stamps of one user at a time.
    """
    schema = events.select("user", "id", "ms").schema.add("held", "integer").add("fired", "boolean")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, live = object(), []
        for part in parts:
            held, fired = [], []
            for u, ms in zip(part["user"].tolist(), part["ms"].tolist(), strict=True):
                if u != user:
                    user, live = u, []
                live = [t for t in live if ms - t < within] + [ms]
                held.append(len(live))
                fired.append(len(live) >= most)
                if fired[-1]:
                    live = []
            yield part.assign(held=held, fired=fired)

    return events.select("user", "id", "ms").where(F.col("user").isNotNull()).repartition("user").sortWithinPartitions("user", "ms", "id").mapInPandas(fold, schema)


def changed(events: DataFrame, key: str, value: Column) -> DataFrame:
    """Events (key, id, ms, ...) whose value differs from the key's last one; the first of a key counts as a change."""
    order = Window.partitionBy(key).orderBy("ms", "id")
    rows = events.withColumn("__fp", F.sha2(value, 256))
    rows = rows.withColumn("__before", F.lag("__fp").over(order))
    return rows.where(~F.col("__fp").eqNullSafe(F.col("__before"))).drop("__fp", "__before")


def issue_class(issue: Column) -> Column:
    """Class of an inspection's issue, first match first."""
    out = F.lit("incomplete coverage")
    for pattern, name in reversed(T.ISSUE_CLASSES):
        out = F.when(issue.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def alert_rollup(events: DataFrame, window: str = "60 seconds", samples: int = 3) -> DataFrame:
    """(guild, start, n, reasons, samples): events (guild, ts, id, issues) of each window, reasons counted once an event."""
    rows = events.withColumn("start", F.window("ts", window)["start"])
    named = F.array_distinct(F.transform("issues", issue_class))
    reasons = F.when(F.size("issues") > 0, named).otherwise(F.array(F.lit("incomplete coverage")))
    each = rows.select("guild", "start", F.explode(reasons).alias("reason")).groupBy("guild", "start", "reason").agg(F.count("*").alias("c"))
    by = each.groupBy("guild", "start").agg(F.array_sort(F.collect_list(F.struct("reason", "c"))).alias("reasons"))
    first = Window.partitionBy("guild", "start").orderBy("id")
    kept = rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= samples)
    sample = kept.groupBy("guild", "start").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return rows.groupBy("guild", "start").agg(F.count("*").alias("n")).join(by, ["guild", "start"]).join(sample, ["guild", "start"])
