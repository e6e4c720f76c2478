"""Stateful streams: a channel's recent context, strikes with clearing, and windowed alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import CONTEXT_MS, CONTEXT_ROWS, STRIKE_MS, STRIKES, issue_class

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State in RocksDB, which transformWithState needs; call before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Context(StatefulProcessor):
    """Keeps a channel's last messages: creates and updates replace by id, deletes remove; each create gives its context."""

    def __init__(self, within: int = CONTEXT_MS, most: int = CONTEXT_ROWS):
        self.within, self.most = within, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "id long, ms long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = {r[0]: (int(r[1]), r[2]) for r in self.rows.get()} if self.rows.exists() else {}
        events = sorted((e for part in rows for e in part[["ms", "id", "op", "text"]].itertuples(index=False, name=None)), key=lambda e: (e[0], e[1]))
        out = []
        for ms, id_, op, text in events:
            if op == "delete":
                held.pop(int(id_), None)
                continue
            held[int(id_)] = (int(ms), text)
            live = sorted(((m, i) for i, (m, _) in held.items() if ms - m < self.within and m <= ms))[-self.most :]
            held = {i: held[i] for _, i in live}
            if op == "create":
                out.append((key[0], int(id_), int(ms), ",".join(str(i) for _, i in live)))
        if held:
            self.rows.put([(i, m, t) for i, (m, t) in held.items()])
        else:
            self.rows.clear()
        yield pd.DataFrame(out, columns=["channel", "id", "ms", "context"])

    def close(self) -> None:
        pass


def contexts(events: DataFrame, within: int = CONTEXT_MS, most: int = CONTEXT_ROWS) -> DataFrame:
    """(channel, id, ms, context) of a stream of (channel, id, ms, op, text); state is at most ``most`` rows a channel."""
    schema = "channel long, id long, ms long, context string"
    return events.groupBy("channel").transformWithStateInPandas(Context(within, most), outputStructType=schema, outputMode="Append", timeMode="None")


class Strikes(StatefulProcessor):
    """Stamps of a user's strikes within the time; the last of ``most`` fires and clears them."""

    def __init__(self, within: int = STRIKE_MS, most: int = STRIKES):
        self.within, self.most = within, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getListState("stamps", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        live = [int(r[0]) for r in self.stamps.get()] if self.stamps.exists() else []
        events = sorted((int(ms), int(i)) for part in rows for ms, i in part[["ms", "id"]].itertuples(index=False, name=None))
        out = []
        for ms, i in events:
            live = [t for t in live if ms - t < self.within] + [ms]
            fired = len(live) >= self.most
            out.append((key[0], i, ms, len(live), fired))
            if fired:
                live = []
        if live:
            self.stamps.put([(t,) for t in live])
        else:
            self.stamps.clear()
        yield pd.DataFrame(out, columns=["user", "id", "ms", "held", "fired"])

    def close(self) -> None:
        pass


def strikes(events: DataFrame, within: int = STRIKE_MS, most: int = STRIKES) -> DataFrame:
    """(user, id, ms, held, fired) of a stream of (user, id, ms); state is at most ``most`` stamps a user."""
    schema = "user long, id long, ms long, held int, fired boolean"
    return events.groupBy("user").transformWithStateInPandas(Strikes(within, most), outputStructType=schema, outputMode="Append", timeMode="None")


def alerts(events: DataFrame, window: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """(guild, start, reason, n): reasons of a stream of (guild, ts timestamp, issues) by window; later events than ``late`` are dropped."""
    reasons = F.when(F.size("issues") > 0, F.array_distinct(F.transform("issues", issue_class))).otherwise(F.array(F.lit("incomplete coverage")))
    rows = events.withWatermark("ts", late).select("guild", "ts", F.explode(reasons).alias("reason"))
    return rows.groupBy("guild", F.window("ts", window).alias("w"), "reason").agg(F.count("*").alias("n")).select("guild", F.col("w.start").alias("start"), "reason", "n")
