"""Replays: evaluation cases through detector and conversation, held fragments, judge batches, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.detector import Detector, only_letters

FRAGMENT_LETTERS, FRAGMENT_RUN, HELD, BATCH = 4, 5, 12, 20


def _spelt(fragments: list[tuple[str, str, int]], answers: set[str], within: int) -> list[str]:
    """Ids of the shortest run of fragments (id, letters, ms) that ends here and spells an answer, or none."""
    text, now = fragments[-1][1], fragments[-1][2]
    for k in range(2, FRAGMENT_RUN + 1):
        if len(fragments) < k or not fragments[-k][1] or now - fragments[-k][2] >= within:
            break
        text = fragments[-k][1] + text
        if text in answers:
            return [i for i, _, _ in fragments[-k:]]
    return []


def replay(cases: DataFrame, tool: Detector, within: int = 180_000) -> DataFrame:
    """(case, removed): ids that each case's messages (case, place, id, text, ms) lose, in order, with a conversation of its own.

    A message that reveals an answer goes; one that completes an answer in fragments takes its contributors along. Cases
    are replayed in sorted partitions as they stream by, a case's last few fragments being the state.
    """
    answers = set(tool.answers)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, removed, recent = None, [], []
        for part in parts:
            out = []
            for c, i, text, ms in zip(part["case"], part["id"], part["text"], part["ms"], strict=True):
                if c != case:
                    if case is not None:
                        out.append((case, removed))
                    case, removed, recent = c, [], []
                if tool.scan(text):
                    removed.append(i)
                    continue
                letters = only_letters(tool.normalize(text or ""))
                recent.append((i, letters if len(letters) <= FRAGMENT_LETTERS else "", ms))
                recent = recent[-FRAGMENT_RUN:]
                if recent[-1][1] and (gone := _spelt(recent, answers, within)):
                    removed += [g for g in gone if g not in removed]
                    recent = [r for r in recent if r[0] not in gone]
            yield pd.DataFrame(out, columns=["case", "removed"])
        if case is not None:
            yield pd.DataFrame([(case, removed)], columns=["case", "removed"])

    rows = cases.where(F.col("case").isNotNull()).select("case", "place", "id", "text", "ms").repartition("case").sortWithinPartitions("case", "place")
    return rows.mapInPandas(run, "case string, removed array<string>")


def held_fragments(messages: DataFrame, tool: Detector) -> DataFrame:
    """(author, id, hit): short survivors of a lone author (author, place, id, text) are held, up to HELD, and read together and spaced; a hit clears them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        author, held = None, []
        for part in parts:
            out = []
            for a, i, text in zip(part["author"], part["id"], part["text"], strict=True):
                if a != author:
                    author, held = a, []
                hit = tool.scan(text)
                if not hit and text and len(text.strip()) <= 3:
                    held = [*held, text.strip()][-HELD:]
                    hit = tool.scan("".join(held)) or tool.scan(" ".join(held)) if len(held) > 1 else None
                    held = [] if hit else held
                out.append((a, i, hit))
            yield pd.DataFrame(out, columns=["author", "id", "hit"])

    rows = messages.select("author", "place", "id", "text").where(F.col("author").isNotNull()).repartition("author").sortWithinPartitions("author", "place")
    return rows.mapInPandas(run, "author string, id string, hit string")


def judged(rows: DataFrame, judge: Callable[[list[str]], list[str | None]], size: int = BATCH) -> DataFrame:
    """(id, verdict) of ``rows`` (id, text) by a judge called with ``size`` texts at most; a failed call's rows are ``failed``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said: list[str | None] = []
            for at in range(0, len(part), size):
                texts = part["text"].iloc[at : at + size].tolist()
                try:
                    said += judge(texts)
                except Exception:  # a judge may fail in any way; its batch is marked, others go on
                    said += ["failed"] * len(texts)
            yield pd.DataFrame({"id": part["id"], "verdict": said})

    return rows.select("id", "text").mapInPandas(run, rows.select("id").schema.add("verdict", "string"))


def overload(results: DataFrame) -> DataFrame:
    """(n, rejected, expired): results (issues) that a full queue rejected or a wait expired."""
    return results.agg(F.count("*").alias("n"), F.count_if(F.array_contains("issues", "queue full")).alias("rejected"), F.count_if(F.array_contains("issues", "queue expired")).alias("expired"))


def run_cost(jobs: Column, input_tokens: Column, single: Column, batch: Column, price_in: float, price_out: float) -> Column:
    """Estimated dollars of a generation run: 45 output tokens a single example, 120 a conversation; half price in batches."""
    dollars = jobs * (input_tokens * price_in + F.when(single, 45).otherwise(120) * price_out) / 1e6
    return F.when(batch, dollars / 2).otherwise(dollars)


def grey_peak(pixels: DataFrame) -> DataFrame:
    """(image, peak): most frequent grey of 8 to 247 of each image's pixels (image, grey), the darkest of equals, null below 1% of the pixels."""
    counts = pixels.groupBy("image", "grey").agg(F.count("*").alias("n"))
    inner = F.col("grey").between(8, 247)
    best = counts.groupBy("image").agg(F.max(F.when(inner, F.struct("n", (-F.col("grey")).alias("g")))).alias("b"), F.sum("n").alias("total"))
    return best.select("image", F.when(F.col("b.n") >= 0.01 * F.col("total"), -F.col("b.g")).alias("peak"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(loss, accuracy): mean of the batch losses, share of predictions equal to the label, over rows (batch, loss, label, predicted)."""
    by = rows.groupBy("batch").agg(F.avg("loss").alias("l"), F.sum((F.col("label") == F.col("predicted")).cast("int")).alias("r"), F.count("*").alias("n"))
    return by.agg(F.avg("l").alias("loss"), (F.sum("r") / F.sum("n")).alias("accuracy"))


def batch_seconds(queries: DataFrame, size: int) -> DataFrame:
    """(batch, seconds): time of each batch of ``size`` queries (place, seconds); the last may be short."""
    return queries.groupBy(F.floor(F.col("place") / size).alias("batch")).agg(F.sum("seconds").alias("seconds"))


def report(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """Write each small aggregate as JSON below ``path``."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def newest_runs(results: DataFrame, most: int = 1) -> DataFrame:
    """The latest ``most`` results of each case (case, at, ...)."""
    order = Window.partitionBy("case").orderBy(F.col("at").desc())
    return results.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
