"""The detector over a table: each text is scanned whole by all rules, Arrow batch by Arrow batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.detector import Detector

#: Texts of an Arrow batch that are held as Python strings at a time.
ROWS = 256


def detector(answers: DataFrame, words: DataFrame, **options) -> Detector:
    """A detector of the ``answers`` (answer_ord, answer) with the dictionary (word, any others), of whatever size.

    Only the words that any rule would ask the dictionary about come to the driver: those which, were
    they not listed, would pass for an answer or a piece of one. Their number follows the answers and not the dictionary.
    """
    names = [r.answer for r in answers.orderBy("answer_ord").collect()]
    bare = Detector(names)

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in part.column(0).to_pylist() if bare.asks(w)], pa.string())], names=["word"])

    kept = words.select("word").where(F.col("word").isNotNull()).distinct().mapInArrow(asked, "word string")
    return Detector(names, frozenset(r.word for r in kept.collect()), **options)


def scan(rows: DataFrame, tool: Detector, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``rows`` and hit: the first answer that the whole text reveals, or null (null and empty texts too)."""

    sent = rows.sparkSession.sparkContext.broadcast(tool)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                hits = [sent.value.scan(t) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(hits, pa.string())], names=[*keep, "hit"])

    source = rows.select(*keep, F.col(text).alias("__text"))
    return source.mapInArrow(run, rows.select(*keep).schema.add("hit", "string"))
