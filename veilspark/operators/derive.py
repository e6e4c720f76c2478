"""The build side: answers, the dictionary, the vocabulary, and every encoded form of an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import tables as T
from ..functions import text as X
from . import reader as R

#: Forms and answers above this many rows are not broadcast by hint; Spark then picks the join.
BROADCAST_ROWS = 200_000
#: Values of a filter inside arrays at most; with more, elements are exploded and joined.
LISTED = 5_000


def answers(words: DataFrame) -> DataFrame:
    """(answer_ord, answer): the distinct words of (word), ordered; a set of a few dozen to a few thousand."""
    order = Window.orderBy("word")
    one = words.where(F.col("word").isNotNull()).select(F.lower("word").alias("word")).distinct()
    return one.select(F.row_number().over(order).alias("answer_ord"), F.col("word").alias("answer"))


def small(df: DataFrame) -> DataFrame:
    """``df`` computed once, as rows of the plan with a broadcast hint, if these are BROADCAST_ROWS at most; else as it is."""
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= BROADCAST_ROWS else df


def listed(values: DataFrame) -> list[str] | None:
    """The distinct values of a one-column table, if they are LISTED at most: so many that a filter can hold."""
    found = [r[0] for r in values.distinct().limit(LISTED + 1).collect() if r[0] is not None]
    return found if len(found) <= LISTED else None


def among(array: Column, values: list[str] | None) -> Column:
    """The elements of an array that are among the values (by a hash set, before anything is exploded); all if there is no list."""
    return array if values is None else F.filter(array, lambda x: x.isin(values))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once a row.

    A column that a lambda of a later step refers to would otherwise be put into that lambda and
    computed for each of its elements; a one-element explode keeps it a column.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n_docs) of (doc_id, text): distinct tokens, so that matchers work on each once."""
    return R.counted(docs)


def dictionary(vocab: DataFrame, least: int = 3) -> DataFrame:
    """(word): all-letter tokens of at least ``least`` documents, standing in for a word list."""
    return vocab.where((F.col("n_docs") >= least) & F.col("token").rlike("^[a-z]+$")).select(F.col("token").alias("word"))


def _single(answers_: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("form")) for k, c in kinds.items()])
    return answers_.select("answer_ord", "answer", F.explode(rows).alias("f")).select("answer_ord", "answer", "f.kind", "f.form")


def _many(answers_: DataFrame, kind: str, forms: Column) -> DataFrame:
    return answers_.select("answer_ord", "answer", F.lit(kind).alias("kind"), F.explode(forms).alias("form"))


def exact_forms(answers_: DataFrame) -> DataFrame:
    """Forms that a token may equal: the word, turned, enciphered, encoded, typed beside, and in pig Latin."""
    a = F.col("answer")
    one = _single(answers_, {
        "plain": a, "reverse": F.reverse(a), "rot13": X.rotated(a, 13), "atbash": X.atbash(a),
        "base64": F.lower(F.regexp_replace(F.base64(a.cast("binary")), "=+$", "")),
        "hex": F.lower(F.hex(a)), "hex_upper": F.lower(F.hex(F.upper(a))), "keypad": X.keypad(a),
        "key_left": X.key_shift(a, -1), "key_right": X.key_shift(a, 1),
    })
    return one.where(F.col("form").isNotNull()).unionByName(_many(answers_, "pig_latin", X.pig_latin(a))).distinct()


def inflections(answers_: DataFrame) -> DataFrame:
    """The answer with each ending; without a final e or y where an ending replaces it."""
    a = F.col("answer")
    stem = F.substring(a, F.lit(1), F.length(a) - 1)

    def with_(base: Column, ends: list[str]) -> Column:
        return F.array(*[F.concat(base, F.lit(e)) for e in ends])

    none = F.array().cast("array<string>")
    forms = F.concat(
        with_(a, T.SUFFIXES), F.when(F.endswith(a, F.lit("e")), with_(stem, T.SUFFIXES_E)).otherwise(none),
        F.when(F.endswith(a, F.lit("y")), with_(stem, T.SUFFIXES_Y)).otherwise(none),
    )
    return _many(answers_, "inflection", F.array_distinct(forms))


def caesar_forms(answers_: DataFrame) -> DataFrame:
    return _many(answers_, "caesar", F.array_distinct(F.array(*[X.rotated(F.col("answer"), n) for n in range(26)])))


def key_forms(answers_: DataFrame) -> DataFrame:
    """Letter keys of the fuzzy rules: sorted, undoubled, consonants, Morse."""
    a = F.col("answer")
    return _single(answers_, {"sorted": X.sorted_letters(a), "undoubled": X.undoubled(a), "consonants": X.consonants(a), "morse": X.morse(a)})


def all_forms(answers_: DataFrame) -> DataFrame:
    """Every derived form in long shape: (answer_ord, answer, kind, form)."""
    return reduce(DataFrame.unionByName, [exact_forms(answers_), inflections(answers_), caesar_forms(answers_), key_forms(answers_)])


def accepted(answers_: DataFrame) -> DataFrame:
    """(form, answer_ord, answer): what counts as an exact hit, each form with its first answer."""
    both = exact_forms(answers_).unionByName(inflections(answers_))
    return both.groupBy("form").agg(F.min(F.struct("answer_ord", "answer")).alias("a")).select("form", "a.answer_ord", "a.answer")


def benchmark_answers(spark: SparkSession, sf_dir: str, length: int = 5) -> DataFrame:
    """The protected words of the test tables: distinct words of the benchmark of one length."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = bench.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return answers(words.where(F.length("word") == length))
