"""Rules that read across the tokens of one text: joined words, streams of letters, grids, boundaries, edits.

Each works row by row on arrays of a text's own tokens, so nothing is shuffled but the few hits.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from . import derive as D
from . import match as M
from . import reader as R

#: Parts joined at most, letters that a joined word may exceed the longest answer by, caps of a stream and of a grid.
JOIN_PARTS, JOIN_SLACK, SHORT_STREAM, LONG_STREAM, GRID_ROWS, GRID_COLUMNS = 12, 3, 12, 40, 40, 80
#: An answer's columns in a schema.
HIT = "answer_ord int, answer string"


def forms_of(forms: DataFrame, form: str = "form") -> dict[str, list[tuple]]:
    """The answers (answer_ord, answer) of each form, on the driver: a few for each answer."""
    found: dict[str, list[tuple]] = {}
    for r in forms.select(form, *M.ANSWER).distinct().collect():
        found.setdefault(r[0], []).append((r[1], r[2]))
    return found


def split_words(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, pos, n, joined, answer...) of (doc_id, text) where neighbouring parts together are an accepted form, look-alikes read too."""
    longest = answers.agg(F.max(F.length("answer"))).first()[0] or 0
    read = partial(R.split_words, accepted=forms_of(D.accepted(answers)), most=longest + JOIN_SLACK, parts=JOIN_PARTS)
    return R.by_text(docs, read, f"pos int, n int, joined string, {HIT}").distinct()


def in_stream(streams: DataFrame, answers: DataFrame, cap: int) -> DataFrame:
    """(doc_id, stream, answer...): a stream of three letters or more is an accepted form or, up to ``cap``, holds an answer either way round."""
    fit = streams.where(F.length("stream") >= 3)
    whole = M.exact(fit.withColumn("token", F.col("stream")), answers).select("doc_id", "stream", *M.ANSWER)
    both = answers.select(F.explode(F.array("answer", F.reverse("answer"))).alias("form"), *M.ANSWER)
    lengths = F.array(*[F.lit(r[0]) for r in answers.select(F.length("answer")).distinct().collect()] or [F.lit(0)])
    none = F.array().cast("array<int>")
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.when(F.length("stream") >= n, F.sequence(F.lit(1), F.length("stream") - n + 1)).otherwise(none), lambda i: F.substring(F.col("stream"), i, n)
    )))
    pieces = D.among(F.array_distinct(pieces), D.listed(both.select("form")))
    held = fit.where(F.length("stream") <= cap).withColumn("__p", F.explode(pieces))
    held = held.join(D.small(both.withColumnRenamed("form", "__p")), "__p").select("doc_id", "stream", *M.ANSWER)
    return whole.unionByName(held).distinct()


def letter_stream(tokens: Column) -> Column:
    """Single letters, digits and symbols, and letters with a number beside, in order."""
    kept = F.filter(tokens, lambda t: t.rlike(r"^(?:[a-z0-9@$!|+]|[a-z][0-9]{1,2}|[0-9]{1,2}[a-z])$"))
    return F.array_join(F.transform(kept, lambda t: F.when(F.length(t) == 1, t).otherwise(F.regexp_replace(t, "[0-9]", ""))), "")


def line_initials(lines: Column) -> Column:
    """First letter of each line, if there are three lines or more."""
    return F.when(F.size(lines) >= 3, F.array_join(F.transform(lines, lambda x: F.regexp_extract(x, "[a-z]", 0)), ""))


def grid(docs: DataFrame) -> DataFrame:
    """(doc_id, cells, width) of (doc_id, lines): a block's rows as characters without white space, cut to the grid's size; none for fewer than three lines."""
    none = F.array().cast("array<array<string>>")
    rows = F.transform(F.slice("lines", 1, GRID_ROWS), lambda x: F.split(F.substring(F.regexp_replace(x, r"(?U)\s+", ""), 1, GRID_COLUMNS), ""))
    cut = D.pinned(docs.select("doc_id", "lines"), cells=F.when(F.size("lines") >= 3, rows).otherwise(none))
    return D.pinned(cut, width=F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0))).drop("lines")


def columns_of(cells: Column, width: Column) -> Column:
    """The columns of a block, top to bottom."""
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda j: F.array_join(F.transform(cells, lambda r: F.coalesce(F.get(r, j), F.lit(""))), ""))


def diagonals_of(cells: Column, width: Column) -> Column:
    """The diagonals of a block that start in its first row or first column, in both directions."""
    starts = F.when(F.size(cells) >= 3, F.sequence(3 - F.size(cells), F.greatest(width - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def read(place) -> Column:
        return F.transform(starts, lambda d: F.array_join(F.transform(cells, lambda r, i: F.coalesce(F.get(r, place(d, i)), F.lit(""))), ""))

    down = read(lambda d, i: d + i - 1)
    back = read(lambda d, i: width - d - i)
    return F.filter(F.array_distinct(F.concat(down, back)), lambda s: F.length(s) >= 3)


def column_hits(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, stream, answer...) of (doc_id, text): :func:`in_stream` of the columns and diagonals of the lines' grid, up to LONG_STREAM."""
    both = answers.select(F.explode(F.array("answer", F.reverse("answer"))).alias("form"), *M.ANSWER)
    read = partial(R.columns, accepted=forms_of(D.accepted(answers)), held=forms_of(both), rows=GRID_ROWS, width=GRID_COLUMNS, cap=LONG_STREAM)
    return R.by_text(docs, read, f"stream string, {HIT}").distinct()


def boundary(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, answer...) of (doc_id, text): an answer that runs across the end of a word in the words written together."""
    known = forms_of(answers, "answer")
    return R.by_text(docs, partial(R.boundary, known=known, sizes=sorted({len(a) for a in known})), HIT).distinct()


def reversed_initials(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, answer...) of (doc_id, text): initials of the words spell an answer backwards, one extra word inside allowed."""
    forms = forms_of(answers.withColumn("form", F.reverse("answer")))
    return R.by_text(docs, partial(R.reversed_initials, forms=R.initials_of(forms)), HIT).distinct()


def edit_letter(word: Column, answer: Column) -> Column:
    """The answer's letter at a near miss's first difference; of unequal lengths, the longer one's."""
    longer = F.when(F.length(word) > F.length(answer), word).otherwise(answer)
    places = F.sequence(F.lit(1), F.length(longer))
    first = F.array_min(F.filter(places, lambda i: F.substring(word, i, F.lit(1)) != F.substring(answer, i, F.lit(1))))
    return F.substring(F.when(F.length(word) == F.length(answer), answer).otherwise(longer), first, F.lit(1))


def edit_arithmetic(docs: DataFrame, words: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, word, answer...) of (doc_id, text): a dictionary word one edit from an answer, and the letter of the edit alone in the same text.

    a and i count only where the text has an instruction or the word "letter". Words are matched once
    each; those near an answer, a few for each, are looked for in every text.
    """
    listed = words.where(F.length("word") >= 4).select(F.col("word").alias("token"))
    near = M.typo(listed, answers).where(F.col("token") != F.col("answer")).withColumn("edit", edit_letter(F.col("token"), F.col("answer")))
    found: dict[str, list[tuple]] = {}
    for r in near.select("token", "edit", *M.ANSWER).distinct().collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    return R.by_text(docs, partial(R.edits, near=found), f"word string, {HIT}").distinct()
