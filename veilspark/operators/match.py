"""Token matchers: each is an equi-join of tokens with forms of the answers, on a key that makes them equal.

All take ``tokens`` (token, any others) and give its columns with answer_ord and answer. Answers are few, so
their forms are broadcast once their count is checked; tokens are never crossed with answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions import text as X
from . import derive as D

ANSWER = ["answer_ord", "answer"]


def _on(tokens: DataFrame, key: Column, forms: DataFrame) -> DataFrame:
    keyed = tokens.withColumn("__key", key).where(F.col("__key").isNotNull())
    return keyed.join(D.small(forms.select(F.col("form").alias("__key"), *ANSWER)), "__key").drop("__key")


def _on_any(tokens: DataFrame, keys: Column, forms: DataFrame) -> DataFrame:
    keyed = tokens.withColumn("__key", F.explode(F.array_distinct(keys)))
    return keyed.join(D.small(forms.select(F.col("form").alias("__key"), *ANSWER)), "__key").drop("__key").distinct()


def unlisted(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """All-letter tokens of 3 to 12 letters that aren't dictionary words: what the fuzzy rules look at."""
    fit = tokens.where(F.col("token").rlike("^[a-z]{3,12}$"))
    return fit.join(words, F.col("token") == F.col("word"), "left_anti")


def exact(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    return _on(tokens, F.col("token"), D.accepted(answers))


def looked_alike(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens that look-alike pairs turn into an accepted form."""
    changed = tokens.withColumn("__v", X.looked_alike(F.col("token"))).where(F.col("__v") != F.col("token"))
    return _on(changed, F.col("__v"), D.accepted(answers)).drop("__v")


def anagram(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    forms = answers.select(X.sorted_letters(F.col("answer")).alias("form"), *ANSWER)
    return _on(tokens, X.sorted_letters(F.col("token")), forms)


def _deletions(word: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.concat(F.array(word), cut)


def one_edit(a: Column, b: Column) -> Column:
    """True if one substitution, insertion, deletion or adjacent swap at most turns a into b."""
    same_length = F.length(a) == F.length(b)
    first = F.aggregate(
        F.sequence(F.lit(1), F.length(a)), F.lit(0),
        lambda acc, i: F.when((acc == 0) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    swapped = F.concat(F.substring(a, F.lit(1), first - 1), F.substring(a, first + 1, F.lit(1)), F.substring(a, first, F.lit(1)), F.substring(a, first + 2, F.length(a)))
    return (F.levenshtein(a, b) <= 1) | (same_length & (first > 0) & (swapped == b))


def typo(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens one edit from an answer: joined on a shared deletion of a letter, then verified."""
    forms = answers.select(F.explode(F.array_distinct(_deletions(F.col("answer")))).alias("form"), *ANSWER)
    near = _on_any(tokens, _deletions(F.col("token")), forms)
    return near.where(one_edit(F.col("token"), F.col("answer")))


def undoubled(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    return _on(tokens, X.undoubled(F.col("token")), answers.select(X.undoubled(F.col("answer")).alias("form"), *ANSWER))


def skeleton(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens that are an answer's consonants, if there are three of them or more."""
    forms = answers.select(X.consonants(F.col("answer")).alias("form"), *ANSWER).where(F.length("form") >= 3)
    return _on(tokens, F.col("token"), forms)


def interleaved(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens whose letters at even or odd places are an accepted form, of about twice the answer's length."""
    def every_other(start: int) -> Column:
        odd = F.filter(F.split(F.col("token"), ""), lambda c, i: i % 2 == start)
        return F.array_join(odd, "")

    near = _on_any(tokens, F.array(every_other(0), every_other(1)), D.accepted(answers))
    return near.where(F.length("token").between(2 * F.length("answer") - 1, 2 * F.length("answer") + 1))


def caesar(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    return _on(tokens, F.col("token"), D.caesar_forms(answers))


def substring(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """All-letter tokens that contain an answer and more; joined on the token's pieces of the answers' lengths."""
    lengths = F.array(*[F.lit(r[0]) for r in answers.select(F.length("answer")).distinct().collect()] or [F.lit(0)])
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.when(F.length("token") > n, F.sequence(F.lit(1), F.length("token") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col("token"), i, n)
    )))
    return _on_any(tokens.where(F.col("token").rlike("^[a-z]+$")), pieces, answers.select(F.col("answer").alias("form"), *ANSWER))


def wildcard(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens of the answer's length that agree where they have letters, three at least; other characters stand for any.

    Joined on the length and the first three letters with their places; the others are then compared.
    """
    wild = tokens.where(F.col("token").rlike("[^a-z]") & (F.length(F.regexp_replace("token", "[^a-z]", "")) >= 3))

    def key(word: Column, places: list[Column]) -> Column:
        return F.concat_ws(" ", F.length(word).cast("string"), *[F.concat(p.cast("string"), F.substring(word, p, F.lit(1))) for p in places])

    letters = F.filter(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.col("token"), i, F.lit(1)).rlike("[a-z]"))
    wild = wild.withColumn("__l", F.explode(F.array(letters)))
    n = F.length("answer")
    fit = answers.where(n >= 3)
    for name, low, more in (("__a", F.lit(1), 2), ("__b", F.col("__a") + 1, 1), ("__c", F.col("__b") + 1, 0)):
        fit = fit.withColumn(name, F.explode(F.sequence(low, n - more)))
    forms = fit.select(key(F.col("answer"), [F.col(c) for c in ("__a", "__b", "__c")]).alias("form"), *ANSWER)
    near = _on(wild, key(F.col("token"), [F.get("__l", F.lit(k)) for k in range(3)]), forms)
    same = F.forall("__l", lambda i: F.substring(F.col("token"), i, F.lit(1)) == F.substring(F.col("answer"), i, F.lit(1)))
    return near.where(same).drop("__l")


def leet_variants(token: Column) -> Column:
    """Readings of a token with digits and symbols as letters: all letters, 64 readings at most, else none."""
    letters = F.create_map(*[F.lit(x) for pair in T.LEET.items() for x in pair])

    def grow(acc: Column, c: Column) -> Column:
        readings = F.split(F.coalesce(F.try_element_at(letters, c), c), "")
        grown = F.flatten(F.transform(acc, lambda v: F.transform(readings, lambda r: F.concat(v, r))))
        return F.when(F.size(acc) == 0, acc).when(F.size(grown) > 64, F.array().cast("array<string>")).otherwise(grown)

    grown = F.aggregate(F.split(token, ""), F.array(F.lit("")), grow)
    fit = token.rlike(r"[0-9@$!|+(€£¢]") & token.rlike("[a-z]")
    return F.when(fit, F.filter(grown, lambda v: v.rlike("^[a-z]+$"))).otherwise(F.array().cast("array<string>"))


def leet(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    return _on_any(tokens, leet_variants(F.col("token")), D.accepted(answers))
