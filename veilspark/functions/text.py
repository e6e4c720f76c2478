"""Text normalisation, tokens and letter keys as Column functions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import tables as T


def strip_hidden(text: Column) -> Column:
    """Text without invisible characters; letters drawn with slashes and bars become letters."""
    out = F.regexp_replace(text, T.INVISIBLE, "")
    for pattern, letter in T.ASCII_ART:
        out = F.regexp_replace(out, pattern, letter)
    return out


def strip_markup(text: Column) -> Column:
    """Chat markup rewritten to plain words, in the order of the table."""
    for pattern, new in T.MARKUP:
        text = F.regexp_replace(text, pattern, new)
    return text


def fold_letters(text: Column) -> Column:
    """Lower case, styled letters and accented Latin letters as plain ones; one translate each."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.translate(F.translate(low, *T.style_folds()), *T.latin_folds())


def normalize_ascii(text: Column) -> Column:
    """The native part of normalisation: hidden characters, markup, case and letter folds. Null stays null."""
    return fold_letters(strip_markup(strip_hidden(text)))


def tokens(norm: Column) -> Column:
    """Words between white space, trimmed at both ends to letters and digits; empty ones go."""
    cut = F.transform(F.split(norm, r"(?U)\s+"), lambda t: F.regexp_replace(t, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(cut, lambda t: t != "")


def words(tokens_: Column) -> Column:
    """Letters of each token; tokens without any go."""
    return F.filter(F.transform(tokens_, lambda t: F.regexp_replace(t, "[^a-z]", "")), lambda t: t != "")


def lines(norm: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(norm, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sorted_letters(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def undoubled(word: Column) -> Column:
    """Runs of one letter as a single one."""
    return F.regexp_replace(word, r"([a-z])\1+", "$1")


def consonants(word: Column) -> Column:
    return F.regexp_replace(word, "[aeiou]", "")


def unflip(text: Column) -> Column:
    """Upside-down text turned back: reversed, each glyph replaced."""
    return F.translate(F.reverse(text), *T.UPSIDE_DOWN)


def rotated(word: Column, n: int) -> Column:
    """Caesar shift by ``n`` places."""
    return F.translate(word, T.ALPHABET, T.ALPHABET[n % 26 :] + T.ALPHABET[: n % 26])


def atbash(word: Column) -> Column:
    return F.translate(word, T.ALPHABET, T.ALPHABET[::-1])


def keypad(word: Column) -> Column:
    return F.translate(word, T.ALPHABET, T.KEYPAD)


def key_shift(word: Column, step: int) -> Column:
    """Each letter's neighbour ``step`` keys along its row; null if one has none."""
    near = "".join(
        next((row[i] if 0 <= (i := row.index(c) + step) < len(row) else "?") for row in T.KEY_ROWS if c in row) for c in T.ALPHABET
    )
    shifted = F.translate(word, T.ALPHABET, near)
    return F.when(~F.contains(shifted, F.lit("?")), shifted)


def morse(word: Column) -> Column:
    """Morse code, letters between spaces."""
    code = F.create_map(*[F.lit(x) for pair in zip(T.ALPHABET, T.MORSE, strict=True) for x in pair])
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.element_at(code, c)), " ")


def pig_latin(word: Column) -> Column:
    """Pig Latin forms: an ending after a vowel start; else one form for each part of the consonants moved to the end."""
    head = F.length(F.regexp_extract(word, "^[^aeiou]+", 0))
    moved = F.transform(F.sequence(F.lit(1), F.greatest(head, F.lit(1))), lambda k: F.concat(F.substring(word, k + 1, F.length(word)), F.substring(word, F.lit(1), k), F.lit("ay")))
    ends = F.array(*[F.concat(word, F.lit(e)) for e in ("way", "yay", "ay")])
    return F.when(head == 0, ends).otherwise(moved)


def looked_alike(word: Column) -> Column:
    """Pairs of letters that look like one, replaced in turn."""
    for pair, letter in T.LOOKALIKES:
        word = F.replace(word, F.lit(pair), F.lit(letter))
    return word
