"""Decoders: strings that a text may hide in numbers, escapes, Base64, Morse or spelled letters, as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import tables as T

_NONE = "array<string>"


def none() -> Column:
    return F.array().cast(_NONE)


def base64_texts(raw: Column) -> Column:
    """Texts of Base64 runs of six characters or more that decode to printable UTF-8; a lone last character is dropped."""
    runs = F.regexp_extract_all(raw, F.lit("([A-Za-z0-9+/]{6,})={0,2}"), F.lit(1))
    whole = F.transform(runs, lambda r: F.when(F.length(r) % 4 == 1, F.substring(r, F.lit(1), F.length(r) - 1)).otherwise(r))
    raw_bytes = F.transform(whole, lambda r: F.try_to_binary(r, F.lit("base64")))
    valid = F.filter(raw_bytes, lambda b: b.isNotNull() & F.is_valid_utf8(b.cast("string")))
    texts = F.transform(valid, lambda b: b.cast("string"))
    # white space without the vertical tab, and the text's very end: Java's \s has that tab, its $ stands before a last line break, too
    return F.filter(texts, lambda s: s.rlike(r"\A[\p{L}\p{N}\p{P}\p{S} \t\n\f\r]+\z"))


def number_runs(norm: Column) -> Column:
    """Runs of three numbers (or ordinals, as 1st) or more with at most two other tokens between neighbours, as arrays of digits.

    After them, for runs of six or more that are places and values in turn ("letter 1 = 23, letter 2 = 1"), the values.
    """
    parts = F.filter(F.split(F.regexp_replace(norm, r"([0-9])(?:st|nd|rd|th)\b", "$1"), "[^a-z0-9]+"), lambda t: t != "")

    def step(acc: Column, t: Column) -> Column:
        is_number = t.rlike("^[0-9]+$")
        gap = F.when(is_number, F.lit(0)).otherwise(acc["gap"] + 1)
        broken = gap > 2
        done = F.when(broken & (F.size(acc["now"]) >= 3), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(is_number, F.concat(acc["now"], F.array(t))).when(broken, none()).otherwise(acc["now"])
        return F.struct(done.alias("done"), now.alias("now"), gap.alias("gap"))

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none().alias("now"), F.lit(0).alias("gap"))
    runs = F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["now"]) >= 3, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))

    def half(run: Column, odd: int) -> Column:
        return F.filter(run, lambda x, i: i % 2 == odd)

    def placed(run: Column) -> Column:
        counted = F.forall(F.transform(half(run, 0), lambda x, i: x.try_cast("decimal(38,0)") == i + 1), lambda ok: F.coalesce(ok, F.lit(False)))
        return (F.size(run) >= 6) & (F.size(run) % 2 == 0) & counted

    both = F.transform(F.array(runs), lambda r: F.concat(r, F.transform(F.filter(r, placed), lambda x: half(x, 1))))
    return F.element_at(both, 1)


def _letters(numbers: Column, base: int) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.char(F.try_add(n.try_cast("int"), F.lit(base)))), "")


def _fits(numbers: Column, low: int, high: int) -> Column:
    return F.forall(numbers, lambda n: F.coalesce(n.try_cast("int").between(low, high), F.lit(False)))


def number_texts(run: Column) -> Column:
    """Readings of one run of numbers: a = 1 (zeros and two strays aside), a = 0, ASCII, octal, binary."""
    non_zero = F.filter(run, lambda n: ~n.rlike("^0+$"))
    letters = F.filter(non_zero, lambda n: F.coalesce(n.try_cast("int").between(1, 26), F.lit(False)))
    of_base = {8: "^1[0-7][0-7]$", 2: "^[01]{7,8}$"}

    def coded(base: int) -> Column:
        text = F.array_join(F.transform(run, lambda n: F.char(F.conv(n, base, 10).try_cast("int"))), "")
        return F.when(F.forall(run, lambda n: n.rlike(of_base[base])), F.lower(text))

    return F.array_compact(F.array(
        F.when((F.size(letters) >= 3) & (F.size(non_zero) - F.size(letters) <= 2), _letters(letters, 96)),
        F.when(_fits(run, 0, 25), _letters(run, 97)), F.when(_fits(run, 65, 122), F.lower(_letters(run, 0))), coded(8), coded(2),
    ))


def number_words(words: Column) -> Column:
    """The text of a list of words with number words (ordinals too) as digits, tens and units put together; null for fewer than three."""
    units, tens = T.UNITS | T.ORDINAL_UNITS, T.TENS | T.ORDINAL_TENS
    values = {f"{w}th": n for w, n in (units | tens).items()} | units | tens
    table = F.create_map(*[F.lit(x) for w, n in values.items() for x in (w, n)])
    read = F.transform(words, lambda w: F.struct(w.alias("w"), F.try_element_at(table, w).alias("n")))
    low = {w for w, n in units.items() if n < 10}

    def step(acc: Column, x: Column) -> Column:
        unit = x["w"].isin(list(low)) & acc["ten"]
        last = F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array((last.try_cast("int") + x["n"]).cast("string")))
        out = F.when(unit, joined).otherwise(F.concat(acc["out"], F.array(F.coalesce(x["n"].cast("string"), x["w"]))))
        count = acc["count"] + F.when(x["n"].isNull() | unit, 0).otherwise(1)
        ten = F.coalesce((x["n"] >= 20) & ~unit, F.lit(False))
        return F.struct(out.alias("out"), count.alias("count"), ten.alias("ten"))

    done = F.aggregate(read, F.struct(none().alias("out"), F.lit(0).alias("count"), F.lit(False).alias("ten")), step)
    return F.when(done["count"] >= 3, F.array_join(done["out"], " "))


def _hex_text(run: Column, digits: str) -> Column:
    codes = F.regexp_extract_all(run, F.lit(digits), F.lit(1))
    known = F.filter(F.transform(codes, lambda h: F.conv(h, 16, 10).try_cast("int")), lambda c: c < 128)
    return F.lower(F.array_join(F.transform(known, lambda c: F.char(c)), ""))


#: Escapes of at least three characters: the pattern of a run, and of the code in it; codes above ASCII are left out.
ESCAPES = [
    (r"(?i)((?:\\u[0-9a-f]{4}\s*){3,})", r"(?i)\\u([0-9a-f]{4})"),
    (r"(?i)((?:\\x[0-9a-f]{2}\s*){3,})", r"(?i)\\x([0-9a-f]{2})"),
    (r"(?i)((?:u\+[0-9a-f]{4}\s*){3,})", r"(?i)u\+([0-9a-f]{4})"),
    (r"(?i)((?:%u[0-9a-f]{4}\s*){3,})", r"(?i)%u([0-9a-f]{4})"),
    (r"(?i)((?:&#x[0-9a-f]+;?\s*){3,})", r"(?i)&#x([0-9a-f]+)"),
    (r"(?i)((?:%[0-9a-f]{2}){3,})", r"(?i)%([0-9a-f]{2})"),
    (r"(?i)\b0x((?:[0-9a-f]{2}){3,})\b", r"(?i)([0-9a-f]{2})"),
]


def escape_texts(raw: Column) -> Column:
    """Texts of escape sequences, hexadecimal byte groups, decimal entities and unseparated binary."""
    def read(run: str, digits: str) -> Column:
        return F.transform(F.regexp_extract_all(raw, F.lit(run), F.lit(1)), lambda r: _hex_text(r, digits))

    out = [read(run, digits) for run, digits in ESCAPES]
    entities = F.regexp_extract_all(raw, F.lit(r"((?:&#[0-9]+;?\s*){3,})"), F.lit(1))
    out.append(F.transform(entities, lambda r: F.lower(F.array_join(F.transform(F.filter(F.transform(F.regexp_extract_all(r, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int")), lambda c: c < 128), lambda c: F.char(c)), ""))))
    groups = F.split(raw, r"(?i)[^0-9a-f%\s\-.,:;|/+_#]+")
    pairs = F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(?i)\b(?:0x)?([0-9a-f]{2})\b"), F.lit(1)))
    out.append(F.transform(F.filter(pairs, lambda p: F.size(p) >= 3), lambda p: _hex_text(F.array_join(p, " "), "([0-9a-fA-F]{2})")))
    bits = F.regexp_extract_all(raw, F.lit(r"\b([01]{24,})\b"), F.lit(1))

    def unpacked(width: int) -> Column:
        def char(b: Column, i: Column) -> Column:
            return F.char(F.conv(F.substring(b, i * width + 1, F.lit(width)), 2, 10).try_cast("int"))

        fit = F.filter(bits, lambda b: F.length(b) % width == 0)
        return F.transform(fit, lambda b: F.lower(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(b) / width).cast("int") - 1), lambda i: char(b, i)), "")))

    out += [unpacked(8), unpacked(7)]
    return F.flatten(F.array(*out))


def candidates(texts: Column) -> Column:
    """Decoded strings as they are scanned again: letters and white space only, three letters at least."""
    clean = F.transform(texts, lambda s: F.trim(F.regexp_replace(s, r"[^a-z\s]", " ")))
    return F.filter(clean, lambda s: F.regexp_replace(s, r"\s", "").rlike("[a-z]{3}"))


def spelled(words: Column) -> Column:
    """Letters named one after another (NATO words, letter names, "double u"), one other word between allowed; three at least."""
    table = F.create_map(*[F.lit(x) for w, l in {**T.LETTER_NAMES, **T.NATO}.items() for x in (w, l)])
    doubled = F.regexp_replace(F.array_join(words, " "), r"\b(?:double|doble) (?:u|you|yu|ve)\b", "doubleu")
    read = F.transform(F.split(doubled, " "), lambda w: F.coalesce(F.try_element_at(table, w), F.lit("")))

    def step(acc: Column, c: Column) -> Column:
        gap = F.when(c != "", F.lit(0)).otherwise(acc["gap"] + 1)
        end = gap > 1
        done = F.when(end & (F.length(acc["now"]) >= 3), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(end, F.lit("")).otherwise(F.concat(acc["now"], c)).alias("now"), gap.alias("gap"))

    start = F.struct(none().alias("done"), F.lit("").alias("now"), F.lit(0).alias("gap"))
    return F.aggregate(read, start, step, lambda a: F.when(F.length(a["now"]) >= 3, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def morse_texts(norm: Column) -> Column:
    """A text as Morse: other dots and dashes as . and -, spoken ones too if there are three; and runs split at separators, letters between spaces."""
    t = F.regexp_replace(F.regexp_replace(norm, "[·•∙⋅●⚫🔴🔵🟢🟡🟠🟣🟤⭕*]", "."), "[−–—―➖▬━_]", "-")
    said = F.regexp_count(t, F.lit(r"\b(?:dit|dah|di|da|dot|dash)\b")) >= 3
    t = F.when(said, F.regexp_replace(F.regexp_replace(t, r"\b(?:dit|di|dot)\b", "."), r"\b(?:dah|da|dash)\b", "-")).otherwise(t)
    runs = F.filter(
        F.regexp_extract_all(t, F.lit(r"([.\-\s,/|]{5,})"), F.lit(1)),
        lambda r: r.rlike(r"[.-][\s,/|]+[.-]") & (F.length(F.regexp_replace(r, "[^.-]", "")) >= 5),
    )
    split = F.transform(runs, lambda r: F.array_join(F.filter(F.transform(F.split(r, r"\s*[,/|\n]\s*|\s{2,}"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != ""), " "))
    return F.concat(F.array(t), split)
