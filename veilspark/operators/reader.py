"""Rules across the tokens of one text, text by text in Python over Arrow batches: a token is folded and trimmed once a worker, not once an occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import tables as T

#: White space of Unicode, as of Java's white space under (?U); Python's own has four separators more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _SEPARATORS = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")
_ENDS, _NO_PART, _NO_LETTER = re.compile("^[^a-z0-9]+|[^a-z0-9]+(?![\\s\\S])"), re.compile(r"[^a-z0-9@$!|+(€£¢]"), re.compile("[^a-z]")
_LINK, _SHOUTED, _LONE_I, _OPENS = re.compile(r"https?://\S+", re.A), re.compile(r"\b[A-Z]{2,}\b", re.A), re.compile(r"\bI\b", re.A), re.compile(r"(^|[.!?]\s+)[A-Z]", re.A)
_THREE, _NO_CAPITAL = re.compile("[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]"), re.compile("[^A-Z]")
_TOLD = re.compile(rf"\b{T.INSTRUCTIONS}\b|\bletter\b", re.A)
#: Words that a worker remembers, and texts of an Arrow batch that are held as Python strings at a time.
REMEMBERED, ROWS = 200_000, 256


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    latin, style = (dict(zip(*pairs, strict=True)) for pairs in (T.latin_folds(), T.style_folds()))
    return str.maketrans(latin | {a: latin.get(b, b) for a, b in style.items()})


def fold(text: str) -> str:
    """Lower case, styled and accented letters as plain ones, as :func:`text.fold_letters`."""
    low = text.lower()
    return low if low.isascii() else low.replace("ß", "ss").translate(_folds())


def looked_alike(word: str) -> str:
    for pair, letter in T.LOOKALIKES:
        if pair in word:
            word = word.replace(pair, letter)
    return word


class _Remembered(dict):
    """What ``make`` gives for a key, remembered for REMEMBERED keys."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _made(raw: str) -> str:
    return raw.lower() if raw.isascii() and raw.isalpha() else _ENDS.sub("", fold(raw))


def _letters(raw: str) -> str:
    return raw.lower() if raw.isascii() and raw.isalpha() else _NO_LETTER.sub("", _made(raw))


#: Of what stands between white space: the token, its letters, its part, its first letter, each empty where there is none.
_token, _word, _initial = _Remembered(_made), _Remembered(_letters), _Remembered(lambda raw: _letters(raw)[:1])
_part = _Remembered(lambda raw: raw.lower() if raw.isascii() and raw.isalpha() else _NO_PART.sub("", _made(raw)))


def raw_tokens(text: str) -> list[str]:
    return _SPACES.split(text) if _SEPARATORS.search(text) else text.split()


def tokens(text: str) -> list[str]:
    return [t for raw in raw_tokens(text) if (t := _token[raw])]


def words(text: str) -> list[str]:
    return [w for raw in raw_tokens(text) if (w := _word[raw])]


def by_text(docs: DataFrame, read: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """doc_id of (doc_id, text) and the columns of ``schema``: a row for each tuple that ``read`` gives for a text; none for a null one."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                at, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text is not None:
                        found = list(read(text))
                        at += [i] * len(found)
                        rows += found
                if rows:
                    columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                    out = [c.cast(pa.int32()) if pa.types.is_integer(c.type) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *out], names=["doc_id", *names])

    fields = StructType([*docs.select("doc_id").schema.fields, *StructType.fromDDL(schema).fields])
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    seen: Counter[str] = Counter()
    for batch in parts:
        for begin in range(0, batch.num_rows, ROWS):
            for text in batch.column(0).slice(begin, ROWS).to_pylist():
                if text is not None:
                    seen.update({t for raw in set(raw_tokens(text)) if (t := _token[raw])})
            if len(seen) >= REMEMBERED:
                yield rows()
                seen.clear()
    yield rows()


def counted(texts: DataFrame) -> DataFrame:
    """(token, n_docs) of (text): the tokens, and in how many texts each occurs."""
    return texts.select("text").mapInArrow(_counts, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n_docs"))


# ---- rules of one text; forms are maps to lists of (answer_ord, answer)


def split_words(text: str, accepted: dict[str, list], most: int, parts: int) -> Iterator[tuple]:
    """(pos, n, joined, answer...) where 2 to ``parts`` neighbouring parts of ``most`` letters together are an accepted form, look-alikes read too."""
    p = [x for raw in raw_tokens(text) if (x := _part[raw])]
    sizes = list(map(len, p))
    for i in range(len(p) - 1):
        if sizes[i] + sizes[i + 1] > most:
            continue
        joined = p[i]
        for j in range(i + 1, min(len(p), i + parts)):
            joined += p[j]
            if len(joined) > most:
                break
            for a in accepted.get(joined, ()):
                yield i, j - i + 1, joined, *a
            other = looked_alike(joined)
            if other != joined:
                for a in accepted.get(other, ()):
                    yield i, j - i + 1, joined, *a


def boundary(text: str, known: dict[str, list], sizes: list[int]) -> set[tuple]:
    """Answers that run across the end of a word in the words written together."""
    ws = words(text)
    flat, b, found = "".join(ws), 0, set()
    cuts = [(k, n - k) for n in sizes for k in range(1, n)]
    for w in ws[:-1]:
        b += len(w)
        for k, m in cuts:
            if b >= k and (piece := flat[b - k : b + m]) in known:
                found.update(known[piece])
    return found


def initials_of(forms: dict[str, list]) -> dict[int, tuple[dict, frozenset]]:
    """The forms as tuples of letters, by their length."""
    return {n: (by := {tuple(f): a for f, a in forms.items() if len(f) == n}, frozenset(by)) for n in {len(f) for f in forms if f}}


def reversed_initials(text: str, forms: dict[int, tuple[dict, frozenset]]) -> set[tuple]:
    """Answers that the initials of the words spell backwards, one extra word inside allowed."""
    s = "".join([_initial[raw] for raw in raw_tokens(text)])
    found = set()
    for n, (by, every) in forms.items():
        for skip in (None, *range(1, n)):
            at = range(n) if skip is None else [i for i in range(n + 1) if i != skip]
            for f in every.intersection(zip(*[s[i:] for i in at], strict=False)):
                found.update(by[f])
    return found


def capital_streams(text: str) -> Iterator[tuple]:
    """(line, streams) of each line that has any: its capitals in order, all, without those that open sentences, without the word I; lower-case letters of a shouted line."""
    for at, line in enumerate(text.split("\n")):
        if not _THREE.search(line):  # no stream has fewer
            continue
        links = _LINK.sub(" ", line)
        t = _SHOUTED.sub(" ", links)
        out: list[str] = []
        upper = _NO_CAPITAL.sub("", t)
        if 3 <= len(upper) <= 12 and len(_NO_LETTER.sub("", t)) >= 3:
            out = [s.lower() for s in (upper, _NO_CAPITAL.sub("", _OPENS.sub(r"\1", t)), _NO_CAPITAL.sub("", _LONE_I.sub("", t)))]
        small = _NO_LETTER.sub("", links)
        if 3 <= len(small) <= 12 and len(_NO_CAPITAL.sub("", links)) > len(small):
            out.append(small)
        if streams := ",".join(dict.fromkeys(out)):
            yield at, streams


def edits(text: str, near: dict[str, list]) -> set[tuple]:
    """(word, answer...): a word of ``near``, a map to (edit, answer...), whose letter of the edit is alone in the text; a and i only beside an instruction."""
    ws = {_word[raw] for raw in set(raw_tokens(text))}
    hits = near.keys() & ws
    if not hits:
        return set()
    alone = {v for w in ws for v in (w, looked_alike(w)) if len(v) == 1}
    found = {(edit, w, *a) for w in hits for edit, *a in near[w] if edit in alone}
    if any(f[0] in "ai" for f in found) and not _TOLD.search(fold(text)):
        found = {f for f in found if f[0] not in "ai"}
    return {f[1:] for f in found}


def columns(text: str, accepted: dict[str, list], held: dict[str, list], rows: int, width: int, cap: int) -> set[tuple]:
    """(stream, answer...): the letters down a column or along a diagonal of a text's lines are an accepted form or, up to ``cap``, hold one of ``held``."""
    lines = [x for line in text.split("\n") if (x := line.strip(" "))]
    if len(lines) < 3:
        return set()
    block = [_SPACES.sub("", fold(x))[:width] for x in lines[:rows]]
    wide = max(map(len, block))
    if not wide:
        return set()
    square = [r.ljust(wide, "\0") for r in block]
    streams = set(map("".join, zip(*square, strict=True)))
    # each row moved on by its number: diagonals are the columns of what comes out
    for turned in (square, [r[::-1] for r in square]):
        n = len(turned)
        moved = ["\0" * (n - 1 - i) + r + "\0" * i for i, r in enumerate(turned)]
        streams.update(map("".join, zip(*moved, strict=True)))
    found = set()
    sizes = sorted({len(f) for f in held})
    for s in {_NO_LETTER.sub("", s) for s in streams}:
        if len(s) < 3:
            continue
        for a in accepted.get(s, ()):
            found.add((s, *a))
        if len(s) <= cap:
            for n in sizes:
                for i in range(len(s) - n + 1):
                    if (piece := s[i : i + n]) in held:
                        found.update((s, *a) for a in held[piece])
    return found
