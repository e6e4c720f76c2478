"""All rules of the detector on one text, for Arrow-batched scans: what needs Unicode forms, search or recursion.

The rules are generators of answers in the order of precedence; a scan takes the first. Matching goes by
maps from a form to its first answer, so a token costs the same for ten answers and ten thousand.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from . import tables as T
from .phonetic import double_metaphone
from .translit import transliterate

_EMOJI = re.compile("[\U0001F300-\U0001FAFF☀-➿⬀-⯿](?:️|‍[\U0001F300-\U0001FAFF☀-➿])*")
_MARKED = re.compile(r"\*\*([^*\n]{1,3})\*\*|__([^_\n]{1,3})__|\|\|([^|\n]{1,3})\|\||~~([^~\n]{1,3})~~|`([^`\n]{1,3})`|\*([^*\s]{1,3})\*|(?<![a-zA-Z])_([^_\s]{1,3})_")
_WHITE = re.compile(r"\s+")
_MARKUP = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", new)) for p, new in T.MARKUP]
_ART = [(re.compile(p), new) for p, new in T.ASCII_ART]
_HIDDEN = re.compile(T.INVISIBLE)
_STYLE = str.maketrans(dict(zip(*T.style_folds(), strict=True)) | {"ß": "ss"})
_TURN = str.maketrans(*T.UPSIDE_DOWN)
_LEET = T.LEET
_LEET_SIGN = re.compile("[" + re.escape("".join(T.LEET)) + "]")
_PAIRS = re.compile("|".join(pair for pair, _ in T.LOOKALIKES))
_ROTATIONS = [str.maketrans(T.ALPHABET, T.ALPHABET[n:] + T.ALPHABET[:n]) for n in range(26)]
_WITHOUT = {v: str.maketrans("", "", v) for v in ("aeiou", "aeiouy")}
_LETTER_NAMES = {**T.LETTER_NAMES, **T.NATO}
_UNITS = T.UNITS | T.ORDINAL_UNITS
_NUMBERS = {f"{w}th": n for w, n in (_UNITS | T.TENS | T.ORDINAL_TENS).items()} | _UNITS | T.TENS | T.ORDINAL_TENS
_CODE = re.compile("[.-][. -]*")
_RUN, _RUN32, _TRIM, _NOT_LETTERS = re.compile(r"[A-Za-z0-9+/]{6,}"), re.compile(r"\b[A-Z2-7]{8,}=*"), re.compile("^[^a-z0-9]+|[^a-z0-9]+$"), re.compile("[^a-z]")
_PLAIN, _DIGITS, _ORDINAL = re.compile("[a-z0-9]+"), re.compile("[0-9]+"), re.compile(r"([0-9])(?:st|nd|rd|th)\b")
_NO_PAIRS, _HEX_PAIR = re.compile(r"[^0-9a-f%\s\-.,:;|/+_#]+", re.I), re.compile(r"\b(?:0x)?([0-9a-f]{2})\b", re.I)
#: Tokens and decoded texts whose verdicts a worker remembers, and runs whose decoded texts it does.
REMEMBERED = 200_000


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    """Combining characters, as ranges."""
    ends: list[list[int]] = []
    for cp in range(0x300, 0x110000):
        if unicodedata.combining(chr(cp)):
            if ends and ends[-1][1] == cp - 1:
                ends[-1][1] = cp
            else:
                ends.append([cp, cp])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ends) + "]+")


def only_letters(s: str) -> str:
    return s if s.isascii() and s.isalpha() and s.islower() else _NOT_LETTERS.sub("", s)


def undoubled(s: str) -> str:
    return re.sub(r"([a-z])\1+", r"\1", s)


def consonants(s: str, vowels: str = "aeiou") -> str:
    return s.translate(_WITHOUT[vowels])


def rotated(s: str, n: int) -> str:
    return s.translate(_ROTATIONS[n % 26])


def steps(word: str) -> tuple[int, ...]:
    """Distances of neighbouring letters around the alphabet: words that are Caesar shifts of each other share them."""
    return tuple((ord(b) - ord(a)) % 26 for a, b in zip(word, word[1:], strict=False))


def looks(word: str) -> list[str]:
    """The word, and what look-alike pairs make of it."""
    if not _PAIRS.search(word):
        return [word]
    other = word
    for pair, letter in T.LOOKALIKES:
        other = other.replace(pair, letter)
    return list(dict.fromkeys([word, other]))


def leet(token: str, most: int = 64) -> list[str]:
    """All-letter readings of a token with digits and symbols; none beyond ``most``."""
    if not _LEET_SIGN.search(token) or not re.search("[a-z]", token):
        return []
    out = [""]
    for c in token:
        out = [v + r for v in out for r in _LEET.get(c, c)]
        if len(out) > most:
            return []
    return [v for v in out if re.fullmatch("[a-z]+", v)]


def near(a: str, b: str) -> bool:
    """One substitution, insertion, deletion or adjacent swap at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def base32(blob: str) -> str:
    """Base32 without any check of its padding."""
    bits = "".join(f"{'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'.index(c):05b}" for c in blob.rstrip("="))
    return "".join(chr(int(bits[i : i + 8], 2)) for i in range(0, len(bits) - 7, 8))


@dataclass
class Options:
    """Switches of the rules."""

    suffixes: bool = True
    phonetic: bool = True
    acrostics: bool = True
    ciphers: bool = True
    fuzzy: bool = True
    boundary: bool = True
    arithmetic: bool = True
    caesar_join: bool = True
    filler_join: bool = True
    capitals: bool = True
    streams: bool = True
    scripts: bool = True


@dataclass
class Detector:
    """Rules for a list of answers; ``dictionary``, ``confusables`` and ``emoji_names`` are parameters, empty by default."""

    answers: list[str]
    dictionary: frozenset[str] = frozenset()
    confusables: dict[str, str] = field(default_factory=dict)
    emoji_names: dict[str, str] = field(default_factory=dict)
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.answers = list(dict.fromkeys(a.lower() for a in self.answers))
        self.order = {a: i for i, a in enumerate(self.answers)}
        self.longest = max(map(len, self.answers), default=0)
        self.lengths = sorted(set(map(len, self.answers)))
        self.codes = [(" ".join(T.MORSE[ord(c) - 97] for c in a if c in T.ALPHABET), a) for a in self.answers]
        self.seen: dict[str, str | None] = {}
        self.read: dict[str, str | None] = {}

    # ---- maps from forms to the first answer

    def _map(self, forms) -> dict[str, str]:
        out: dict[str, str] = {}
        for a in self.answers:
            for f in forms(a):
                if f:
                    out.setdefault(f, a)
        return out

    def _lists(self, forms) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a in self.answers:
            for f in set(forms(a)):
                if f:
                    out.setdefault(f, []).append(a)
        return out

    def _exact_forms(self, a: str) -> list[str]:
        head = re.match("[^aeiou]*", a).end()
        pig = [a[k:] + a[:k] + "ay" for k in range(1, head + 1)] or [a + "way", a + "yay", a + "ay"]
        keys = []
        for step in (-1, 1):
            rows = [next((r for r in T.KEY_ROWS if c in r), "") for c in a]
            places = [r.find(c) + step for r, c in zip(rows, a, strict=True)]
            if all(r and 0 <= p < len(r) for r, p in zip(rows, places, strict=True)):
                keys.append("".join(r[p] for r, p in zip(rows, places, strict=True)))
        ends = [a + s for s in T.SUFFIXES] if self.options.suffixes else []
        if self.options.suffixes and a[-1:] in "ey":
            ends += [a[:-1] + s for s in (T.SUFFIXES_E if a.endswith("e") else T.SUFFIXES_Y)]
        return [
            a, a[::-1], rotated(a, 13), a.translate(str.maketrans(T.ALPHABET, T.ALPHABET[::-1])), base64.b64encode(a.encode()).decode().rstrip("=").lower(),
            a.encode().hex(), a.upper().encode().hex(), a.translate(str.maketrans(T.ALPHABET, T.KEYPAD)), *pig, *keys, *ends,
        ]

    @cached_property
    def accepted(self) -> dict[str, str]:
        return self._map(self._exact_forms)

    @cached_property
    def caesar(self) -> dict[str, str]:
        return self._map(lambda a: [rotated(a, n) for n in range(26)])

    @cached_property
    def anagrams(self) -> dict[str, str]:
        return self._map(lambda a: ["".join(sorted(a))])

    @cached_property
    def single(self) -> dict[str, str]:
        return self._map(lambda a: [undoubled(a)])

    @cached_property
    def bare(self) -> dict[str, str]:
        return self._map(lambda a: [s] if len(s := consonants(a)) >= 3 else [])

    @cached_property
    def sounds(self) -> dict[str, list[str]]:
        return self._lists(lambda a: double_metaphone(a))

    @cached_property
    def typos(self) -> dict[str, list[str]]:
        return self._lists(lambda a: [a, *(a[:i] + a[i + 1 :] for i in range(len(a)))])

    @cached_property
    def shifts(self) -> dict[tuple[int, ...], list[str]]:
        """Accepted forms of letters only, by the steps that their Caesar shifts share."""
        out: dict[tuple[int, ...], list[str]] = {}
        for form in self.accepted:
            if re.fullmatch("[a-z]+", form):
                out.setdefault(steps(form), []).append(form)
        return out

    @cached_property
    def letters_at(self) -> dict[tuple[int, int, str], list[str]]:
        """Answers by their length and a letter at a place."""
        out: dict[tuple[int, int, str], list[str]] = {}
        for a in self.answers:
            for i, c in enumerate(a):
                out.setdefault((len(a), i, c), []).append(a)
        return out

    @cached_property
    def prefixes(self) -> set[str]:
        return {a[:k] for a in self.answers for k in range(1, len(a) + 1)}

    def first(self, found) -> str | None:
        return min((f for f in found if f), key=self.order.__getitem__, default=None)

    def edited(self, word: str) -> list[str]:
        """Answers one edit from a word: those that share one of their deletions, verified."""
        forms = [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]
        return [a for a in {a for f in forms for a in self.typos.get(f, ())} if near(word, a)]

    # ---- tests of one token

    def exact(self, word: str) -> str | None:
        return self.accepted.get(word) if word else None

    def wildcard(self, token: str) -> str | None:
        shown = [(i, c) for i, c in enumerate(token) if c in T.ALPHABET]
        if len(shown) < 3:
            return None
        if len(shown) == len(token):
            return token if token in self.order else None
        fewest = min((self.letters_at.get((len(token), i, c), []) for i, c in shown), key=len)
        return next((a for a in fewest if all(a[i] == c for i, c in shown)), None)

    def within(self, s: str) -> Iterator[str]:
        """Answers that occur in a string."""
        return (w for n in self.lengths for i in range(len(s) - n + 1) if (w := s[i : i + n]) in self.order)

    def fuzzy(self, word: str) -> str | None:
        if not re.fullmatch("[a-z]{3,12}", word) or word in self.dictionary:
            return None
        found: list[str | None] = []
        if self.options.fuzzy:
            found += [self.anagrams.get("".join(sorted(word))), *self.edited(word), self.single.get(undoubled(word)), self.bare.get(word)]
            for part in (word[::2], word[1::2]):
                a = self.exact(part)
                found.append(a if a and abs(len(word) - 2 * len(a)) <= 1 else None)
        if self.options.ciphers:
            found.append(self.caesar.get(word))
        if hit := self.first(found):
            return hit
        if self.options.ciphers and len(word) <= self.longest + 4:
            turns = {(ord(f[0]) - ord(word[0])) % 26: f for f in self.shifts.get(steps(word), ())}
            if n := min((n for n in turns if n), default=0):
                return self.accepted[turns[n]]
        return self.sounds_like(word) if self.options.phonetic else None

    def sounds_like(self, word: str) -> str | None:
        return self.first(a for code in double_metaphone(word) for a in self.sounds.get(code, ()) if -1 <= len(word) - len(a) <= 3)

    def inside(self, word: str) -> str | None:
        if not re.fullmatch("[a-z]+", word) or word in self.dictionary:
            return None
        return self.first(a for a in self.within(word) if len(a) < len(word))

    def token(self, raw: str) -> str | None:
        """First answer that a token reveals; a worker remembers its verdicts."""
        if raw in self.seen:
            return self.seen[raw]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        hit = self.seen[raw] = self._token(raw)
        return hit

    def _token(self, raw: str) -> str | None:
        bare = re.sub("[^a-z0-9]", "", raw)
        for piece in dict.fromkeys([raw, bare, *filter(None, re.split("[^a-z]+", raw))]):
            for v in looks(piece):
                hit = self.exact(v) or self.exact(v[::-1]) or self.fuzzy(v) or self.inside(v)
                if not hit and (v == piece or len(v) == len(bare)):
                    hit = self.wildcard(v)
                if not hit:
                    hit = next((h for r in leet(v) if (h := self.exact(r) or self.fuzzy(r))), None)
                if hit:
                    return hit
        return None

    def stream(self, s: str, cap: int = 12) -> str | None:
        if len(s) < 3:
            return None
        return self.exact(s) or (self.first([*self.within(s), *self.within(s[::-1])]) if len(s) <= cap else None)

    def foreign(self, spelling: str, abjad: bool) -> str | None:
        if hit := self.exact(spelling):
            return hit
        start = {"c": "k", "q": "k"}
        found: list[str | None] = [*self.edited(spelling), self.single.get(undoubled(spelling))]
        if abjad:
            found += [self.bare.get(consonants(spelling)), self.bare.get(consonants(spelling, "aeiouy"))]
        if self.options.phonetic:
            found += [a for code in double_metaphone(spelling) for a in self.sounds.get(code, ())
                      if abs(len(a) - len(spelling)) <= 1 and start.get(a[0], a[0]) == start.get(spelling[0], spelling[0])]
        return self.first(found)

    # ---- one text

    def normalize(self, text: str, names: bool = False, confusables: bool = True) -> str:
        t = _HIDDEN.sub("", text)
        for pattern, new in _ART + _MARKUP:
            t = pattern.sub(new, t)
        if names and self.emoji_names:
            t = _EMOJI.sub(lambda m: f" {self.emoji_names.get(m[0].replace(chr(0xFE0F), ''), m[0])} ", t)
        t = t.lower()
        if t.isascii():
            return t
        t = _EMOJI.sub(" ", t.translate(_STYLE))
        t = _marks().sub("", unicodedata.normalize("NFKD", t))
        if confusables and self.confusables:
            t = "".join(self.confusables.get(c, c) for c in t).lower()
        return t.translate(_STYLE)

    def scan(self, text: str | None, depth: int = 0) -> str | None:
        """First answer that a text reveals, or None; texts decoded from it are scanned again to depth 2."""
        if not text or not self.answers:
            return None
        return next((hit for hit in self._rules(text, depth) if hit), None)

    def blob(self, text: str) -> str | None:
        """First answer of a text decoded from a run; a worker remembers it."""
        if text in self.read:
            return self.read[text]
        if len(self.read) >= REMEMBERED:
            self.read.clear()
        hit = self.read[text] = self.scan(text, 1)
        return hit

    def _rules(self, raw: str, depth: int) -> Iterator[str | None]:
        if depth == 0:
            yield from map(self.blob, blobs(raw))
        norm = self.normalize(raw)
        for form in [*morse_forms(norm), *morse_forms(raw.lower())]:
            runs = [r for r in _CODE.findall(form) if len(r) > 4]
            yield next((a for code, a in self.codes if any(code in r for r in runs)), None) if runs else None
        for source in filter(None, (norm, number_words(norm))):
            for found in decoded(source):
                yield self.scan(found, depth + 1) if depth < 2 else self.exact(found)
        tokens = []
        for w in norm.split():
            # most texts end here, at their first token that reveals something
            if t := w if w.isascii() and w.isalnum() and w == w.lower() else _TRIM.sub("", w):
                tokens.append(t)
                yield self.token(t)
        if self.options.scripts:
            yield from (self.foreign(v, s.abjad) for s in transliterate(_HIDDEN.sub("", raw)) for v in s.variants)
        words = [w for w in map(only_letters, tokens) if w]
        yield from (self.exact(s) or self.wildcard(s) for s in spelled(words))
        parts = [p for p in (re.sub(r"[^a-z0-9@$!|+(€£¢]", "", t) for t in tokens) if p]
        yield from self._joined(parts)
        if self.options.filler_join:
            yield self._pieces([p for p in parts if p.isalpha()])
        lines = [x.strip() for x in norm.split("\n") if x.strip()]
        if self.options.streams:
            yield from self._streams(norm, lines)
        if self.options.capitals:
            yield from map(self.stream, [*capital_streams(raw), marked_stream(raw), self._styled(raw)])
        if self.options.boundary:
            yield self._boundary(words)
        if self.options.arithmetic:
            yield self._edits(words, norm)
        if self.options.acrostics:
            lists = [[p for p in parts if p.isalpha()]]
            if _EMOJI.search(raw) and self.emoji_names:
                lists.append([w for w in self.normalize(raw, names=True).split() if re.fullmatch("[a-z]+", w)])
            for ws in lists:
                yield self._acrostic([(w[0], w) for w in ws], 2)
                yield self._backwards("".join(w[0] for w in ws))
            yield self._emoji_initials(raw)
        yield from self._turned(raw, norm)

    @cached_property
    def shifted_parts(self) -> set[str]:
        """Parts of all Caesar shifts of the answers."""
        return {form[i:j] for form in self.caesar for i in range(len(form)) for j in range(i + 1, len(form) + 1)}

    def asks(self, word: str) -> bool:
        """False only if no rule's verdict changes with the word in the dictionary; for a detector without one."""
        return bool(word in self.shifted_parts or self.fuzzy(word) or self.inside(word) or self.edited(word))

    def _joined(self, parts: list[str]) -> Iterator[str | None]:
        for i in range(len(parts)):
            joined = parts[i]
            for j in range(i + 1, min(len(parts), i + 12)):
                joined += parts[j]
                if len(joined) > self.longest + 3:
                    break
                yield from map(self.exact, looks(joined))
                if len(joined) <= self.longest:
                    yield self.wildcard(joined)
                yield from map(self.exact, leet(joined))
                if self.options.caesar_join and all(len(p) <= 2 or p not in self.dictionary for p in parts[i : j + 1]):
                    yield self.caesar.get(joined)

    def _pieces(self, words: list[str]) -> str | None:
        """An answer in short pieces with up to four words between: a breadth-first search over (letters, pieces, non-word, skipped)."""
        for i, begin in enumerate(words):
            if len(begin) > 3 or begin not in self.prefixes:
                continue
            states = {("", 0, False, 0)}
            for w in words[i : i + 12]:
                new = set()
                for got, n, odd, skipped in states:
                    if len(w) <= 3 and got + w in self.prefixes:
                        s = (got + w, n + 1, odd or (len(w) > 1 and w not in self.dictionary), skipped)
                        if s[0] in self.order and s[1] >= (2 if s[2] else 3):
                            return s[0]
                        new.add(s)
                    if got and skipped < 4:
                        new.add((got, n, odd, skipped + 1))
                states = new
                if not states:
                    break
        return None

    def _streams(self, norm: str, lines: list[str]) -> Iterator[str | None]:
        stream = letter_stream([t for t in (re.sub("^[^a-z0-9]+|[^a-z0-9]+$", "", w) for w in re.split(r"[\s\-]+", norm)) if t])
        letters = only_letters(stream)
        yield self.stream(letters) or (self.fuzzy(letters) if letters else None)
        yield from map(self.exact, leet(stream))
        if len(lines) >= 3:
            yield self.stream("".join(m[0] for x in lines if (m := re.search("[a-z]", x))), 40)
            yield from (self.stream(only_letters(s), 40) for s in grid_streams(lines))

    def _styled(self, raw: str) -> str:
        if len(re.findall("[A-Za-z]", raw)) < 3:
            return ""
        odd = [c for c in raw if ord(c) > 127 and (ord(c) in _STYLE or 0xFF21 <= ord(c) <= 0xFF5A or 0x24B6 <= ord(c) <= 0x24E9)]
        return only_letters(unicodedata.normalize("NFKD", "".join(odd).lower().translate(_STYLE)))

    def _boundary(self, words: list[str]) -> str | None:
        flat, ends = "".join(words), set()
        at = 0
        for w in words:
            at += len(w)
            ends.add(at)
        found = (flat[i : i + n] for n in self.lengths for b in ends for i in range(max(b - n + 1, 0), b))
        return self.first(w for w in found if w in self.order)

    def _edits(self, words: list[str], norm: str) -> str | None:
        alone = {v for w in words for v in looks(w) if len(v) == 1}
        told = bool(re.search(rf"\b{T.INSTRUCTIONS}\b|\bletter\b", norm, re.A))
        for w in words if alone else ():
            if len(w) < 4 or w not in self.dictionary:
                continue
            for a in sorted(self.edited(w), key=self.order.__getitem__):
                longer = w if len(w) > len(a) else a
                i = next((k for k in range(len(longer)) if w[k : k + 1] != a[k : k + 1]), None)
                if i is not None and longer[i] in alone and (told or longer[i] not in "ai"):
                    return a
        return None

    def _acrostic(self, options: list[tuple[str, ...]], skips: int, words: bool = True) -> str | None:
        """An answer from a choice of each item in turn, some skipped; with ``words`` at least one choice is the item's first."""
        been = set()  # states that led to no answer
        for i in range(len(options)):
            stack = [(i, "", not words, skips)]
            while stack:
                state = at, got, fit, left = stack.pop()
                if got and state in been:
                    continue
                been.add(state)
                if got in self.order and fit:
                    return got
                if at >= len(options):
                    continue
                if got and left:
                    stack.append((at + 1, got, fit, left - 1))
                for k, choice in reversed(list(enumerate(options[at]))):
                    if got + choice in self.prefixes:
                        stack.append((at + 1, got + choice, fit or k == 0, left))
        return None

    def _backwards(self, initials: str) -> str | None:
        turned = initials[::-1]
        gaps = (w[:k] + w[k + 1 :] for n in self.lengths for i in range(len(turned) - n) for w in (turned[i : i + n + 1],) for k in range(1, n))
        return self.first([*self.within(turned), *(w for w in gaps if w in self.order)])

    def _emoji_initials(self, raw: str) -> str | None:
        names = [self.emoji_names.get(e.replace("️", ""), "") for e in _EMOJI.findall(raw)] if self.emoji_names else []
        options = [o for n in names if (o := tuple(dict.fromkeys(w[0] for w in re.split("[^a-z]+", n.lower()) if w)))]
        return self._acrostic(options, 1, words=False) if len(options) >= 3 else None

    def _turned(self, raw: str, norm: str) -> Iterator[str | None]:
        plain = self.normalize(raw, confusables=False) if self.confusables else norm
        turned = plain[::-1].translate(_TURN)
        if turned != plain:
            tokens = turned.split()
            yield from (self.exact(only_letters(t)) for t in tokens)
            yield self.stream(letter_stream(tokens))


def _printable(text: str) -> str | None:
    return text if text and all(c.isspace() or unicodedata.category(c)[0] in "LNPS" for c in text) else None


@lru_cache(maxsize=REMEMBERED)
def _base64(run: str) -> str | None:
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return _printable(base64.b64decode(run + "=" * (-len(run) % 4)).decode("utf-8"))
    except (binascii.Error, UnicodeDecodeError):
        return None


def blobs(raw: str) -> Iterator[str]:
    """Printable texts of Base64 and Base32 runs."""
    yield from filter(None, map(_base64, _RUN.findall(raw)))
    yield from filter(None, (_printable(base32(run)) for run in _RUN32.findall(raw)))


def morse_forms(text: str) -> list[str]:
    """A text with all dots and dashes alike, and its runs of them with letters between spaces."""
    t = re.sub("[−–—―➖▬━_]", "-", re.sub("[·•∙⋅●⚫🔴🔵🟢🟡🟠🟣🟤⭕*]", ".", text))
    if len(re.findall(r"\b(?:dit|dah|di|da|dot|dash)\b", t)) >= 3:
        t = re.sub(r"\b(?:dah|da|dash)\b", "-", re.sub(r"\b(?:dit|di|dot)\b", ".", t))
    runs = [r for r in re.findall(r"[.\-\s,/|]{5,}", t) if re.search(r"[.-][\s,/|]+[.-]", r) and len(re.sub("[^.-]", "", r)) >= 5]
    return [t, *(" ".join(filter(None, (_WHITE.sub("", x) for x in re.split(r"\s*[,/|\n]\s*|\s{2,}", r)))) for r in runs)]


def number_words(norm: str) -> str | None:
    """A text's words with number words as digits; None for fewer than three."""
    out, n, ten = [], 0, False
    all_words = _PLAIN.findall(norm)
    if sum(map(_NUMBERS.__contains__, all_words)) < 3:
        return None
    for w in all_words:
        value = _NUMBERS.get(w)
        if ten and value is not None and 0 <= value < 10 and w in _UNITS:
            out[-1] = str(int(out[-1]) + value)
            ten = False
            continue
        n += value is not None
        ten = value is not None and value >= 20
        out.append(w if value is None else str(value))
    return " ".join(out) if n >= 3 else None


def decoded(norm: str) -> list[str]:
    """Texts read from numbers and escapes, as letters and spaces."""
    out: list[str] = []
    runs, now, gap = [], [], 0
    digits = len(_DIGITS.findall(norm))
    for t in _PLAIN.findall(_ORDINAL.sub(r"\1", norm)) if digits >= 3 else ():
        gap = 0 if t.isdigit() else gap + 1
        if t.isdigit():
            now.append(t)
        elif gap > 2:
            runs.append(now)
            now = []
    runs = [r for r in [*runs, now] if len(r) >= 3]
    # places and values in turn: "letter 1 = 23, letter 2 = 1"
    runs += [r[1::2] for r in runs if len(r) >= 6 and len(r) % 2 == 0 and all(int(x) == i for i, x in enumerate(r[::2], 1))]
    for run in runs:
        numbers = [int(x) for x in run]
        letters = [x for x in numbers if 1 <= x <= 26]
        if len(letters) >= 3 and sum(x != 0 for x in numbers) - len(letters) <= 2:
            out.append("".join(chr(96 + x) for x in letters))
        if max(numbers) <= 25:
            out.append("".join(chr(97 + x) for x in numbers))
        if all(65 <= x <= 122 for x in numbers):
            out.append("".join(map(chr, numbers)).lower())
        for base, form in ((8, "1[0-7][0-7]"), (2, "[01]{7,8}")):
            if all(re.fullmatch(form, x) for x in run):
                out.append("".join(chr(int(x, base)) for x in run).lower())
    for group in _NO_PAIRS.split(norm):
        if len(group) < 8:  # three pairs and what is between them
            continue
        pairs = _HEX_PAIR.findall(group)
        out += ["".join(chr(int(p, 16)) for p in pairs).lower()] if len(pairs) >= 3 else []
    for sign, run, code in (
        ("%", r"(?:%[0-9a-f]{2}){3,}", r"%([0-9a-f]{2})"), ("\\", r"(?:\\u[0-9a-f]{4}\s*){3,}", r"\\u([0-9a-f]{4})"), ("\\", r"(?:\\x[0-9a-f]{2}\s*){3,}", r"\\x([0-9a-f]{2})"),
        ("+", r"(?:u\+[0-9a-f]{4}\s*){3,}", r"u\+([0-9a-f]{4})"), ("%", r"(?:%u[0-9a-f]{4}\s*){3,}", r"%u([0-9a-f]{4})"), ("&#", r"(?:&#x[0-9a-f]+;?\s*){3,}", r"&#x([0-9a-f]+)"),
        ("0", r"\b0x(?:[0-9a-f]{2}){3,}\b", r"(?<!^)([0-9a-f]{2})"),
    ):
        for m in re.finditer(run, norm, re.I) if sign in norm else ():
            body = m[0][2:] if m[0][:2].lower() == "0x" else m[0]
            codes = re.findall(code.replace("(?<!^)", ""), body, re.I)
            out.append("".join(chr(min(int(c, 16), 0xFFFF)) for c in codes).lower())
    for m in re.finditer(r"(?:&#\d+;?\s*){3,}", norm) if "&#" in norm else ():
        out.append("".join(chr(min(int(n), 0xFFFF)) for n in re.findall(r"\d+", m[0])).lower())
    for bits in re.findall(r"\b[01]{24,}\b", norm) if digits else ():
        out += ["".join(chr(int(bits[i : i + w], 2)) for i in range(0, len(bits), w)).lower() for w in (8, 7) if len(bits) % w == 0]
    clean = (re.sub(r"[^a-z\s]", " ", s).strip() for s in out)
    return [s for s in clean if re.search("[a-z]{3}", _WHITE.sub("", s))]


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more named letters, one other word between allowed."""
    out, now, gap = [], "", 0
    for w in re.sub(r"\b(?:double|doble) (?:u|you|yu|ve)\b", "doubleu", " ".join(words)).split():
        letter = _LETTER_NAMES.get(w, "")
        gap = 0 if letter else gap + 1
        now += letter
        if gap > 1:
            out.append(now)
            now = ""
    return [s for s in [*out, now] if len(s) >= 3]


def letter_stream(tokens: list[str]) -> str:
    fit = (t for t in tokens if re.fullmatch(r"[a-z0-9@$!|+]|[a-z]\d{1,2}|\d{1,2}[a-z]", t))
    return "".join(t if len(t) == 1 else re.sub(r"\d", "", t) for t in fit)


def capital_streams(raw: str) -> list[str]:
    links = re.sub(r"https?://\S+", " ", raw)
    t = re.sub(r"\b[A-Z]{2,}\b", " ", links, flags=re.A)

    def caps(s: str) -> str:
        return re.sub("[^A-Z]", "", s).lower()

    out = []
    if len(re.findall("[a-z]", t)) >= 3 and 3 <= len(caps(t)) <= 12:
        out = [caps(t), caps(re.sub(r"(^|[.!?]\s+)[A-Z]", r"\1", t)), caps(re.sub(r"\bI\b", "", t, flags=re.A))]
    small = only_letters(links)
    if 3 <= len(small) <= 12 and len(caps(links)) > len(small):
        out.append(small)
    return list(dict.fromkeys(out))


def marked_stream(raw: str) -> str:
    spans = [next(filter(None, m.groups())) for m in _MARKED.finditer(raw)]
    return only_letters("".join(spans).lower()) if len(spans) >= 2 else ""


def grid_streams(lines: list[str], rows: int = 40, columns: int = 80) -> list[str]:
    """Columns, and diagonals from the first row and column in both directions, of a block of lines."""
    block = [_WHITE.sub("", x)[:columns] for x in lines[:rows]]
    width = max(map(len, block), default=0)
    out = ["".join(r[j : j + 1] for r in block) for j in range(width)]
    for d in range(3 - len(block), max(width - 2, 0) + 1):
        for place in (lambda i, d=d: d + i - 1, lambda i, d=d: width - d - i):
            out.append("".join(r[place(i) : place(i) + 1] for i, r in enumerate(block) if place(i) >= 0))
    return [s for s in out if len(s) >= 3]
