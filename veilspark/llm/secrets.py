"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fed, kept, slices

# The base patterns, in their listed order, with the length that a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]
KEYWORDS = re.compile(r"passw(or)?d|pwd|secret|token|api_?key|credential|bearer|auth|private|access", re.I)
NAMES = ("passw", "pwd", "secret", "token", "api_key", "apikey", "credential", "bearer", "private", "access")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat-")

_TOKEN = re.compile(r"[\w+/=\-]+|[^\w\s]")
#: Tags: outside, begin, inside. Places of the tokens whose features a tag sees.
O, B, I = range(3)
OFFSETS = (0, -1, -2, -3, 1)
#: Distinct tokens a worker remembers.
TOKENS = 300_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> tuple[str, ...]:
    """Features of a token's looks, as strings."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return ("sym", f"sym={token if token in chr(34) + chr(39) + '=:;,(){}[]<>|&' else '?'}")
    if token.isalpha() and token.isascii() and n < 16 and not KEYWORDS.search(token) and (token[1:].islower() or n == 1):
        return ("word", f"len={min(n // 4, 3)}")
    digits, upper = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    lower, special = sum(c.islower() for c in token), sum(c in "+/=_-" for c in token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    size = next(i for i, top in enumerate((3, 7, 11, 15, 19, 23, 31, 39, 63, 1 << 40)) if n <= top)
    mix = f"{int(digits > 0)}{int(upper > 0)}{int(lower > 0)}{int(special > 0)}"
    pure_hex = n >= 6 and digits > 0 and all(c in "0123456789abcdefABCDEF" for c in token)
    out = [
        "long", f"size={size}", f"mix={mix}", f"turns={min(turns, 6)}", f"digits={min(4 * digits // n, 3)}",
        f"dots={min(token.count('.'), 2)}", f"hex={int(pure_hex)}", f"size={size},mix={mix}",
        f"hex={int(pure_hex)},size={size}", f"turns={min(turns, 6)},mix={mix}", f"ascii={int(token.isascii())}",
    ]
    if KEYWORDS.search(token):
        out.append(f"key={int(n <= 24)}")
    if token.startswith(PREFIXES):
        out.append(f"prefix={int(n >= 16)}")
    return tuple(out)


def file_features(text: str) -> int:
    """A file's class, of 4: whether it names a secret anywhere, and whether code symbols are above a fiftieth."""
    low = text.lower()
    symbols = sum(map(text.count, "={};:<>"))
    return 2 * int(any(k in low for k in NAMES)) + int(50 * symbols > len(text))


@dataclass
class Field:
    """A trained field: feature weights for each offset, file weights, transitions and first tags."""

    features: dict[str, int]
    weights: np.ndarray  # (offsets, features, 3)
    files: np.ndarray  # (4, 3)
    steps: np.ndarray  # (3, 3)
    first: np.ndarray  # (3,)

    def __post_init__(self):
        self.tokens: dict[str, int] = {}
        self.shapes: dict[tuple[str, ...], int] = {(): 0}
        self.emit = np.zeros((len(OFFSETS), 1, 3))
        span = self.steps.max() - self.steps.min()
        self.margin = 2 * max(span, np.ptp(self.first)) + 1e-6

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("features", "weights", "files", "steps", "first")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def shape_id(self, token: str) -> int:
        key = shape(token)
        at = self.shapes.get(key)
        if at is None:
            at = self.shapes[key] = len(self.shapes)
            own = [self.features[f] for f in key if f in self.features]
            self.emit = np.concatenate([self.emit, self.weights[:, own].sum(axis=1)[:, None]], axis=1)
        if len(self.tokens) >= TOKENS:
            self.tokens.clear()
        self.tokens[token] = at
        return at

    def tags(self, tokens: list[str], file: int) -> list[tuple[int, int]]:
        """(first, last) token of each secret on the best path.

        A token whose own evidence for "outside" outweighs all that transitions on both its sides could
        give is outside on the best path; so Viterbi runs only on the stretches between such tokens,
        with the same result.
        """
        get, know = self.tokens.get, self.shape_id
        ids = np.array([know(t) if (s := get(t)) is None else s for t in tokens], np.int32)
        n = len(ids)
        score = self.emit[0][ids] + self.files[file]
        for table, off in zip(self.emit[1:], OFFSETS[1:], strict=True):
            if off < 0:
                score[-off:] += table[ids[:off]]
            elif off < n:
                score[:-off] += table[ids[off:]]
        loose = np.flatnonzero(score[:, O] - np.maximum(score[:, B], score[:, I]) <= self.margin)
        if not len(loose):
            return []
        out = []
        breaks = np.flatnonzero(np.diff(loose) > 1) + 1
        for run in np.split(loose, breaks):
            lo, hi = int(run[0]), int(run[-1]) + 1
            path = self._viterbi(score[lo:hi], lo == 0, hi == n)
            for i, tag in enumerate(path):
                if tag == B:
                    out.append((lo + i, lo + i))
                elif tag == I and out and out[-1][1] == lo + i - 1:
                    out[-1] = (out[-1][0], lo + i)
        return out

    def _viterbi(self, score: np.ndarray, at_start: bool, at_end: bool) -> list[int]:
        best = score[0] + (self.first if at_start else self.steps[O])
        back = []
        for row in score[1:]:
            both = best[:, None] + self.steps
            back.append(both.argmax(axis=0))
            best = both.max(axis=0) + row
        tag = int((best if at_end else best + self.steps[:, O]).argmax())
        path = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            path.append(tag)
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code-point spans of the secrets that the field tags in a text."""
        got = self.tags(_TOKEN.findall(text), file_features(text)) if text else []
        if not got:
            return []
        places = [m.span() for m in _TOKEN.finditer(text)]
        return [(places[a][0], places[b][1]) for a, b in got]


def _examples(n: int, rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Made-up token sequences with tags: prose, code, numbers, addresses, and secrets in and out of context."""
    syllables = ["an", "er", "ti", "on", "the", "re", "lo", "mi", "ka", "sch", "eu", "ió", "ver", "de", "que", "ing"]
    letters, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hexes, ten = "0123456789abcdef", "0123456789"

    def pick(chars: str, a: int, b: int) -> str:
        return "".join(rng.choices(chars, k=rng.randint(a, b)))

    def word() -> str:
        w = "".join(rng.choices(syllables, k=rng.randint(1, 5)))
        return rng.choice([w, w, w, w.capitalize(), w.upper() if rng.random() < 0.2 else w])

    def value() -> str:
        return rng.choice([
            lambda: pick(hexes, 24, 64), lambda: pick(hexes, 32, 40), lambda: pick(letters + low + ten, 16, 48),
            lambda: pick(letters + low + ten + "+/", 20, 64) + rng.choice(["", "=", "=="]),
            lambda: "AKIA" + pick(letters + ten, 16, 16), lambda: rng.choice(PREFIXES[2:]) + pick(letters + low + ten, 16, 40),
            lambda: "eyJ" + pick(letters + low + ten + "_-", 20, 40) + "." + pick(letters + low + ten + "_-", 20, 60),
        ])()

    def weak() -> str:
        return pick(low, 3, 8) + pick(ten, 1, 4) + pick(letters, 0, 2)

    def plain() -> str:
        return rng.choice([
            lambda: pick(ten, 1, 6), lambda: pick(ten, 12, 19), lambda: "-".join(pick(ten, 2, 4) for _ in range(3)),
            lambda: f"{pick(low, 3, 9)}.{pick(ten, 1, 3)}", lambda: f"{pick(low, 3, 8)}{pick(ten, 1, 3)}.example.org",
            lambda: f"{pick(ten, 1, 3)}.{pick(ten, 1, 3)}.{pick(ten, 1, 3)}.{pick(ten, 1, 3)}", lambda: pick(letters, 2, 12),
            lambda: f"v{pick(ten, 1, 1)}.{pick(ten, 1, 2)}", lambda: word() + "-" + word(), lambda: word() + "_" + word(),
            lambda: "/".join(word() for _ in range(3)), lambda: pick(hexes, 4, 10), lambda: "".join(word() for _ in range(3)),
            lambda: pick(low, 14, 34), lambda: pick(low, 14, 34).capitalize(), lambda: "+" + pick(ten, 1, 2), lambda: "==",
        ])()

    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "client_secret", "auth_token", "private_key", "SECRET_KEY"]
    out = []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[int] = []

        def add(*ts: str, tag: int = O) -> None:
            for t in ts:
                parts = _TOKEN.findall(t)
                tokens.extend(parts)
                tags.extend([tag, *[I if tag else O] * (len(parts) - 1)])

        for _ in range(rng.randint(1, 5)):
            add(*[word() for _ in range(rng.randint(0, 8))])
            kind = rng.random()
            if kind < 0.35:
                add(plain())
            elif kind < 0.45:
                add(rng.choice(names), *[word() for _ in range(rng.randint(1, 3))])
            elif kind < 0.55:
                add(word(), rng.choice("=:"), *rng.choice([['"'], []]), plain())
            elif kind < 0.62:
                add(value(), tag=B)
            elif kind < 0.70:
                add('"')
                add(value(), tag=B)
                add('"')
            else:
                quote = rng.choice([['"'], ["'"], []])
                add(rng.choice(names), *rng.choice([["="], [":"], ['"', ":"], ["is"]]), *quote)
                add(rng.choice([value, value, weak])(), tag=B)
                if rng.random() < 0.05:
                    add(value(), tag=I)
                add(*quote)
        out.append((tokens, tags))
    return out


@lru_cache(maxsize=2)
def train(examples: int = 2000, rounds: int = 90, seed: int = 11) -> Field:
    """Maximum-likelihood field over made-up examples (forward-backward gradients, Adam); reruns agree.

    No corpus row is read: the examples come from the rules in ``_examples``, so the model doesn't depend
    on the data's size, and ``examples`` bounds what the driver holds.
    """
    data = [e for e in _examples(examples, random.Random(seed)) if e[0]]
    shapes: dict[tuple[str, ...], int] = {(): 0}
    features: dict[str, int] = {}
    rows = [[shapes.setdefault(shape(t), len(shapes)) for t in tokens] for tokens, _ in data]
    for key in shapes:
        for f in key:
            features.setdefault(f, len(features))
    hot = np.zeros((len(shapes), len(features)))
    for key, i in shapes.items():
        hot[i, [features[f] for f in key]] = 1
    n, width = len(rows), max(map(len, rows))
    length = np.array(list(map(len, rows)))
    x = np.zeros((n, width + 8), int)
    y = np.zeros((n, width), int)
    for i, (r, (_, tags)) in enumerate(zip(rows, data, strict=True)):
        x[i, 4 : 4 + len(r)], y[i, : len(r)] = r, tags
    file = np.array([file_features(" ".join(t)) for t, _ in data])
    mask = np.arange(width)[None] < length[:, None]
    gold = np.eye(3)[y] * mask[..., None]
    p = {"weights": np.zeros((len(OFFSETS), len(features), 3)), "files": np.zeros((4, 3)), "steps": np.zeros((3, 3)), "first": np.zeros(3)}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    places = [x[:, 4 + off : 4 + off + width] for off in OFFSETS]
    for t in range(1, rounds + 1):
        emit = np.einsum("sf,ofc->osc", hot, p["weights"])
        score = sum(e[i] for e, i in zip(emit, places, strict=True)) + p["files"][file][:, None]
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = score[:, 0] + p["first"]
        for j in range(1, width):
            new = np.logaddexp.reduce(alpha[:, j - 1, :, None] + p["steps"], axis=1) + score[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        for j in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(p["steps"] + (score[:, j + 1] + beta[:, j + 1])[:, None], axis=2)
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        unary = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        inner = mask[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + p["steps"] + (score + beta)[:, 1:, None] - z[:, None, None, None]) * inner[..., None, None]
        off = unary - gold
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for o, place in enumerate(places):
            by_shape = np.stack([np.bincount(place.ravel(), weights=off[..., c].ravel(), minlength=len(shapes)) for c in range(3)], axis=1)
            g["weights"][o] = hot.T @ by_shape
        np.add.at(g["files"], file, off.sum(axis=1))
        g["steps"] = pair.sum(axis=(0, 1)) - np.einsum("nji,njk->ik", gold[:, :-1] * inner[..., None], gold[:, 1:])
        g["first"] = off[:, 0].sum(axis=0)
        for k in p:
            grad = g[k] / n + 2e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.98 * s[k] + 0.02 * grad**2
            p[k] = p[k] - 0.12 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.98**t)) + 1e-6)
    return Field(features, p["weights"], p["files"], p["steps"], p["first"])


def scan(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """All spans of a text (null: none), by start and kind: the base ones, and the field's that touch none."""
    if not text:
        return []
    base = base_spans(text)
    extra = [(a, b, "crf") for a, b in field.spans(text) if not any(a < e and s < b for s, e, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, keep: list[str], field: Field | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (one named found is replaced) and found: array of (start, end, kind) over each whole text.

    Starts and ends are code points, ends exclusive. Null and empty texts have none. The field tags what
    the patterns miss; its spans that overlap a base span are left out, base spans always stay.
    """
    from pyspark.sql.types import _parse_datatype_string

    field = field or train()
    keep, columns = kept(keep, ["found"])
    schema = docs.select(*columns).schema.add("found", _parse_datatype_string("array<struct<start:long,end:long,kind:string>>"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t, field)] for t in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "found"])

    return fed(docs, columns).mapInArrow(run, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: counts of the base kinds, their digest, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count("crf"),
    )
