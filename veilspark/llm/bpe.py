"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fed, kept, slices

# Classes of code points that the pre-tokeniser tells apart. White space before a
# visible character and a closing apostrophe are told from what follows.
LETTER, DIGIT, OTHER, SPACE, BLANK, TAIL, QUOTE1, QUOTE2 = range(8)
#: Code points tokenised at once, and pieces whose ids a worker keeps.
CHARS, PIECES = 1 << 20, 400_000
#: Positions of one run of the blocked scan.
RUN = 128


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, digit, other, plain space, other white space."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, everything):
            lo, hi = (x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1))
            table[lo : hi + 1][table[lo : hi + 1] == OTHER] = kind
    table[0x20] = SPACE
    table[0xD800:0xE000] = OTHER
    return table


# States of the scan before a character: 0 an apostrophe joins what stands before it, 1 an apostrophe
# may begin a contraction, 2 and 3 one and two letters of a contraction are due.
_NEXT = np.array(
    [
        [1, 1, 1, 2],  # LETTER
        [1, 1, 1, 1],  # DIGIT
        [0, 0, 0, 0],  # OTHER
        [0, 0, 0, 0],  # SPACE
        [1, 1, 1, 1],  # BLANK
        [1, 1, 1, 1],  # TAIL
        [0, 2, 0, 0],  # QUOTE1
        [0, 3, 0, 0],  # QUOTE2
    ],
    np.uint8,
)


@lru_cache(maxsize=1)
def _scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions on four states as bytes of four 2-bit digits: of a class, of two in turn, at a state."""
    digits = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
    of_class = (_NEXT.astype(int) << (2 * np.arange(4))).sum(axis=1).astype(np.uint8)
    chained = digits[np.arange(256)[None, :, None], digits[:, None, :]]  # [f, g] is g after f
    return of_class, (chained << (2 * np.arange(4))).sum(axis=2).astype(np.uint8).ravel(), digits.astype(np.uint8).ravel()


def states(kinds: np.ndarray) -> np.ndarray:
    """State before each position, by an associative scan of the classes' transition functions.

    Runs of RUN positions are scanned side by side, each composing its functions from its own start;
    then the runs' totals are scanned in the same way, and each run's prefixes are applied to the state it begins in.
    """
    of_class, chain, at = _scan_tables()
    n = len(kinds)
    if n <= RUN:
        out, state = np.empty(n, np.uint8), 1
        for i, k in enumerate(kinds.tolist()):
            out[i] = state
            state = _NEXT[k, state]
        return out
    runs = -(-n // RUN)
    step = np.full(runs * RUN, 0b11100100, np.int32)  # the identity
    step[:n] = of_class[kinds]
    grid = np.ascontiguousarray(step.reshape(runs, RUN).T)
    prefix = np.empty((RUN + 1, runs), np.int32)
    prefix[0] = 0b11100100
    for i in range(RUN):
        np.take(chain, (prefix[i] << 8) + grid[i], out=(row := np.empty(runs, np.uint8)))
        prefix[i + 1] = row
    begin = _run_states(prefix[RUN])
    return at[(prefix[:RUN] << 2) + begin].T.ravel()[:n]


def _run_states(totals: np.ndarray) -> np.ndarray:
    """State at the start of each run, from the runs' composed functions (doubling scan)."""
    _, chain, at = _scan_tables()
    scan = totals.copy()
    hop = 1
    while hop < len(scan):
        scan[hop:] = chain[(scan[:-hop] << 8) + scan[hop:]]
        hop *= 2
    begin = np.ones(len(scan), np.int32)
    begin[1:] = at[(scan[:-1] << 2) + 1]
    return begin


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of all pieces in ``codes`` (code points of several texts, beginning at ``starts``)."""
    n = len(codes)
    kinds = classes()[codes]
    white = (kinds == SPACE) | (kinds == BLANK)
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    begins[n] = True
    last = begins[1:]
    follow = np.empty(n, bool)  # white space follows, or the text's end
    follow[:-1] = white[1:]
    follow[-1:] = True
    follow |= last
    kinds[white & follow] = TAIL
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        one, two = np.minimum(quote + 1, n - 1), np.minimum(quote + 2, n - 1)
        in1 = (quote + 1 < n) & ~begins[np.minimum(quote + 1, n)]
        in2 = in1 & (quote + 2 < n) & ~begins[np.minimum(quote + 2, n)]
        a, b = codes[one], codes[two]
        short = in1 & np.isin(a, [ord(c) for c in "stmd"])
        long = in2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        kinds[quote[short]] = QUOTE1
        kinds[quote[long]] = QUOTE2
    before = states(kinds)
    # a text's first character doesn't see the text before it
    before[starts[starts < n]] = 1
    fresh = np.flatnonzero((kinds[starts[starts < n]] == QUOTE1) | (kinds[starts[starts < n]] == QUOTE2))
    for i in starts[starts < n][fresh].tolist():
        before[i + 1] = 2 if kinds[i] == QUOTE1 else 3
        if kinds[i] == QUOTE2:
            before[i + 2] = 2
        end = i + (2 if kinds[i] == QUOTE1 else 3)
        if end < n:
            before[end] = 1
    contraction = ((kinds == QUOTE1) | (kinds == QUOTE2)) & (before == 1)
    plain = np.where(kinds >= QUOTE1, OTHER, kinds)
    group = np.where(plain == SPACE, BLANK, np.where(plain == TAIL, BLANK, plain))
    start = np.empty(n, bool)
    start[:1] = True
    prev, kind = group[:-1], group[1:]
    start[1:] = np.where(
        kind == BLANK, (prev != BLANK) | (plain[1:] != TAIL), (prev != kind) & (plain[:-1] != SPACE)
    )
    start |= contraction
    inside = (before == 2) | (before == 3)
    start[inside] = False
    ended = np.flatnonzero(before[:-1] == 2) + 1
    start[ended] = True
    start |= begins[:-1]
    return np.flatnonzero(start)


class Codec:
    """Encodes and decodes by a rank file in the tiktoken form (base64 of the bytes, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: merge the adjacent pair of the least rank, leftmost first, until none has one.

        A short piece keeps its pairs' ranks in a list; in a long one pairs wait in a heap and
        neighbours in linked lists, so that it takes n log n steps.
        """
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n <= 48:
            find, none = ranks.get, 1 << 30
            at = list(range(n + 1))  # where each part begins
            pair = [find(piece[i : i + 2], none) for i in range(n - 1)]
            while pair and (low := min(pair)) < none:
                i = pair.index(low)
                del at[i + 1]
                del pair[i]
                if i < len(pair):
                    pair[i] = find(piece[at[i] : at[i + 2]], none)
                if i:
                    pair[i - 1] = find(piece[at[i - 1] : at[i + 1]], none)
            return tuple([ranks[piece[a:b]] for a, b in zip(at, at[1:])])
        import heapq

        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if dead[i] or j >= n or end[j] != stop:
                continue
            dead[j] = 1
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; a batch of texts is pre-tokenised as one array of code points."""
        out: list[list[int]] = [[] for _ in texts]
        live = [(i, t) for i, t in enumerate(texts) if t]
        if not live:
            return out
        joined = "".join(t for _, t in live)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.cumsum([0, *[len(t) for _, t in live[:-1]]])
        cuts = boundaries(codes, starts)
        first = np.searchsorted(cuts, starts).tolist() + [len(cuts)]
        cuts = [*cuts.tolist(), len(joined)]
        cache, merge = self.cache, self.merge
        for k, (i, _) in enumerate(live):
            ids = out[i]
            for p in range(first[k], first[k + 1]):
                piece = joined[cuts[p] : cuts[p + 1]]
                got = cache.get(piece)
                if got is None:
                    got = merge(piece.encode("utf-8", "surrogatepass"))
                    if len(cache) >= PIECES:
                        cache.clear()
                    if len(piece) <= 64:
                        cache[piece] = got
                ids += got
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids; an unknown id is an error."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset at which each id's bytes begin, and the end: what maps tokens back to text."""
        return np.cumsum([0, *[len(self.bytes[i]) for i in ids]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHARS code points together (one text is never cut)."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, path: str, keep: list[str], ids: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` (but any of the new names) with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and offsets.

    ``path`` names a rank file every executor can read. Null and empty texts have no tokens. No
    special tokens: their strings are ordinary text. ids_sha256 is of the decimal ids joined by one
    space, decoded_sha256 of the bytes that the ids decode to; ``offsets`` holds each token's first
    byte in the text. Texts are never cut; a text that the ids don't decode to stops the run.
    """
    keep, own_columns = kept(keep, ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"])
    schema = docs.select(*own_columns).schema
    for name, kind in [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>"), ("offsets", "array<long>")] * ids:
        schema = schema.add(name, kind if "<" not in kind else __import__("pyspark.sql.types", fromlist=["_"])._parse_datatype_string(kind))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for part in slices(parts):
            texts = ["" if t is None else t for t in part.column(len(keep)).to_pylist()]
            count, sha_ids, sha_bytes, all_ids, all_offsets = [], [], [], [], []
            for lo, hi in batches(texts):
                for text, own in zip(texts[lo:hi], tool.encode(texts[lo:hi]), strict=True):
                    back = tool.decode(own)
                    if back != text.encode("utf-8", "surrogatepass"):
                        raise ValueError("ids do not decode to their text")
                    count.append(len(own))
                    sha_ids.append(hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
                    sha_bytes.append(hashlib.sha256(back).hexdigest())
                    if ids:
                        all_ids.append(np.asarray(own, np.int32))
                        all_offsets.append(tool.offsets(own)[:-1])
            columns = [part.column(i) for i in range(len(keep))]
            columns += [pa.array(count, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_bytes, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                ends = pa.array(np.cumsum([0, *map(len, all_ids)]), pa.int32())
                flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((all_ids, np.int32), (all_offsets, np.int64))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(flat[0])), pa.ListArray.from_arrays(ends, pa.array(flat[1]))]
                names += ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return fed(docs, own_columns).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public 50k byte-level ranks and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"], ids=False)
