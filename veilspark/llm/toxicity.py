"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices

#: Most labelled rows that a model is fitted on, and least rows of a term.
SAMPLE, SUPPORT = 9000, 3
#: Rounds of the fit, and size of the soft threshold against a gradient's greatest noise among all terms.
ROUNDS, NOISE = 150, 1.0
#: Entries of the sparse matrix that are looked at a time.
GATHERED = 1 << 17
#: Buckets of the hash, rank of the interactions, distinct words a worker remembers.
BUCKETS, RANK, WORDS = 1 << 28, 8, 200_000
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")


def bucket(word: str) -> int:
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 2654435761 >> 4) % BUCKETS


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Machine:
    """Score sigmoid(bias + sum w_i + sum <v_i, v_j>) over the distinct known terms of a text."""

    buckets: np.ndarray  # sorted hashes of the terms kept
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.seen: dict[str, int] = {}
        self.place = {int(b): i for i, b in enumerate(self.buckets)}

    def __getstate__(self):
        return {"buckets": self.buckets, "bias": self.bias, "w": self.w, "v": self.v}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def terms(self, text: str) -> list[int]:
        """Places of the known terms among a text's distinct lower-cased words."""
        seen, place, out = self.seen, self.place, set()
        if len(seen) > WORDS:
            seen.clear()
        for word in set(_WORD.findall(text.lower())):
            at = seen.get(word)
            if at is None:
                at = seen[word] = place.get(bucket(word), -1)
            if at >= 0:
                out.add(at)
        return sorted(out)

    def margins(self, rows: list[list[int]]) -> np.ndarray:
        counts = np.array([len(r) for r in rows], int)
        out = np.full(len(rows), self.bias)
        live = np.flatnonzero(counts)
        if len(live):
            flat = np.concatenate([rows[i] for i in live])
            begin = np.cumsum([0, *counts[live][:-1]])
            v = self.v[flat]
            s = np.add.reduceat(v, begin, axis=0)
            out[live] += np.add.reduceat(self.w[flat], begin) + 0.5 * (s**2 - np.add.reduceat(v**2, begin, axis=0)).sum(axis=1)
        return out

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -40, 40)))


class _Sparse:
    """A 0/1 matrix of rows of terms, for products with and without its transpose; every row and column it is asked for may be empty."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.shape = rows, columns
        row, column = row.astype(np.int32), column.astype(np.int32)
        order = np.argsort(row, kind="stable")
        self.by_row = column[order], *_starts(row[order])
        order = np.argsort(column, kind="stable")
        self.by_column = row[order], *_starts(column[order])

    def dot(self, m: np.ndarray) -> np.ndarray:
        return self._sums(m, *self.by_row, self.shape[0])

    def t_dot(self, m: np.ndarray) -> np.ndarray:
        return self._sums(m, *self.by_column, self.shape[1])

    @staticmethod
    def _sums(m: np.ndarray, of: np.ndarray, filled: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, *m.shape[1:]), np.float32)
        # some rows or columns at a time, so that what is gathered of ``m`` stays small
        edges = np.append(np.unique(np.searchsorted(begin, np.arange(0, len(of), GATHERED))), len(begin))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            a, b = begin[lo], begin[hi] if hi < len(begin) else len(of)
            if b > a:
                out[filled[lo:hi]] = np.add.reduceat(m[of[a:b]], begin[lo:hi] - a, axis=0)
        return out


def _starts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(sorted_, return_index=True)


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, seed: int = 5) -> Machine:
    """Fit on distinct hashes of each row and 0/1 labels: logistic loss, Adam, shrinkage towards 0.

    All terms of SUPPORT rows or more take part. A term whose split between the labels is no chance among so many
    terms (its rows times the Kullback-Leibler divergence of their label rate come to 0.6 of the logarithm
    of the number of terms) is shrunk weakly or not at all. Every other one is soft-thresholded at the size that its
    gradient's noise reaches among so many terms, which grows with the root of its rows; so long texts
    don't drift, and a term that matters only beside another still interacts with it once that shows above the noise. With no
    rows or one class only the model is its prior.
    """
    n = len(rows)
    prior = (labels.sum() + 0.5) / (n + 1.0)
    if not n or labels.min() == labels.max():
        return Machine(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.empty(0), np.empty((0, rank)))
    flat = np.concatenate(rows).astype(np.int64)
    at_row = np.repeat(np.arange(n), [len(r) for r in rows])
    terms, at = np.unique(flat, return_inverse=True)
    fit_ = np.bincount(at, minlength=len(terms)) >= SUPPORT
    place = np.cumsum(fit_) - 1
    use = fit_[at]
    terms, at, at_row = terms[fit_], place[at[use]], at_row[use]
    if not len(terms):
        return Machine(terms, float(np.log(prior / (1 - prior))), np.empty(0), np.empty((0, rank)))
    df = np.bincount(at, minlength=len(terms)).astype(float)
    pos = np.bincount(at, weights=labels[at_row], minlength=len(terms))
    rate = np.clip(pos / df, 1e-9, 1 - 1e-9)
    base = labels.mean()
    proof = df * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    chance = NOISE * np.sqrt(2 * np.log(len(terms) + 1) * df * base * (1 - base)) / n
    noise = np.where(proof >= 0.6 * np.log(len(terms)), np.where(proof < np.log(len(terms)), 0.1 / np.sqrt(n), 0), chance).astype(np.float32)
    x = _Sparse(at_row, at, n, len(terms))
    rng = np.random.default_rng(seed)
    p = [np.array([np.log(prior / (1 - prior))], np.float32), np.zeros(len(terms), np.float32), (rng.standard_normal((len(terms), rank)) * 0.01).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    y = labels.astype(np.float32)
    # most terms are 0 in w and v, and have no part in the sums over a row
    for t in range(1, rounds + 1):
        b, w, v = p
        both = x.dot(np.column_stack([w, (v**2).sum(axis=1), v]))
        xv = both[:, 2:]
        z = b + both[:, 0] + 0.5 * ((xv**2).sum(axis=1) - both[:, 1])
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)
        back = x.t_dot(np.column_stack([g, g[:, None] * xv]))
        gx = back[:, 0]
        grads = [np.array([g.sum()], np.float32), gx + 2e-5 * w, back[:, 1:] - gx[:, None] * v + 1e-4 * v]
        speed = 0.05 * (1 - t / (rounds + 1)) + 0.002
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            s[i] = 0.99 * s[i] + 0.01 * gr**2
            step = speed * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-6)
            less = speed * noise / (np.sqrt(s[i] / (1 - 0.99**t)).reshape(len(s[i]), -1).mean(axis=1) + 1e-6) if i else np.zeros(1, np.float32)
            less = less[:, None] if gr.ndim == 2 else less
            p[i] = p[i] - step
            p[i] = (np.sign(p[i]) * np.maximum(np.abs(p[i]) - less, 0)).astype(np.float32)
    b, w, v = p
    both = x.dot(np.column_stack([w, (v**2).sum(axis=1), v]))
    margin = b[0] + both[:, 0] + 0.5 * ((both[:, 2:] ** 2).sum(axis=1) - both[:, 1])
    scale, shift = _sharpen(margin.astype(float), labels)
    live = (w != 0) | (v != 0).any(axis=1)  # a term without weights scores as an unknown one
    return Machine(terms[live], scale * float(b[0]) + shift, scale * w[live].astype(float), np.sqrt(scale) * v[live].astype(float))


def _sharpen(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (1 or more) and shift of margins that fit the labels best: undoes what shrinkage took off them."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = q - y, q * (1 - q) + 1e-9
        grad = np.array([(r * z).sum() + (a - 1), r.sum() + b])
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = min(max(a - 0.5 * step[0], 1.0), 8.0), b - 0.5 * step[1]
    return a, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents that are not held out.

    ``labels`` (doc_id, toxic); rows with a null in either are left out, a repeated id counts as its
    greatest label, and with its least text. The sample is the ids with the least hashes, so reruns agree; their texts' hashed
    terms, not the texts, go to the driver. Inputs of the model are the texts alone.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    both = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(own), F.col("__id") == F.col("doc_id"))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts = part.column(1).to_pylist()
            terms = [sorted({bucket(x) for x in _WORD.findall((t or "").lower())}) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(terms, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    one = both.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    got = one.select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id long, toxic int, terms array<int>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit([], np.empty(0))
    terms = got.column("terms").combine_chunks()
    terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
    cuts = terms.offsets.to_numpy()
    flat = terms.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]]
    labels_ = got.column("toxic").to_numpy().astype(float)
    del got
    return fit(np.split(flat, cuts[1:-1] - cuts[0]), labels_)


def score(docs: DataFrame, model: Machine, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the score of each whole text (null: empty, which scores the bias).

    With few labels no term stands out from chance, and all texts may score the bias. Repeated rows score alike; an empty table gives no rows.
    """
    own = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*own).schema.add("score", "double")
    # a text that is kept is not sent twice
    at = keep.index("text") if "text" in keep else len(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            rows = [model.terms(t) if t else [] for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(model.scores(rows), pa.float64())], names=[*keep, "score"])

    return docs.select(*own, *[F.col("text").alias("__text")] * (at == len(keep))).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns only."""
    names = docs.columns
    inner = docs.toDF(*["text" if i == names.index("text") else f"c{i}" for i in range(len(names))])
    kept = score(inner, model, inner.columns).where(F.col("score") < threshold)
    return kept.drop("score").toDF(*names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a machine fitted on labels outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
