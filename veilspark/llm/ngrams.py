"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import components, row_key, slices, stage, text_key, unstage

#: Words of an n-gram, least similarity, recall wanted at it, hash functions at most.
WORDS, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.9999, 192
#: Documents and n-grams of one block of a candidate group; n-grams of one task of small groups.
BLOCK_DOCS, BLOCK_GRAMS, TASK_GRAMS = 512, 1 << 19, 1 << 18

_WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and then the fewest bands, that reach ``recall`` at ``similarity``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of lower-cased words; one of all words if it has fewer."""
    import xxhash

    if not text:
        return np.empty(0, np.uint64)
    if len(_CACHE) > 200_000:
        _CACHE.clear()
    ids = []
    get = _CACHE.get
    for w in _WORD.findall(text.lower()):
        h = get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids.append(h)
    if not ids:
        return np.empty(0, np.uint64)
    h = np.array(ids, np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_hashes(sets: np.ndarray, bands: int, rows: int, seed: int = 3) -> np.ndarray:
    """The band hashes of a non-empty set of n-gram hashes."""
    rng = np.random.default_rng(seed)
    k = bands * rows
    a = rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    mix = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
    return _bands(sets, a, b, mix)


def _bands(sets: np.ndarray, a: np.ndarray, b: np.ndarray, mix: np.ndarray) -> np.ndarray:
    h = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048, None] * a + b).min(axis=0), out=low)
    out = (low.astype(np.uint64).reshape(mix.shape) * mix).sum(axis=1) + np.arange(len(mix), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """One staged row a distinct text: id, key, copies, least doc_id, number of n-grams, band hashes.

    Null and empty texts have no row. ``docs`` has (doc_id, text).
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(3)
        k = bands * rows
        a = rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        mix = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        for part in slices(parts):
            sets = [grams(t, n) for t in part.column(2).to_pylist()]
            got = [_bands(s, a, b, mix) if len(s) else np.empty(0, np.int64) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
            flat = pa.array(np.concatenate(got) if got else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["key", "doc_id", "n", "bands"],
            )

    rows_ = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = rows_.mapInArrow(run, "key binary, doc_id long, n long, bands array<long>")
    one = signed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    return stage(one.withColumn("id", F.monotonically_increasing_id()))


def _candidates(signed: DataFrame) -> DataFrame:
    """(node, root): groups of texts chained by equal band hashes; texts that share none are left out.

    Within a bucket each text is tied to the bucket's least only, so a bucket gives rows in
    proportion to its size, not to its square; the join on the bucket can be split where it is hot.
    """
    rows = signed.select("id", F.explode("bands").alias("h"))
    buckets = rows.groupBy("h").agg(F.min("id").alias("root"), F.count("*").alias("m")).where(F.col("m") > 1).select("h", "root")
    ties = rows.join(buckets, "h").where(F.col("id") != F.col("root")).select(F.col("id").alias("a"), F.col("root").alias("b"))
    return components(ties)


def _linked(sets: list[np.ndarray], similarity: float, split: int | None) -> np.ndarray:
    """Matrix of the pairs at ``similarity`` or more; with ``split``, of first rows by the other columns only."""
    size = np.array([len(s) for s in sets], float)
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    live = [i for i in range(n) if len(sets[i])]
    if live:
        flat, at = np.concatenate([sets[i] for i in live]), np.repeat(live, [len(sets[i]) for i in live])
        _, col, many = np.unique(flat, return_inverse=True, return_counts=True)
        shared = many > 1
        order = np.argsort(col, kind="stable")
        order = order[shared[col[order]]]
        rank = np.cumsum(shared) - 1
        col, at = rank[col[order]], at[order]
        width = max(64, (1 << 22) // n)
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(col, [lo, lo + width])
            x = np.zeros((n, width), np.float32)
            x[at[a:b], col[a:b] - lo] = 1
            if split is None:
                out += x @ x.T
            else:
                out[:split, split:] += x[:split] @ x[split:].T
    both = size[:, None] + size[None, :] - out
    link = (out >= similarity * both - 1e-9) & (out > 0)
    np.fill_diagonal(link, False)
    return link if split is None else link[:split, split:]


def _labels(link: np.ndarray, split: int | None) -> np.ndarray:
    """Least reachable index for each index."""
    n = len(link) if split is None else sum(link.shape)
    label = np.arange(n)
    i, j = np.nonzero(link)
    if split is not None:
        j = j + split
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def classes(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(key, id, doc_id, copies, root, links, texts): one row a distinct text with its class and links.

    ``root`` names the class (texts chained by links); ``links`` counts the other documents at
    ``similarity`` or more, copies included. Bands and rows are chosen for ``recall`` at exactly that
    similarity; groups that bands suggest are then compared pair by pair on full n-gram sets, so no link
    inside a group is lost and none is wrong. A large group is cut into blocks of at most about BLOCK_DOCS
    texts and BLOCK_GRAMS n-grams, and each pair of blocks is one task that hands on one row a text:
    pairs are never emitted.
    """
    signed = signatures(docs, n, *banding(similarity, recall))
    near = _candidates(signed).withColumnRenamed("node", "id").withColumnRenamed("root", "cand")
    near = stage(signed.drop("bands").join(near, "id"))
    sizes = near.groupBy("cand").agg(F.count("*").alias("m"), F.sum("n").alias("g"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    sizes = stage(sizes.select("cand", blocks.alias("blocks"), "g"))
    tasks = max(1, math.ceil((sizes.where("blocks = 1").agg(F.sum("g")).first()[0] or 0) / TASK_GRAMS))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = near.join(sizes.drop("g"), "cand").select("key", "doc_id", "id", "copies", "cand", "blocks", own.alias("own"), other.alias("other"))
    big = F.col("blocks") > 1
    dealt = dealt.select(
        "key", F.col("doc_id").alias("least"), "id", "copies", "cand", "own",
        F.when(big, F.col("cand")).otherwise(F.pmod(F.xxhash64("cand"), F.lit(tasks))).alias("task"),
        F.when(big, F.least("own", "other")).otherwise(-1).alias("lo"), F.when(big, F.greatest("own", "other")).otherwise(-1).alias("hi"),
    )
    texts = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(dealt, "key").where(F.col("doc_id").eqNullSafe(F.col("least"))).drop("key", "doc_id", "least")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("id")
        crossed = part.lo.iat[0] != part.hi.iat[0]
        found = []
        for _, group in part.sort_values(["cand", "own", "id"]).groupby("cand", sort=False):
            ids, weight = group.id.to_numpy(), group.copies.to_numpy()
            split = int((group.own == part.lo.iat[0]).sum()) if crossed else None
            link = _linked([grams(t, n) for t in group.text], similarity, split)
            label = _labels(link, split)
            if split is None:
                links = link @ weight
            else:
                links = np.concatenate([link @ weight[split:], weight[:split] @ link])
            found.append(pd.DataFrame({"id": ids, "root": ids[label], "links": links.astype("int64"), "big": bool(part.lo.iat[0] >= 0)}))
        return pd.concat(found)

    seen = stage(rows.groupBy("task", "lo", "hi").applyInPandas(compare, "id long, root long, links long, big boolean"))
    over = components(seen.where("big").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "id", "root": "over"})
    links = seen.groupBy("id").agg(F.min("root").alias("low"), F.sum("links").alias("links")).join(over, "id", "left")
    links = links.select("id", F.coalesce("over", "low").alias("root"), "links")
    found = stage(signed.drop("bands").join(links, "id", "left").select(
        "key", "id", "doc_id", "copies", F.coalesce("root", "id").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
    ))
    unstage(signed, near, sizes, seen)
    return found


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links) for each row of ``docs`` (doc_id, text).

    ``class_id`` is the least doc_id of the class. Null and empty texts are alone: their own doc_id, no
    links. Texts without words link to equal texts only. Repeated rows count as copies. A null doc_id
    gives a null class_id only if its whole class has null ids.
    """
    found = classes(docs, **options)
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    place = found.join(least, "root").select("key", "class_id", "links")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce(F.col("text") == "", F.lit(True)).alias("none"))
    return rows.join(place, "key", "left").select(
        "doc_id", F.when(F.col("none"), F.col("doc_id")).otherwise(F.col("class_id")).cast("long").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one of each class: the least doc_id's (then the least text key's). Null and empty texts all stay."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    found = classes(inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("f"))
    kept = found.join(first, "root").where(F.col("id") == F.col("f.id")).select(F.col("key").alias("__key"), F.col("doc_id").alias("__least"))
    keyed = inner.withColumn("__key", text_key(F.col(text)))
    empty = F.coalesce(F.col(text) == "", F.lit(True))
    some = keyed.where(~empty).join(kept, "__key").where(F.col(doc_id).eqNullSafe(F.col("__least")))
    # rows equal in id and text may differ elsewhere: the one of the least digest stays
    one = some.withColumn("__row", row_key(inner.columns)).groupBy("__key").agg(F.min_by(F.struct(*inner.columns), "__row").alias("r"))
    return one.select("r.*").unionByName(inner.where(empty)).toDF(*names)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word n-grams, Jaccard similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs.select("doc_id", "text"))
