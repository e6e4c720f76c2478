"""Exact top-k by inner product with no-random-access aggregation over sorted component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stage

#: Queries and candidates that one task holds at a time.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Pieces that a list is read in once stops are possible, and rows for each of the k that are resolved at a stop.
PIECES, RESOLVED = 4, 8


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v the components floor(scale * x) as doubles.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"),
    )


class Lists:
    """The rows of a block as sorted lists, one a component, made once for all queries."""

    def __init__(self, rows: np.ndarray):
        self.n, self.dims = rows.shape
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.rank = np.empty((self.n, self.dims), np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.columns = np.ascontiguousarray(rows.T)
        self.least, self.most = rows.min(axis=0, initial=0 if not self.n else None), rows.max(axis=0, initial=0 if not self.n else None)
        self.spread = rows.std(axis=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, int]:
        """(rows that may be among the k best, entries read): the k best and at most ``RESOLVED * k`` others, or ties at the end.

        Lists are read in the order of the query's weight times their spread, each downwards where the weight is
        positive and upwards where it is negative. What a row has shown, with the far ends of the lists not yet read,
        is its lower bound; with their near ends and the frontier of the one being read, its upper bound. Rows whose
        upper bound is below the k-th lower bound are outsiders. While what is unread could outweigh all
        differences seen, none can be, and bounds need no look.
        """
        near, far = np.where(query > 0, self.most, self.least) * query, np.where(query > 0, self.least, self.most) * query
        lists = np.argsort(-np.abs(query) * self.spread, kind="stable")
        span = np.cumsum((near - far)[lists])
        # before what is unread could be outweighed by all that is read: these lists are read at once
        first = int(np.searchsorted(2 * span, span[-1])) if len(lists) else 0
        live = np.flatnonzero(np.arange(self.n) != own)
        seen = (query[lists[:first]] @ self.columns[lists[:first]])[live]
        above, below, read = near[lists[first:]].sum(), far[lists[first:]].sum(), first * self.n
        for j in lists[first:]:
            if len(live) <= RESOLVED * k:
                break
            above, below = above - near[j], below - far[j]
            value = query[j] * self.columns[j][live]
            before, seen = seen, seen + value
            read += self.n
            if above - below >= seen.max() - seen.min():
                continue
            kept = seen + above >= np.partition(seen, len(seen) - k)[len(seen) - k] + below
            if np.count_nonzero(kept) <= RESOLVED * k:
                return self.sooner(query, j, live, before, value, (above, below, far[j]), k) or (live[kept], read)
            live, seen = live[kept], seen[kept]
        return live, read

    def sooner(self, query, j, live, before, value, unread, k) -> tuple[np.ndarray, int] | None:
        """The stop within the last list, if a part of it suffices: rows not met yet are bounded by the frontier."""
        place, (above, below, far) = self.rank[live, j], unread
        whole = (np.flatnonzero(np.argsort(-np.abs(query) * self.spread, kind="stable") == j)[0]) * self.n
        for piece in range(1, PIECES):
            depth = -(-self.n * piece // PIECES)
            at = self.order[self.n - depth, j] if query[j] > 0 else self.order[depth - 1, j]
            known = place >= self.n - depth if query[j] > 0 else place < depth
            low = before + np.where(known, value, far) + below
            kept = before + np.where(known, value, query[j] * self.rows[at, j]) + above >= np.partition(low, len(low) - k)[len(low) - k]
            if np.count_nonzero(kept) <= RESOLVED * k:
                return live[kept], int(whole + depth)
        return None


def nra(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """The k best (score, then smaller id) of ``rows`` for each query: (query, row, score) arrays, and the list entries read.

    ``own`` is the place of each query's own row among the rows, -1 where it isn't there. Scores are
    exact: sums in doubles where no sum reaches 2**53, else in longs; beyond these it is an error.
    """
    reach = float((np.abs(rows).max(axis=0, initial=0) * np.abs(queries).max(axis=0, initial=0)).sum())  # of scores and of bounds
    if reach >= 2**63:
        raise ValueError("scores don't fit a long")
    kind = np.float64 if reach < 2**52 else np.int64
    lists, queries = Lists(rows.astype(kind)), queries.astype(kind)
    found, entries = [], 0
    for i, (query, at) in enumerate(zip(queries, own, strict=True)):
        near, read = lists.search(query, at, k)
        score = lists.rows[near] @ query
        best = np.lexsort((ids[near], -score))[:k]
        found.append((np.full(len(best), i), near[best], score[best].astype(np.int64)))
        entries += read
    return *(np.concatenate(x) if found else np.empty(0, int) for x in (zip(*found, strict=True) if found else [()] * 3)), entries


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Both have (row, vec_id, v); ``row`` tells rows apart, and a query's own row is no candidate of it. v is
    of equal lengths within a search; rows of other lengths than a query's are no candidates. Queries
    and rows are dealt to blocks by hash; each pair of blocks is one group, so a task holds
    QUERY_BLOCK + ROW_BLOCK vectors whatever the table's size, and hands on at most k rows a query.
    Ties go to the smaller id. Repeated ids stay separate queries and candidates. Fewer rows than k give all of them; an empty
    table gives none. Returns (query_id, rank from 1, vec_id, score).
    """
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    r_blocks = max(1, -(-vectors.count() // ROW_BLOCK))

    def dealt(df: DataFrame, blocks: int, others: int, kind: int) -> DataFrame:
        own = F.pmod(F.xxhash64("row", F.lit(kind)), F.lit(blocks)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        df = df.select("row", "vec_id", "v", own.alias("own"), other.alias("other"), F.size("v").alias("dims"))
        pair = ("own", "other") if kind else ("other", "own")
        return df.select(F.col(pair[0]).alias("qb"), F.col(pair[1]).alias("rb"), "dims", F.lit(kind).alias("kind"), "row", "vec_id", "v")

    both = dealt(queries, q_blocks, r_blocks, 1).unionByName(dealt(vectors, r_blocks, q_blocks, 0))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        q, r = part[part.kind == 1], part[part.kind == 0]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        place = pd.Series(np.arange(len(r)), index=r.row.to_numpy()).reindex(q.row.to_numpy()).fillna(-1).astype(int).to_numpy()
        ids, asked, named = r.vec_id.to_numpy(), q.row.to_numpy(), q.vec_id.to_numpy()
        a, b, score, _ = nra(np.stack(r.v.to_numpy()), ids, np.stack(q.v.to_numpy()), place, k)
        return pd.DataFrame({"query_row": asked[a], "query_id": named[a], "vec_id": ids[b], "score": score})

    near = both.groupBy("qb", "rb", "dims").applyInPandas(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows by integer inner product for every vector whose id is divisible by 50."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    vectors = stage(vectors.withColumn("row", F.monotonically_increasing_id()))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


SQL = """
WITH q AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.own <> b.own AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
