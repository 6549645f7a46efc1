"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are cut into blocks of bounded size, and so are the queries; each pair of blocks is one group of the plan.
A block's lists are sorted once for all queries. A query reads each list from the end that its component's sign makes
best, scores what it meets by looking up whole vectors, and stops once the sum of the lists' current products can't
beat, nor equal, its kth score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import cut

#: Vectors in a block of candidates, and queries in a block of queries.
CANDIDATES, QUERIES = 8192, 4096

#: Entries that a query reads of each list before it looks at the bound for the first time; then twice as many.
DEPTH = 32

#: Components and scores are kept within +-2**62 and 64 bits; below that all sums are exact.
LARGEST = 1 << 62


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and x, floor(scale * component) as integers; without vectors that are null or hold null, NaN or infinity."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * scale))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, x).alias("x")).filter("x is not null and vec_id is not null")


class Lists:
    """A block of candidates with its per-dimension lists, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * max(vectors.shape[1], 1) < 2**53
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T  # row d: candidates by component d
        self.sorted = np.take_along_axis(self.vectors, self.order.T, 0).T

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact and float(np.abs(query).max(initial=0)) ** 2 * len(query) < 2**53:
            return self.vectors[rows] @ query  # integers of under 53 bits: doubles hold them exactly
        return (self.vectors[rows].astype(np.int64).astype(object) * query.astype(np.int64).astype(object)).sum(1)

    def top(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, without the candidates whose id is `own`."""
        used = np.flatnonzero(query)
        seen = np.zeros(len(self.ids), bool)
        seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        n, start, depth = len(self.ids), 0, DEPTH
        best: list[tuple] = []
        down = query[used] > 0
        while start < n:
            stop = min(n, start + depth)
            met = np.concatenate([self.order[used[down], n - stop : n - start].ravel(), self.order[used[~down], start:stop].ravel()]) if len(used) else np.arange(n)
            met = np.unique(met[~seen[met]])
            seen[met] = True
            scores = self.scores(met, query)
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth
                met, scores = met[keep], scores[keep]
                near = np.lexsort((met, -scores))[:k]
                met, scores = met[near], scores[near]
            best = sorted([*best, *((-int(s), int(r)) for s, r in zip(scores, met, strict=True))])[:k]
            if stop == n or not len(used):
                break
            edge = np.where(down, self.sorted[used, n - 1 - stop if stop < n else 0], self.sorted[used, min(stop, n - 1)])
            bound = sum(int(a) * int(b) for a, b in zip(edge, query[used], strict=True))
            if len(best) == k and -best[-1][0] > bound:
                break
            start, depth = stop, 2 * depth
        return [(-s, int(self.ids[r])) for s, r in best]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones with zeros behind."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if len(column):
        out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) for which is_query holds, a
    condition on vec_id, the k rows with another vec_id that have the largest inner products; fewer rows give fewer.

    Rows of several queries' ids are one query each, told apart by the id alone, and repeated rows are candidates of
    their own. Vectors of different lengths are compared as if zeros followed the shorter. Null ids take no part.
    """
    found = cut(quantized(vectors, scale).withColumn("row", F.monotonically_increasing_id()))  # equal rows spread over blocks
    queries = found.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("row", F.lit(0))
    n, m = found.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    spread = lambda count: F.pmod(F.xxhash64("vec_id", "row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = found.select("vec_id", "x", F.lit(False).alias("q"), spread(blocks).alias("block"), every(query_blocks).alias("query_block"))
    asked = queries.select("vec_id", "x", F.lit(True).alias("q"), every(blocks).alias("block"), spread(query_blocks).alias("query_block"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = group["x"].combine_chunks()
        q, ids = group["q"].to_numpy(), group["vec_id"].to_numpy()
        all_x = _matrix(x, int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
        lists = Lists(ids[~q], all_x[~q])
        made = [(int(i), v, s) for i, row in zip(ids[q], all_x[q], strict=True) for s, v in lists.top(row, k, int(i))]
        made = [(i, v, max(-(1 << 63), min((1 << 63) - 1, s))) for i, v, s in made]
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    each = rows.unionByName(asked).groupBy("block", "query_block").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
