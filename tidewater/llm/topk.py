"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components are quantised to whole numbers. The index of a block of vectors has a posting segment for each dimension and impact level,
the level being the number of base-4 digits of the component's magnitude; a segment's largest impact is stored with it. A query processes
segments by descending quantised impact, which is the level of its own weight plus that of the segment. After each step the scores so
far and the sum of what is still open bound every score. A query stops on proof: when few vectors can still be among its best, these
are scored exactly. Nothing is approximated; if no proof comes, all segments are processed.

Vectors and queries are dealt into blocks, and each pair of blocks is a task's unit with bounded memory: no broadcast, no cross join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle

#: Vectors and queries of a block.
BLOCK_VECTORS = 8_192
BLOCK_QUERIES = 4_096

#: A query stops once at most so many vectors of a block can still be among its best.
FEW = 64

#: Queries that are processed together inside a block; bounds the score table.
BATCH = 256


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or has a null or non-finite component."""
    exact = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), exact.cast("array<long>"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _levels(values: np.ndarray) -> np.ndarray:
    """Quantised impact of each magnitude: its digits in base 4, 0 for zero."""
    return (np.frexp(np.abs(values).astype(np.float64))[1] + 1) // 2


class ImpactIndex:
    """The segments of a block: for each level a table of the components of that level (others 0) and each dimension's largest."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        levels = _levels(vectors)
        self.levels = [int(x) for x in np.unique(levels)[::-1] if x]
        self.segments = {x: np.where(levels == x, vectors, 0) for x in self.levels}
        self.largest = {x: np.abs(self.segments[x]).max(axis=0) for x in self.levels}

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact scores) of all vectors that can be among the k best of each query; ``own`` marks barred pairs.

        Whole numbers are exact in single precision below 2^24 and in double below 2^53; above, the tables stay 64-bit integers.
        """
        most = np.abs(queries).sum(axis=1).max(initial=0) * (np.abs(self.vectors).max(initial=0) + 1)
        kind = next((t for t, bits in ((np.float32, 24), (np.float64, 53)) if float(most) < 2.0 ** (bits - 4)), np.int64)
        segments = {x: self.segments[x].T.astype(kind) for x in self.levels}
        q, weight = queries.astype(kind), _levels(queries)
        # the most that a segment can add or take away, for each query and dimension
        reach = {x: np.abs(q) * self.largest[x] for x in self.levels}
        scores = np.zeros((len(q), len(self.vectors)), kind)
        scores[own] = -4 * most - 4  # below any other, whatever is added
        out: list = [None] * len(q)
        left = np.arange(len(q))
        few = max(FEW, 2 * k)
        top = len(self.vectors) - min(k, len(self.vectors))
        steps = sorted({int(w + x) for w in np.unique(weight) if w for x in self.levels}, reverse=True)
        for step in steps or [0]:
            for x in self.levels:
                now = np.where(weight[left] == step - x, q[left], 0)
                if now.any():
                    scores[left if len(left) < len(q) else slice(None)] += now @ segments[x]
            # a component lies in one segment, so a dimension's open part is at most the largest of its open segments
            rest = np.zeros((len(left), q.shape[1]), kind)
            for x in self.levels:
                np.maximum(rest, np.where(weight[left] + x < step, reach[x][left], 0), out=rest)
            slack = rest.sum(axis=1)
            part = scores[left] if len(left) < len(q) else scores
            # without hope if already enough of the first vectors reach the best score so far less twice the slack
            near = part[:, : 8 * few] >= (part.max(axis=1) - 2 * slack)[:, None]
            tried = np.flatnonzero((near.sum(axis=1) <= few) | (slack == 0))
            part = part[tried]
            # proof: the k-th best is at least the k-th score so far less the slack; a vector below that by another slack is out
            cut = np.partition(part, top, axis=1)[:, top] - slack[tried]
            possible = part + slack[tried, None] >= cut[:, None]
            closed = (possible.sum(axis=1) <= few) | (slack[tried] == 0)
            for i in np.flatnonzero(closed):
                at = left[tried[i]]
                rows = np.flatnonzero(possible[i] & ~own[at])
                out[at] = (rows, self.vectors[rows] @ queries[at])
            left = np.delete(left, tried[closed])
            if not len(left):
                break
        return out


def _block_best(k: int, width: int):
    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(queries) and len(vectors):
            ids = vectors["vec_id"].to_numpy(np.int64)
            index = ImpactIndex(_matrix(vectors["vector"], width))
            asked, table = queries["vec_id"].to_numpy(np.int64), _matrix(queries["vector"], width)
            for at in range(0, len(asked), BATCH):
                own = asked[at : at + BATCH, None] == ids[None, :]
                for query, (rows, scores) in zip(asked[at : at + BATCH], index.search(table[at : at + BATCH], k, own)):
                    order = np.lexsort((ids[rows], -scores))[:k]
                    found[0].extend([query] * len(order))
                    found[1].extend(ids[rows][order])
                    found[2].extend(scores[order])
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]}, dtype="int64")

    return best


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best vectors but its own, ties to the lesser vec_id.

    Both tables have vec_id (long) and vector (array of long, see :func:`quantised`); rows without either take no part. Every row of
    ``vectors`` is a candidate, those of a repeated vec_id too, but none for the query of its own vec_id; a vec_id that comes repeatedly
    among the queries asks once, with its least vector. Vectors of unequal length score over the shorter one; an empty one scores 0.
    """
    given = [t.where("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector") for t in (vectors, queries)]
    # of rows that are alike no more than k can be among the best
    copies = given[0].groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).alias("__n"))
    copies = copies.select("vec_id", "vector", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("copy"))
    clean = [settle(copies, "topk-vectors"), settle(given[1].groupBy("vec_id").agg(F.min("vector").alias("vector")), "topk-queries")]
    (n_vectors, width), (n_queries, width_q) = [t.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first() for t in clean]
    blocks_v, blocks_q = max(1, -(-n_vectors // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    # each block of the one meets each of the other: a vector travels once for every 4096 queries, a query once for every block
    dealt_v = clean[0].withColumns({"bv": F.pmod(F.xxhash64("vec_id", "vector", "copy"), F.lit(blocks_v)), "bq": F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1)))})
    dealt_q = clean[1].withColumns({"bq": F.pmod(F.xxhash64("vec_id"), F.lit(blocks_q)), "bv": F.explode(F.sequence(F.lit(0), F.lit(blocks_v - 1)))})
    pairs = dealt_q.groupBy(F.col("bq").cast("long"), F.col("bv").cast("long")).cogroup(dealt_v.groupBy(F.col("bq").cast("long"), F.col("bv").cast("long")))
    best = pairs.applyInPandas(_block_best(k, max(width, width_q)), "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
