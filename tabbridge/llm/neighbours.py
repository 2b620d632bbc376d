"""Exact top-k by integer inner product with pivot-table elimination.

Vectors become integers, so scores are exact. With squared lengths, an inner product is
``(|q|^2 + |x|^2 - d(q, x)^2) / 2``, and by the triangle inequality the distance d is at least
the largest difference of the distances of q and x to any pivot. Each candidate therefore
has an upper bound on its score from a table of its distances to the pivots alone. A
query's candidates are taken in the order of their bounds; the search stops when the next
bound is below the k-th score so far, which is exact. Ties of scores go to the smaller
vec_id, so candidates whose bound equals the k-th score are still evaluated.

The pivots are vectors of the table, at most ``pivots`` of them (a bounded sample, they only
steer speed). Query rows are numbered and read in blocks of ``query_block``, whatever their
ids, a proven bound of what is broadcast; all rows stream past each block in Arrow batches,
every task keeps k rows per query, and a window of the tasks' winners closes the block. A last
window joins what several blocks found for one id. Of equal query rows (id and vector) k are
enough, since they all find the same rows.

Defined results: vectors that are null, or hold a null or non-finite component, take no part,
nor do rows without vec_id; vectors are compared with vectors of their own length; rows that
repeat a query's vec_id count as its own row, and other repeated rows as candidates of their
own; a query without candidates has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabbridge.llm.staging import result, scratch
from tabbridge.operators.positions import numbered

_FOUND = "query_id long, vec_id long, score long"
_ROWS = 512  # queries by candidates evaluated at once: bounded tables in memory
_SLACK = 1e-3  # far above the rounding of the bounds, far below one step of a score


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component; rows that take no part are left out."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors) of each vector length in a batch."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    return [
        (at, values[(offsets[at][:, None] + np.arange(n)[None, :])].astype(np.float64))
        for n in np.unique(lengths)
        for at in [np.flatnonzero(lengths == n)]
    ]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class _Best:
    """The k best rows of each query seen so far by one task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.pivots, self.k = ids, vectors, pivots, k
        self.table = _distances(vectors, pivots)
        self.square = (vectors * vectors).sum(1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        table, square = _distances(vectors, self.pivots), (vectors * vectors).sum(1)
        for lo in range(0, len(ids), _ROWS):
            part = slice(lo, lo + _ROWS)
            least = np.zeros((len(self.ids), len(ids[part])))
            for p in range(self.pivots.shape[0]):
                np.maximum(least, np.abs(self.table[:, p][:, None] - table[part, p][None, :]), out=least)
            bound = (self.square[:, None] + square[part][None, :] - least * least) / 2 + _SLACK
            own = self.ids[:, None] == ids[part][None, :]
            bound[own] = -np.inf
            for q in np.flatnonzero((bound >= self.scores[:, -1][:, None]).any(1)):
                self._search(q, bound[q], ids[part], vectors[part])

    def _search(self, q: int, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        able = np.flatnonzero((bound >= self.scores[q, -1]) & (bound > -np.inf))
        order = able[np.argsort(-bound[able], kind="stable")]
        step = 32
        for lo in range(0, len(order), step):
            next_ones = order[lo : lo + step]
            if bound[next_ones[0]] < self.scores[q, -1]:
                return  # no later bound is higher
            score = vectors[next_ones] @ self.vectors[q]
            scores = np.concatenate([self.scores[q], score])
            found = np.concatenate([self.found[q], ids[next_ones]])
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.found[q] = scores[best], found[best]

    def rows(self):
        real = self.scores > -np.inf
        return np.repeat(self.ids, self.k)[real.ravel()], self.found[real], self.scores[real].astype(np.int64)


def _search_block(shared, k: int):
    def by_length(rows):
        out: dict[int, list] = {}
        for row in rows:
            out.setdefault(len(row["v"]), []).append(row)
        return out

    def search(batches):
        queries, pivots = shared.value
        corner = by_length(pivots)
        states = {
            n: _Best(
                np.array([r["vec_id"] for r in rows], np.int64),
                np.array([r["v"] for r in rows], np.float64).reshape(len(rows), n),
                np.array([r["v"] for r in corner.get(n, [])], np.float64).reshape(len(corner.get(n, [])), n),
                k,
            )
            for n, rows in by_length(queries).items()
        }
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for at, vectors in _matrix(batch.column("v")):
                if vectors.shape[1] in states:
                    states[vectors.shape[1]].see(ids[at], vectors)
        for state in states.values():
            q, x, s = state.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s)], names=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = 24, query_block: int = 2048
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    with scratch(spark, "neighbours") as tables:
        rows = tables.put(integer_vectors(vectors))
        by_hash = F.xxhash64("vec_id")
        corners = rows.orderBy(by_hash, "vec_id").limit(pivots).collect()
        alike = Window.partitionBy("vec_id", "v").orderBy("vec_id")
        asked = rows.where(F.col("vec_id") % every == 0).withColumn("copy", F.row_number().over(alike))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        winners = None
        with numbered(asked.where(F.col("copy") <= k).select("vec_id", "v"), "row", 0) as queries:
            parts = max(1, -(-queries.count() // query_block))
            for n in range(parts):
                block = queries.where(F.col("row").between(n * query_block, (n + 1) * query_block - 1))
                shared = spark.sparkContext.broadcast((block.select("vec_id", "v").collect(), corners))
                found = rows.mapInArrow(_search_block(shared, k), _FOUND)
                part = tables.put(ranked(found).drop("rank"))
                shared.destroy()
                winners = part if winners is None else winners.unionByName(part)
        return result(ranked(winners).select("query_id", "rank", "vec_id", "score"), "neighbours")
