"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates lie in blocks. A block is stored, once for all queries, as one list per
dimension: its rows ordered by their component of that dimension. All lists are read in their order
from both ends to one depth, in the steps of ``STEPS``. An entry not read yet lies between
the last ones read from the two ends, which gives each candidate a lower and an upper score. Candidates whose
upper bound is below the k-th best lower bound (or below the k-th best score known from
elsewhere) can no longer qualify and are dropped. A query stops reading a block when no more than k
are left; their scores are resolved by taking only their unread entries out of the rest of the
lists. Ties at the k-th place leave more than k; lists read to the end settle these, since
both bounds have met there. Nothing is fetched by row: every component comes out of a list in its order.

The k-th best scores are carried from block to block within a task and, since a wave first
reads one block in ``FIRST_SHARE``, from these to all others.

Queries are dealt in waves, one after the other, of a counted number of rows and bytes; a wave
is what is broadcast. Blocks are read where they lie, so candidates are never shuffled;
only the rows that reach a query's k-th best score in a task are.

Cases: null vectors and vectors with null or non-finite components take no part.
Vectors are compared with vectors of their own length only; empty vectors score 0
with each other. Rows that repeat an id count as rows of their own; a query id that
occurs at several rows is one query, with the least of its vectors. Ties go to the smaller
id. Empty tables give an empty result; other columns are ignored. Where float64 cannot
prove a sum exact, the bounds are widened by its error and the last scores are summed in
integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Bounds on what a wave broadcasts.
WAVE_QUERIES, WAVE_BYTES = 4096, 32 << 20
BLOCK_ROWS = 2048
#: Shares of a list that are read when bounds are compared.
STEPS = (1 / 64, 1 / 8, 1 / 2, 3 / 4, 13 / 16, 7 / 8, 29 / 32, 15 / 16, 31 / 32, 1)
#: Candidates are bounded one by one once less than this share of them is left.
FEW = 1 / 8
#: Candidates bounded at once then.
_CHUNK = 1 << 14
#: One block in so many is read first, to carry its scores to the others.
FIRST_SHARE = 16
_BLOCK_SCHEMA = "block long, n int, ids binary, ordered binary, sorted binary"


def quantized(vector: Column) -> Column:
    """floor(256 x) of every component as long; null where the vector takes no part."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * 256.0))
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), x)


class BlockLists:
    """The sorted lists of one block: ``order[i]`` are its rows by falling component i,
    ``values[i]`` the components in that order."""

    def __init__(self, ids: np.ndarray, order: np.ndarray, values: np.ndarray):
        self.ids, self.order, self.values = ids, order, values

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> BlockLists:
        columns = np.ascontiguousarray(x.T)
        order = np.argsort(-columns, axis=1, kind="stable")
        return cls(ids, order.astype(np.uint16), np.take_along_axis(columns, order, axis=1))


class Reader:
    """Sequential reading of a block's lists, all to one depth, from both ends."""

    def __init__(self, block: BlockLists):
        self.block, self.depth = block, 0
        dims, self.n = block.order.shape
        self._row = np.arange(dims)[:, None]
        self.x, self.unread = np.zeros((dims, self.n)), np.ones((dims, self.n))

    @property
    def ended(self) -> bool:
        return 2 * self.depth >= self.n

    def read(self, depth: int) -> None:
        """Read on to ``depth`` entries from either end of every list."""
        for part in (slice(self.depth, depth), slice(max(self.n - depth, 0), self.n - self.depth)):
            at = self.block.order[:, part].astype(np.int64)
            self.x[self._row, at] = self.block.values[:, part]
            self.unread[self._row, at] = 0
        self.depth = depth

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the least value that an unread entry of each list can have."""
        last = max(self.depth - 1, 0)
        return self.block.values[:, last].astype(np.float64), self.block.values[:, self.n - 1 - last].astype(np.float64)

    def bounds(self, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper scores (queries x candidates) of the halves of queries by sign."""
        known = (positive + negative) @ self.x
        if self.ended:
            return known, known
        most, least = self._ends()
        return known + (positive * least + negative * most) @ self.unread, known + (positive * most + negative * least) @ self.unread

    def pair_bounds(self, positive: np.ndarray, negative: np.ndarray, query: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper scores of the pairs (query, candidate)."""
        most, least = self._ends()
        lower, upper = np.empty(len(query)), np.empty(len(query))
        low, high = positive * least + negative * most, positive * most + negative * least
        for a in range(0, len(query), _CHUNK):
            q, c = query[a : a + _CHUNK], candidate[a : a + _CHUNK]
            x, unread = self.x.T[c], self.unread.T[c]
            known = np.einsum("ij,ij->i", (positive + negative)[q], x)
            lower[a : a + _CHUNK] = known + np.einsum("ij,ij->i", low[q], unread)
            upper[a : a + _CHUNK] = known + np.einsum("ij,ij->i", high[q], unread)
        return lower, upper

    def resolve(self, which: np.ndarray) -> None:
        """Take the unread entries of the candidates ``which`` out of the rest of the lists."""
        wanted = np.zeros(self.n, dtype=bool)
        wanted[which] = True
        rest = slice(self.depth, max(self.n - self.depth, self.depth))
        order, values = self.block.order[:, rest], self.block.values[:, rest]
        i, at = np.nonzero(wanted[order])
        self.x[i, order[i, at]], self.unread[i, order[i, at]] = values[i, at], 0


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


class TopK:
    """Running k best (score, id) of each query, and its score to beat."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        x = q.astype(np.float64)
        self.positive, self.negative = np.maximum(x, 0), np.minimum(x, 0)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        #: Blocks read for a query, and those of them not read to the end of the lists.
        self.reads = self.stopped = 0

    def read(self, block: BlockLists) -> None:
        """Read a block for all queries, each as deep as it needs."""
        n, k = len(block.ids), self.k
        weight = np.abs(self.q).astype(np.float64).max(axis=1, initial=0) if self.q.size else np.zeros(len(self.ids))
        largest = float(np.abs(block.values).astype(np.float64).max(initial=0)) * max(self.q.shape[1], 1)
        # Sums of whole numbers below 2^53 are exact in float64; beyond, this bounds their error.
        error = np.where(weight * largest < 2**53, 0.0, weight * largest * max(self.q.shape[1], 1) * 2.0**-50)
        reader, rows = Reader(block), np.arange(len(self.ids))
        self.reads += len(rows)
        # The candidates left, as pairs (row, candidate) sorted by row; at first all of all rows.
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for depth in sorted({max(1, math.ceil(n * share / 2)) for share in STEPS}):
            if not len(rows):
                return
            reader.read(depth)
            if pairs is None:
                lower, upper = reader.bounds(self.positive[rows], self.negative[rows])
                own = block.ids[None, :] == self.ids[rows][:, None]
                floor = self.floor[rows]
                if n > k:
                    floor = np.maximum(floor, _kth(np.where(own, -np.inf, lower), k) - error[rows])
                alive = (upper + error[rows][:, None] >= floor[:, None]) & ~own
                left = alive.sum(axis=1)
                stays = (left > k) & (not reader.ended)
                if left[stays].sum() > FEW * n * len(rows):
                    # Too many to list; only what is settled is.
                    alive[stays] = False
                query, candidate = np.nonzero(alive)
                query = rows[query]
            else:
                query, candidate = pairs
                lower, upper = reader.pair_bounds(self.positive, self.negative, query, candidate)
                by_score = np.lexsort((-lower, query))
                start = np.searchsorted(query, rows)
                # Every row has more than k pairs here, or it would have stopped.
                floor = self.floor.copy()
                floor[rows] = np.maximum(floor[rows], lower[by_score[start + k - 1]] - error[rows])
                alive = upper + error[query] >= floor[query]
                query, candidate = query[alive], candidate[alive]
                left = np.bincount(query, minlength=len(self.ids))[rows]
                stays = (left > k) & (not reader.ended)
            done, rows = rows[~stays], rows[stays]
            self._finish(reader, done, query, candidate, error)
            if not reader.ended:
                self.stopped += len(done)
            on = np.isin(query, rows)
            if on.any():
                pairs = query[on], candidate[on]

    def _finish(self, reader: Reader, rows: np.ndarray, query: np.ndarray, candidate: np.ndarray, error: np.ndarray) -> None:
        """Offer the resolved scores of all that is left of ``rows``; ``query`` is sorted."""
        ends = np.stack([np.searchsorted(query, rows), np.searchsorted(query, rows, side="right")], axis=1)
        kept = [(row, candidate[a:b]) for row, (a, b) in zip(rows.tolist(), ends.tolist()) if b > a]
        if kept and not reader.ended:
            reader.resolve(np.concatenate([at for _, at in kept]))
        for row, at in kept:
            scores = self._whole(row, reader.block, at) if error[row] else self.q[row].astype(np.float64) @ reader.x[:, at]
            self._offer(row, scores, reader.block.ids[at])

    def _whole(self, row: int, block: BlockLists, at: np.ndarray) -> list[int]:
        """Scores in integers, the lists read to their ends for the rows ``at``."""
        place = {c: i for i, c in enumerate(at.tolist())}
        scores = [0] * len(at)
        for q, order, values in zip(self.q[row].tolist(), block.order, block.values):
            keep = np.isin(order, at)
            for c, v in zip(order[keep].tolist(), values[keep].tolist()):
                scores[place[c]] += q * v
        return scores

    def _offer(self, row: int, scores, ids: np.ndarray) -> None:
        if len(ids) > self.k and isinstance(scores, np.ndarray):
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        best = self.best[row] + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        best.sort()
        self.best[row] = best[: self.k]
        if len(best) >= self.k:
            self.floor[row] = max(self.floor[row], -self.best[row][-1][0])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (vec_id, x) to blocks of lists; a task holds a few blocks of rows at most."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def block(n: int) -> tuple:
        ids, x = held.pop(n)
        lists = BlockLists.of(np.array(ids, dtype=np.int64), np.array(x, dtype=np.int64).reshape(len(ids), n))
        # Named by what it holds, so a block made again has the same name.
        return (int(lists.ids.min()), n, lists.ids.tobytes(), lists.order.tobytes(), lists.values.tobytes())

    for pdf in batches:
        out = []
        for i, x in zip(pdf["vec_id"].tolist(), pdf["x"]):
            ids, rows = held.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(x)
            if len(ids) == BLOCK_ROWS:
                out.append(block(len(x)))
        while sum(len(ids) for ids, _ in held.values()) > 4 * BLOCK_ROWS:
            out.append(block(max(held, key=lambda n: len(held[n][0]))))
        yield pd.DataFrame(out, columns=["block", "n", "ids", "ordered", "sorted"])
    yield pd.DataFrame([block(n) for n in list(held)], columns=["block", "n", "ids", "ordered", "sorted"])


def sorted_lists(rows: DataFrame) -> DataFrame:
    """The blocks of candidates (vec_id, x) with their sorted lists, written once."""
    return materialize(rows.mapInPandas(_blocks, _BLOCK_SCHEMA), "lists")


def _wave(blocks: DataFrame, queries: pd.DataFrame, floors: dict[int, int], k: int, spark) -> DataFrame:
    """(query_id, vec_id, score) of what can be among the k best, from each task."""
    by_length = {}
    for n, g in queries.groupby(queries["x"].map(len)):
        ids = g["vec_id"].to_numpy(np.int64)
        by_length[n] = (ids, _matrix(g["x"]), np.array([floors.get(i, -np.inf) for i in ids.tolist()], dtype=np.float64))
    shared = spark.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, TopK] = {}
        for pdf in batches:
            for n, ids, order, values in zip(pdf["n"].tolist(), pdf["ids"], pdf["ordered"], pdf["sorted"]):
                if n not in shared.value:
                    continue
                if n not in best:
                    best[n] = TopK(*shared.value[n][:2], k, shared.value[n][2].copy())
                of = np.frombuffer(ids, dtype=np.int64)
                best[n].read(BlockLists(of, np.frombuffer(order, dtype=np.uint16).reshape(n, len(of)), np.frombuffer(values, dtype=np.int64).reshape(n, len(of))))
        for found in best.values():
            out = [(int(q), i, -s) for q, rows in zip(found.ids, found.best) for s, i in rows]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return blocks.mapInPandas(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", wave_queries: int = WAVE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row where ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(vector)).alias("x"), is_query.alias("is_query")).filter("x is not null and vec_id is not null")
    blocks = sorted_lists(rows.select("vec_id", "x"))
    queries = materialize(rows.filter("is_query").groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    waves = 1
    while True:
        # Counted, so that what is broadcast is bounded and not just expected to be.
        load = queries.groupBy(F.pmod(slot, F.lit(waves))).agg(F.count("*").alias("n"), F.sum(8 * F.size("x")).alias("size"))
        if load.filter(f"n > {wave_queries} or size > {WAVE_BYTES} and n > 1").isEmpty():
            break
        waves *= 2
    first = F.pmod(F.xxhash64("block"), F.lit(FIRST_SHARE)) == 0
    parts = []
    for wave in range(waves):
        mine = queries.filter(F.pmod(slot, F.lit(waves)) == wave).toPandas()
        if len(mine) or wave == 0:
            begun = materialize(_ranked(_wave(blocks.filter(first), mine, {}, k, spark), k), "begun")
            floors = {r["query_id"]: r["score"] for r in begun.filter(F.col("rank") == k).collect()}
            rest = _wave(blocks.filter(~first), mine, floors, k, spark)
            parts.append(materialize(_ranked(begun.drop("rank").unionByName(rest), k), "wave"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found
