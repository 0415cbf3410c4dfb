"""Lloyd's k-means in exact integers, by exponion search (Newling and Fleuret).

Every vector carries its cluster, an upper bound on the distance to that cluster's centroid and a
lower bound on the distance to every other one. After the centroids have moved, both bounds give
way by how far. A vector whose upper bound is below its lower bound, or below half the
distance from its centroid to the next one, keeps its cluster unseen. Of the rest, the
upper bound is made exact, and only centroids in the ball around its current centroid are
compared, of radius twice the upper bound plus the distance to the nearest other centroid:
a prefix of that centroid's list of the others, sorted by distance. The nearest and the second
nearest centroid both lie in that ball, its edge included, so ties are seen.

Distances are squared sums of integers and exact; only bounds are floating-point, widened by
``SLACK``, far above their rounding errors. Scans go to the smaller number among equals.

A round reads and writes the vectors once with their bounds; nothing is shuffled but one row of
sums per task and cluster, of the vectors that changed cluster. The centroids, k rows, are what
each task is given. Every round is a written table, so a lost executor costs its own tasks.

Cases: null vectors, vectors of another length and vectors with null or non-finite components
take no part. Rows without an id are clustered but seed a centroid only if there are fewer
than k others. Repeated rows count as rows of their own, and may seed equal centroids, of which
the smaller number takes all. With fewer than k vectors there are as many centroids as vectors. Equal
distances go to the smaller number, equal seed hashes to the smaller id and vector. An empty cluster keeps its
centroid. Empty tables give an empty result; other columns are ignored. A component that, scaled, leaves the range in
which squared distances fit a long (2^27 at 64 components) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark, materialize, release

#: Bounds are widened by this share, thousands of times the rounding error of a round.
SLACK = 1e-12
_STATE = "vec_id long, x array<int>, cluster int, before int, upper double, lower double, distance long"


def component_limit(dims: int) -> int:
    """Components below this, in size, have squared distances that fit a long."""
    return 1 << ((62 - max(dims - 1, 0).bit_length()) // 2 - 1)


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that take part."""
    v = F.col(f"`{vector}`")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    scaled = F.transform(v, lambda c: c.cast("double") * float(scale))
    kept = rows.filter(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, bad)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), scaled.alias("s"))
    limit = component_limit(dims)
    floor = F.transform("s", lambda c: F.floor(c).cast("int"))
    return kept.select("vec_id", F.when(F.exists("s", lambda c: F.abs(c) >= limit), F.raise_error(F.lit(f"a component leaves the range of {limit}"))).otherwise(floor).alias("x"))


def _norms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exact."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


class Search:
    """What a task needs to know of the centroids: how far each has moved, and for each the
    others sorted by their distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids, self.first = centroids, before is None
        between = np.sqrt(np.array([_norms(centroids, c) for c in centroids], dtype=np.float64).reshape(k, k)) * (1 - SLACK)
        np.fill_diagonal(between, 0.0)
        self.order = np.argsort(between, axis=1, kind="stable")
        # The centroid itself leads its list, also where another one equals it.
        for j in range(k):
            self.order[j] = np.concatenate([[j], self.order[j][self.order[j] != j]])
        self.reach = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.reach[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(_norms(centroids, before).astype(np.float64)) * (1 + SLACK)
        ranked = np.sort(self.moved)[::-1]
        most, next_most = (ranked[0], ranked[1]) if k > 1 else (0.0, 0.0)
        # How far any other centroid has moved.
        self.others = np.where(self.moved == most, next_most if (self.moved == most).sum() == 1 else most, most)
        self.scanned = 0

    def scan(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, its squared distance and the second smallest one, over the first
        ``lists`` entries of each row's list."""
        n = len(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        second = best.copy()
        for t in range(int(lists.max(initial=0))):
            rows = np.nonzero(lists > t)[0]
            c = self.order[home[rows], t]
            d = _norms(x[rows], self.centroids[c])
            self.scanned += len(rows)
            won = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            second[rows] = np.where(won, best[rows], np.minimum(second[rows], d))
            best[rows], number[rows] = np.where(won, d, best[rows]), np.where(won, c, number[rows])
        return number, best, second

    def assign(self, x: np.ndarray, home: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New clusters and bounds of rows with integer components."""
        top = np.iinfo(np.int64).max
        root = lambda d: np.where(d == top, np.inf, np.sqrt(d.astype(np.float64)))
        if self.first:
            number, best, second = self.scan(x, np.zeros(len(x), dtype=np.int64), np.full(len(x), len(self.centroids)))
            return number, root(best) * (1 + SLACK), root(second) * (1 - SLACK)
        upper = (upper + self.moved[home]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[home], 0.0) * (1 - SLACK)
        home = home.copy()
        safe = np.maximum(self.nearest[home] / 2, lower)
        rows = np.nonzero(upper >= safe)[0]
        upper[rows] = root(_norms(x[rows], self.centroids[home[rows]])) * (1 + SLACK)
        rows = rows[upper[rows] >= safe[rows]]
        radius = (2 * upper[rows] + self.nearest[home[rows]]) * (1 + SLACK)
        # Entries of the list up to the radius, those at it included.
        lists = (self.reach[home[rows]] <= radius[:, None]).sum(axis=1)
        home[rows], best, second = self.scan(x[rows], home[rows], lists)
        upper[rows], lower[rows] = root(best) * (1 + SLACK), root(second) * (1 - SLACK)
        return home, upper, lower


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            home, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            number, upper, lower = search.assign(x, home.astype(np.int64), upper.copy(), lower.copy())
            columns = [batch.column("vec_id"), batch.column("x"), pa.array(number, pa.int32()), pa.array(home, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_norms(x, centroids[number]))], ["vec_id", "x", "cluster", "before", "upper", "lower", "distance"])

    return state.mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much every cluster's sums and counts change, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k + 1, dims), dtype=object), np.zeros(k + 1, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for name, sign in (("cluster", 1), ("before", -1)):
                at = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                part = np.zeros((k + 1, dims), dtype=np.int64)
                np.add.at(part, at, x)
                sums += sign * part.astype(object)
                counts += sign * np.bincount(at % (k + 1), minlength=k + 1)
        rows = [(i, int(counts[i]), [str(v) for v in sums[i]]) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.string())))], ["cluster", "n", "sums"])

    # A row that was in no cluster yet has -1 before, the spare row at the end.
    moved = state.filter("cluster <> before").select("x", "cluster", "before").mapInArrow(run, "cluster int, n long, sums array<string>")
    each = moved.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums, counts = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    for r in each.collect():  # k times as many rows as there are components
        sums[r["cluster"], r["at"]], counts[r["cluster"]] = int(r["s"]), int(r["n"])
    return sums, counts


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(members, centroids): (vec_id, x, cluster, distance) of every vector that takes part, and
    the final centroids. Seeds are the k vectors least by hash of ``<seed>:<vec_id>``."""
    if k < 1 or rounds < 0 or dims < 1:
        raise ValueError("k and dims must be at least 1 and rounds at least 0")
    spark, since = rows.sparkSession, mark()
    start = integer_vectors(rows, vec_id, vector, dims, scale)
    unset = {"cluster": F.lit(-1), "before": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0), "distance": F.lit(0).cast("long")}
    state = materialize(start.withColumns(unset), "vectors")
    seeds = state.select("vec_id", "x", seed_order(F.col("vec_id"), seed).alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec_id", "x").limit(k).collect()
    if not seeds:
        return state.select("vec_id", "x", "cluster", "distance"), []
    centroids, before = np.array([r["x"] for r in seeds], dtype=np.int64), None
    sums, counts = np.zeros((len(seeds), dims), dtype=object), np.zeros(len(seeds), dtype=object)
    for turn in range(rounds + 1):
        state = materialize(_assigned(state, centroids, before), "vectors")
        release(spark, since, keep=1)
        if turn == rounds:
            break
        more = _changes(state, len(seeds), dims)
        sums, counts = sums + more[0], counts + more[1]
        before, centroids = centroids, centroids.copy()
        for j in np.nonzero(counts)[0]:
            centroids[j] = [int(s) // int(counts[j]) for s in sums[j]]
        if (centroids == before).all():  # nothing moves any more, so no later round differs
            break
    return state.select("vec_id", "x", "cluster", "distance"), centroids.tolist()


def with_inertia(members: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256 (of the components in decimal, joined by commas)."""
    spark = members.sparkSession
    per = {r["cluster"]: int(r["d"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(per.values())
    table = [(j, per.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each of the k centroids.
    return members.join(F.broadcast(facts), "cluster")
