"""Exponion search against plain rounds in Python integers."""

import hashlib
import random

import numpy as np
import pytest
from linkengine.llm import exponion

SCHEMA = "vec_id long, embedding array<double>, cluster string, upper string, x int"


def brute(rows, k, rounds, dims, scale, seed=3):
    kept = [(i, [int(np.floor(c * scale)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))[:k]
    centroids = [list(x) for _, x in seeds]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), a in zip(kept, of) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted((str(i), x, near(x)[1], near(x)[0]) for i, x in kept), centroids


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "c", "u", 7) for i, v in rows], SCHEMA).repartition(3)
    members, centroids = exponion.cluster(table, **options)
    got = sorted((str(r["vec_id"]), list(r["x"]), r["cluster"], r["distance"]) for r in members.collect())
    expected, plain = brute(rows, options["k"], options["rounds"], options["dims"], options["scale"])
    assert got == expected and centroids == plain
    return members, centroids


@pytest.mark.parametrize("seed,spread,k", [(1, 1.0, 8), (2, 0.05, 5), (3, 30.0, 12)])
def test_equals_plain_rounds(spark, seed, spread, k):
    rng = random.Random(seed)
    centres = [[rng.uniform(-5, 5) for _ in range(4)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(400)]
    check(spark, rows, k=k, rounds=6, dims=4, scale=16)


def test_ties_and_repeats_on_a_grid(spark):
    # A small integer grid: many vectors lie at equal distances from several centroids, and seeds repeat.
    rows = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(90)]
    check(spark, rows + rows[:9], k=7, rounds=5, dims=2, scale=1)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-0.3, 0.2]), (None, [4.0, 4.0]), (6, [-0.3, 0.2]), (7, [])]
    members, centroids = check(spark, rows, k=8, rounds=3, dims=2, scale=10)
    assert members.count() == 3 and len(centroids) == 3
    facts = exponion.with_inertia(members, centroids).collect()
    assert {r["centroid_sha256"] for r in facts} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids}
    assert all(r["inertia"] == 0 for r in facts)
    empty = spark.createDataFrame([], SCHEMA)
    assert exponion.with_inertia(*exponion.cluster(empty, dims=2)).collect() == []
    with pytest.raises(Exception, match="leaves the range"):
        exponion.cluster(spark.createDataFrame([(1, [1e12, 0.0], "", "", 1)], SCHEMA), dims=2)[0].collect()


def test_scans_only_the_ball():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 8))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    first = exponion.Search(centres, None)
    home, upper, lower = first.assign(x, np.zeros(3000, dtype=np.int64), np.zeros(3000), np.zeros(3000))
    moved = centres + rng.integers(-30, 30, centres.shape)
    later = exponion.Search(moved, centres)
    number, _, _ = later.assign(x, home, upper, lower)
    assert (number == np.array([((moved - row) ** 2).sum(axis=1).argmin() for row in x])).all()
    assert first.scanned == 3000 * 40 and later.scanned < 3000 * 4
