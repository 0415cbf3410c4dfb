import math
import random
from pathlib import Path

import pytest
from linkengine.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, is_query, k):
    valid = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in valid:
        if is_query(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def rows():
    random.seed(9)
    out = [(i, [random.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    out += [(300 + i, out[7][1]) for i in range(40)] + [(7, out[7][1]), (10, out[3][1]), (400, out[11][1])]
    out += [(500, None), (510, [float("nan")] * 8), (520, [None] * 8), (530, [float("inf")] * 8), (540, [1.0]), (550, [2.0]), (560, []), (570, []), (None, out[0][1])]
    return out


def check(spark, data, k=5, **options):
    df = spark.createDataFrame([(i, v, "s") for i, v in data], SCHEMA)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, k, **options).collect()
    assert sorted(tuple(r) for r in got) == brute(data, lambda i: i % 10 == 0, k)


def test_matches_brute_force(spark):
    check(spark, rows())


def test_small_blocks_and_waves(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    check(spark, rows(), k=3, wave_queries=7)


def test_values_beyond_float_precision(spark):
    random.seed(10)
    check(spark, [(i, [random.gauss(0, 1e4) for _ in range(3)]) for i in range(60)])
    check(spark, [(i, [random.gauss(0, 3e5) for _ in range(3)]) for i in range(60)])
    check(spark, [(i, [1e7 + i, -1.0]) for i in range(1, 12)])
    check(spark, [(i, [float(2**20 + i), 2.0**18]) for i in range(1, 25)])


def test_empty_and_few(spark):
    check(spark, [(10, [1.0])])
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (40, 6))
    q = rng.integers(-50, 50, (5, 6)).astype(float)
    reader = topk.Reader(topk.BlockLists.of(np.arange(40), x))
    query, candidate = (at.ravel() for at in np.indices((5, 40)))
    for depth in (0, 1, 6, 18, 20):
        reader.read(depth)
        halves = np.maximum(q, 0), np.minimum(q, 0)
        low, high = reader.bounds(*halves)
        exact = q @ x.T
        assert (low <= exact).all() and (exact <= high).all()
        for one, all_ in zip(reader.pair_bounds(*halves, query, candidate), (low, high)):
            assert (one == all_.ravel()).all()
    assert (low == high).all()


def test_reading_stops_early_on_skewed_lists():
    """With a few dominant rows the frontier falls fast, and reading ends at a small depth."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (2048, 6))
    x[rng.choice(2048, 12, replace=False)] += 2000
    q = rng.integers(1, 40, (30, 6))
    found = topk.TopK(np.arange(30) + 10_000, q, 5)
    blocks = [topk.BlockLists.of(np.arange(a, a + 512), x[a : a + 512]) for a in range(0, 2048, 512)]
    for block in blocks:
        found.read(block)
    assert found.stopped > 0
    # With scores known from elsewhere that no row reaches, every reading stops.
    again = topk.TopK(found.ids, q, 5, np.array([-best[0][0] + 1 for best in found.best]))
    for block in blocks:
        again.read(block)
    assert again.stopped == again.reads == 120
    scores = q @ x.T
    for row, best in enumerate(found.best):
        want = sorted((-int(s), i) for i, s in enumerate(scores[row]))[:5]
        assert best == want


def test_reader_takes_entries_from_the_lists_in_order():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (50, 3))
    reader = topk.Reader(topk.BlockLists.of(np.arange(50), x))
    reader.read(5)
    assert (reader.unread.sum(axis=1) == 40).all()
    ends = np.sort(x, axis=0)
    assert (ends[:5].sum(axis=0) + ends[-5:].sum(axis=0) == reader.x.sum(axis=1)).all()
    reader.resolve(np.array([4, 17]))
    assert (reader.x[:, [4, 17]] == x[[4, 17]].T).all() and not reader.unread[:, [4, 17]].any()
    q = rng.integers(-9, 9, (20, 3)).astype(float)
    low, high = reader.bounds(np.maximum(q, 0), np.minimum(q, 0))
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and (low[:, [4, 17]] == high[:, [4, 17]]).all()


def check_reads(x, ids, queries, k=5):
    """The share of reads that stop early; every query's top k is compared with all scores."""
    import numpy as np

    found = topk.TopK(ids[queries], x[queries], k)
    for a in range(0, len(x), topk.BLOCK_ROWS):
        found.read(topk.BlockLists.of(ids[a : a + topk.BLOCK_ROWS], x[a : a + topk.BLOCK_ROWS]))
    for row, at in enumerate(queries.tolist()):
        scores = x @ x[at]
        assert found.best[row] == sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[at])[:k]
    assert found.reads == len(queries) * -(-len(x) // topk.BLOCK_ROWS) and found.stopped <= found.reads
    return found.stopped / found.reads


def test_reads_of_even_vectors_stop_with_k_left():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 32, (5000, 64))).astype(np.int64)
    assert check_reads(x, np.arange(5000), np.arange(0, 5000, 50)) > 0.5


def test_ties_at_the_last_place_are_read_to_the_end():
    import numpy as np

    x = np.repeat(np.arange(1, 9)[:, None], 40, axis=0).repeat(3, axis=1)
    assert check_reads(x, np.arange(len(x))[::-1].copy(), np.arange(0, len(x), 7)) < 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the given tables")
def test_reads_of_the_given_vectors_stop_before_the_end():
    import numpy as np
    import pyarrow.parquet as pq

    of = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    rows = [(i, v) for i, v in zip(of["vec_id"], of["embedding"]) if v is not None and len(v) == 64]
    x = np.floor(np.array([v for _, v in rows], dtype=np.float64) * 256).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    assert check_reads(x, ids, np.nonzero(ids % 50 == 0)[0]) > 0.5
