"""The lossless top-k join against scoring every pair."""

import random

import pytest
from linkengine.functions import similarity
from linkengine.operators import matching, topk_join
from linkengine.plans import queries as plans
from pyspark.sql import functions as F


def texts(seed, n, alphabet="abcdeé  я", words=("night", "train", "blue", "harbor", "live", "a", "of the")):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) for _ in range(n // 2)]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(n - n // 2)]


def best_of(spark, asked, offered, scorer, k):
    """The k best scores of each (group, query) and every pair at or above the last of them."""
    pairs = spark.createDataFrame([(g, a, b) for a in set(asked) - {None} for g, b in set(offered) if b is not None], "grp string, a string, b string")
    rows = similarity.SCORERS[scorer](pairs).collect()
    by = {}
    for r in rows:
        by.setdefault((r["grp"], r["a"]), []).append((r["score"], r["distance"], r["b"]))
    out = {}
    for key, found in by.items():
        kth = sorted((s for s, _, _ in found), reverse=True)[min(k, len(found)) - 1]
        out[key] = {x for x in found if x[0] >= kth}
    return out, len(rows)


@pytest.mark.parametrize("scorer,k", [("hybrid", 3), ("hybrid", 1), ("jaro_winkler", 1), ("levenshtein", 3)])
def test_nothing_of_the_k_best_is_lost(spark, scorer, k):
    asked = [*texts(1, 40), "", None, "\U0001f600 smile", "night train"]
    offered = [(g, b) for g, seed in (("x", 2), ("y", 3)) for b in texts(seed, 50)] + [("x", ""), ("x", None), ("y", "\U0001f600"), ("z", "lone"), ("z", None), ("y", "night train")]
    expected, _ = best_of(spark, asked, offered, scorer, k)
    a = spark.createDataFrame([(x,) for x in asked * 2], "a string")
    b = spark.createDataFrame(offered * 2, "grp string, b string")
    got = {}
    for r in topk_join.top_texts(a, b, scorer, k).collect():
        found = got.setdefault((r["grp"], r["a"]), set())
        assert (r["score"], r["distance"], r["b"]) not in found  # no pair twice
        found.add((r["score"], r["distance"], r["b"]))
    assert got.keys() == expected.keys()
    assert all(expected[key] <= got[key] for key in expected)


def test_queries_with_good_matches_meet_few_candidates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 12)))
    catalog = [f"{word()} {word()} {word()}" for _ in range(1500)]
    asked = [c[:-1] + "q" for c in catalog[::5]]
    a, b = spark.createDataFrame([(x,) for x in asked], "a string"), spark.createDataFrame([("", x) for x in catalog], "grp string, b string")
    scored = topk_join.top_texts(a, b, "hybrid", 1)
    assert scored.count() < 0.02 * len(asked) * len(catalog)
    expected, _ = best_of(spark, asked[:20], [("", x) for x in catalog], "hybrid", 1)
    got = {(r["grp"], r["a"], r["b"]) for r in scored.collect()}
    assert all((*key, x[2]) in got for key, found in expected.items() for x in found)


def test_without_rows_or_k(spark):
    a, b = spark.createDataFrame([("x",)], "a string"), spark.createDataFrame([("", "y"), ("", "x")], "grp string, b string")
    assert topk_join.top_texts(a.limit(0), b, "hybrid", 2).collect() == []
    assert topk_join.top_texts(a, b.limit(0), "hybrid", 2).collect() == []
    assert {r["b"] for r in topk_join.top_texts(a, b, "hybrid", None).collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        topk_join.top_texts(a, b, "nope", 1)


def test_a_scorer_without_bounds_scores_every_pair(spark, monkeypatch):
    monkeypatch.setitem(similarity.SCORERS, "length", lambda df: df.withColumns({"score": F.lit(1.0) / (1 + F.abs(F.length("a") - F.length("b"))), "distance": F.lit(0)}))
    a, b = spark.createDataFrame([("abc",)], "a string"), spark.createDataFrame([("", "zzz"), ("", "y")], "grp string, b string")
    assert {r["b"] for r in topk_join.top_texts(a, b, "length", 1).collect()} == {"zzz", "y"}


def test_ranks_of_a_large_catalog_without_nested_loops(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    search = lambda: matching.search(plans._part_queries(spark, sf), plans.catalogs(spark, sf), 2)
    columns = ["line_id", "source", "rank", "track_id", "score", "distance"]
    small = sorted(map(tuple, search().select(*columns).collect()))
    monkeypatch.setattr(matching, "is_small", lambda df: False)
    plans_seen = []
    written = topk_join.materialize
    monkeypatch.setattr(topk_join, "materialize", lambda df, label: (plans_seen.append(df._jdf.queryExecution().toString()), written(df, label))[1])
    found = search()
    assert sorted(map(tuple, found.select(*columns).collect())) == small
    plans_seen.append(found._jdf.queryExecution().toString())
    assert len(plans_seen) > 3 and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans_seen)


def test_native_scores_equal_those_of_batches(spark):
    pairs = spark.createDataFrame([(a, b) for a in texts(8, 30) + ["\x00a", None] for b in texts(9, 30) + ["a\x00", None]], "a string, b string")
    both = similarity.jaro_winkler(pairs.withColumn("expression", similarity.jaro_winkler_score(F.col("a"), F.col("b"))))
    native = {(r["a"], r["b"]): (r["score"], r["distance"]) for r in similarity.jaro_winkler(pairs, native=True).collect()}
    for r in both.collect():
        assert r["expression"] == r["score"] and native[r["a"], r["b"]] == (r["score"], r["distance"])
    plan = pairs.filter(similarity.jaro_winkler_score(F.col("a"), F.col("b")) > 0.9)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
