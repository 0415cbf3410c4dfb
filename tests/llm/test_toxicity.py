import itertools
import random
import time

import pytest
from linkengine.llm import toxicity
from linkengine.llm.toxicity import ToxicityModel, maximal_segments
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_segments(scores):
    """Maximal segments by their definition: recurse around the best-scoring segment."""
    def best(low, high):
        found = None
        for a, b in itertools.combinations_with_replacement(range(low, high), 2):
            total = sum(scores[a : b + 1])
            if total > 0 and (found is None or total > found[0] or total == found[0] and b - a < found[2] - found[1]):
                found = (total, a, b)
        return found

    def split(low, high):
        top = best(low, high)
        return [] if top is None else [*split(low, top[1]), (top[1], top[2], top[0]), *split(top[2] + 1, high)]

    return split(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([3.25, 1.5, -1, -1, -1, -2.125, 7.0625]), max_size=14))
def test_maximal_segments_match_their_definition(scores):
    own = [(i, s) for i, s in enumerate(scores) if s != -1]
    got = maximal_segments([i for i, _ in own], [s for _, s in own], -1)
    want = brute_segments(scores)
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
    assert max([s for *_, s in got], default=0) == max([s for *_, s in want], default=0)
    for a, b, s in got:
        assert s == pytest.approx(sum(scores[a : b + 1])) and s > 0


def corpus(spark, n=400):
    docs, labels = [], []
    for i in range(n):
        words = [f"w{(i * 7 + j * j) % 97}" for j in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[(i * 3) % 25 : (i * 3) % 25] = [["grumb", "snarl", "blarg"][i % 3], "hrmph"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_generalises(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"))
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").filter("doc_id % 5 = 0").collect()
    assert all((r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in rows)
    assert all(bool(r["toxic_passages"]) == bool(r["toxic"]) for r in rows)


def test_edges(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, "x", 0.5), (2, "", "x", 0.5), (2, "", "x", 0.5), (None, "w1 " * 200_000, None, None), (4, "...", "y", 1.0), (5, "Hrmph GRUMB", "y", 1.0)],
        "doc_id long, text string, _uid string, toxicity double",
    )
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == 6
    scores = {(r["doc_id"], r["text"][:5] if r["text"] else r["text"]): r["toxicity"] for r in rows}
    assert scores[(1, None)] == scores[(2, "")] == scores[(4, "...")] < 0.5 < scores[(5, "Hrmph")]
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0)).probability(0.0) == pytest.approx(0.0, abs=1e-9)
    only_clean = toxicity.fit(docs, labels.filter("toxic = 0"))
    scores = {r["toxicity"] for r in toxicity.score_documents(docs, only_clean).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    null_labels = labels.withColumn("toxic", labels.toxic.cast("int") * 0).filter("false")
    assert isinstance(toxicity.fit(docs, null_labels), ToxicityModel)


def test_scan_is_linear():
    """A million isolated hits, the case in which every candidate stays in the list."""
    took = []
    for n in (100_000, 1_000_000):
        began = time.perf_counter()
        found = maximal_segments(list(range(0, 4 * n, 4)), [1.0] * n, -0.5)
        took.append(time.perf_counter() - began)
        assert len(found) == n
    assert took[1] < 40 * took[0] and took[1] < 20
    random.seed(1)
    values = [random.choice([3.0, 1.0, -2.0]) for _ in range(300_000)]
    assert maximal_segments(list(range(300_000)), values, -1.0)


def test_all_significant_words_are_kept(spark):
    """No bound on the number of scored words but the labelled sample's own."""
    rows = [(i, " ".join(f"t{i % 40}x{j}" if i % 2 else f"c{i % 40}x{j}" for j in range(60))) for i in range(1200)]
    docs = spark.createDataFrame([(i, f"{t} w{i}") for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 100 * (i % 2)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, min_z=0.01)
    assert len(model.scores) > 1000
