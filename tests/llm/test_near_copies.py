import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from linkengine.llm import near_copies


def jaccard(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_the_stage_links_every_pair_of_the_similarity(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(random.choice([60, 200, 900]))]
        for edits in (0, 0, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = word()
            base = copy if random.random() < 0.5 else base
            texts.append(" ".join(copy))
    texts += ["", " \n", "one two", "ONE two", "one three"]
    random.shuffle(texts)
    group = list(range(len(texts)))
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8 or not texts[a].split() and not texts[b].split()]
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    assert any(0.8 <= jaccard(texts[a], texts[b]) < 1 for a, b in pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: r["component_id"] for r in near_copies.components(docs).collect()}
    assert got == dict(enumerate(group))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group))
    assert near_copies.components(docs.limit(0)).count() == 0


def test_pairs_meet_by_position_and_byte_and_the_tally_drops_unlike_ones(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 900 - n], rng.integers(0, 1 << 63, n, dtype=np.uint64)))) for n in (0, 20, 60, 100, 300, 500, 900)]
    keys = [near_copies.postings(s) for s in sets]
    prints = [near_copies.fingerprint(s) for s in sets]
    for k, p in zip(keys, prints):
        # The keys hold every entry: four positions' bytes under the number of their seed.
        assert len(p) == 128 and [x >> 32 for x in k] == list(range(32))
        assert [x >> 8 * j & 0xFF for x in k for j in range(4)] == p.tolist()
    alike = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets]
    shared = [int((prints[0] == p).sum()) for p in prints]
    assert shared[0] == 128 and all(abs(n / 128 - j) < 0.15 for n, j in zip(shared, alike))
    index = spark.createDataFrame(list(enumerate(keys)), "fp long, keys array<long>")
    pairs = spark.createDataFrame([(0, i) for i in range(1, len(sets))], "u long, v long")
    got = sorted(r["v"] for r in near_copies.tallied(pairs, index).collect())
    assert got == [i for i in range(1, len(sets)) if shared[i] >= near_copies.LEAST_SHARED]
    assert all(i in got for i in range(1, len(sets)) if alike[i] >= 0.8) and len(sets) - 1 not in got
    # Within a list, only what the tally leaves is counted: equal sets under foreign entries are not.
    far = near_copies.fingerprint(sets[-1])
    assert near_copies.joined_components([5, 6], [5, 6], [prints[0], prints[1]], sets[:2], 0.8) == [(5, 6)]
    assert near_copies.joined_components([5, 6], [5, 6], [prints[0], far], [sets[0], sets[0]], 0.8) == []


def test_a_crowded_list_is_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LIST_MEMBERS", 4)
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    base = [word() for _ in range(300)]
    # Each text changes one word more; neighbours are linked, the ends are not.
    texts = [" ".join([word() if 0 < k <= n * 3 else w for k, w in enumerate(base)]) if n else " ".join(base) for n in range(30)]
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    assert 1 < len(set(group)) < len(texts)
    got = near_copies.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(group))
