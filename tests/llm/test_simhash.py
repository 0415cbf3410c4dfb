import random
from itertools import combinations

import numpy as np
import xxhash
from linkengine.llm import simhash
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    random.seed(4)
    texts = [None, "", " \t\n", "One", "one TWO", "É é x\x0by z"]
    texts += [" ".join(random.choice("ab Cd ÜE f".split(" ")) for _ in range(random.randint(0, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


def test_posting_list_classes_match_pairs():
    rng = np.random.default_rng(5)
    for m in (2, 30, 250, 400, 3000):
        members = np.unique(rng.integers(0, 1 << 16, m).astype(np.uint64) << np.uint64(24)) | np.uint64(7)
        links = [(int(a), int(b)) for a, b in combinations(members, 2) if bin(int(a) ^ int(b)).count("1") <= 2]
        want = {}
        for n, r in components(links, [int(x) for x in members]).items():
            want.setdefault(r, set()).add(n)
        got = {frozenset(g.tolist()) for g in simhash.linked_classes(members)}
        assert got == {frozenset(v) for v in want.values() if len(v) > 1}


def test_links_and_components_match_brute_force(spark):
    random.seed(6)
    fps = {random.getrandbits(64) for _ in range(60)}
    for start in list(fps)[:12]:
        for _ in range(8):
            for _ in range(random.randint(1, 2)):
                start ^= 1 << random.randrange(64)
            fps.add(start)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.link_chains(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    links = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = {}
    for n, r in components(links, signed).items():
        want.setdefault(r, set()).add(n)
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_long_chain_is_one_component(spark):
    edges = spark.range(0, 3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    for one_task in (0, 500, 200_000):
        rows = simhash.connected_components(edges, one_task)
        assert rows.count() == 3001 and rows.select("root").distinct().count() == 1
    assert simhash.connected_components(edges.limit(0)).count() == 0


def documents(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of considerable strength"
    rows = [(5, base, "x"), (3, base, "x"), (3, base, "x"), (None, base, None), (9, "something else entirely " * 9, "y"), (11, None, "z"), (12, "", "z"), (13, " \n", "z"), (None, "no id at all here", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string")


def test_component_ids_and_edges(spark):
    rows = simhash.components(documents(spark)).collect()
    assert len(rows) == 9
    by = sorted((r["_id"] if r["_id"] is not None else -1, r["component_id"] if r["component_id"] is not None else -1) for r in rows)
    assert by == [(-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (9, 9), (11, 11), (12, 11), (13, 11)]
    assert simhash.components(documents(spark).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 9, 11]


def test_whole_query_matches_brute_force(spark, tmp_path):
    """Fingerprints, links and components of the registered query, from the text on."""
    from linkengine.llm import queries

    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "One TWO"]
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(80, 400))
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 4)):
            base[random.randrange(len(base))] = random.choice(vocabulary)
            texts.append(" ".join(base))
    ids = random.sample(range(10_000), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want_fp = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a, b in combinations(ids, 2) if bin(want_fp[a] ^ want_fp[b]).count("1") <= 2]
    want = components(links, ids)
    got = queries.op8_simhash(spark, str(tmp_path)).collect()
    assert any(a != b for a, b in want.items())
    assert sorted(tuple(r) for r in got) == sorted((i, f"{want_fp[i]:016x}", want[i]) for i in ids)


def test_crowded_lists_are_posted_again(spark):
    """More fingerprints than a list holds that share a seed: components as of all pairs."""
    random.seed(12)
    low = random.sample(range(1 << 32), 700)
    fps = [0x1234567800000000 | x for x in low] + [0x1234567800000000 | (x ^ 1 << random.randrange(32)) for x in low[:200]]
    fps = sorted(set(fps))
    edges = simhash.link_chains(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    want = components(near, fps)
    assert near and all((got.get(a, a) == got.get(b, b)) == (want[a] == want[b]) for a, b in [*near, *zip(fps, fps[1:])])
    assert set(got) == {x for pair in near for x in pair}


def test_tally_counts_shared_entries():
    rng = np.random.default_rng(7)
    members = rng.integers(0, 4, (120, 8)).astype(np.uint8).view("<u8").ravel()
    a, b = simhash.tallied_pairs(members)
    as_bytes = members.view(np.uint8).reshape(-1, 8)
    want = [(i, j) for i, j in combinations(range(len(members)), 2) if (as_bytes[i] == as_bytes[j]).sum() >= 6]
    assert sorted(zip(a.tolist(), b.tolist())) == want
