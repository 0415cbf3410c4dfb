"""The manifest against a plain tree in Python."""

import hashlib
import random

import pytest
from linkengine.llm import merkle
from linkengine.llm.queries import op13_merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, idx string, digest string, grp string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root, and for every node the siblings and places up to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i - i % 3 : i - i % 3 + 3]
            paths[leaf].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            at[leaf] = i // 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def folded(leaf, path):
    for place, siblings in path:
        leaf = h("".join([*siblings[:place], leaf, *siblings[place:]]))
    return leaf


def brute(rows, claimed):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], h("".join(map(written, (r[0], r[3], r[2], r[4], r[1])))), h("".join(map(written, (r[0], r[3], r[2], r[4], claimed(r)))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: climb([x[1] for x in groups[g]]) for g in names}
    root, tops = climb([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (key, leaf, claim), path in zip(groups[g], trees[g][1]):
            back = folded(claim, path + top)
            out.append((str(key), leaf, trees[g][0], root, "".join("".join(s) for _, s in path + top), back, back == root))
    return sorted(out)


def spark_rows(spark, rows, claimed=None, **options):
    docs = spark.createDataFrame([(*r, "b", "i", "d", "g") for r in rows], SCHEMA)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claim = [*fields[:-1], claimed] if claimed is not None else None
    got = merkle.manifest(docs.repartition(3), fields, F.col("source"), F.col("doc_id"), claim, **options)
    return sorted((str(r["key"]), *list(r)[1:]) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"run_leaves": 5, "first_height": 2, "step": 1}])
def test_equals_a_plain_tree(spark, options):
    rng = random.Random(4)
    sources = [None, "", "a", "é", "z", "\U0001f600", "￿", "-", *(f"s{i}" for i in range(9))]
    rows = [(i, f"line {i}\nmore\n" * rng.randrange(4), rng.choice(["en", None]), "hot" if i % 3 == 0 else rng.choice(sources), rng.choice([None, i])) for i in range(300)]
    rows += [(5000, None, "en", "hot", 1), (5001, "", "en", "lone", 0), (5002, "long\n" * 50000, "en", "hot", 9)]
    claimed = lambda r: r[1].replace("\n", "") if r[0] % 4 == 0 and r[1] is not None else r[1]
    column = F.when(F.col("doc_id") % 4 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    assert spark_rows(spark, rows, column, **options) == brute(rows, claimed)


@pytest.mark.parametrize("n", [1, 3, 4, 10, 28])
def test_sizes(spark, n):
    rows = [(i, f"t{i}", "en", "one", i) for i in range(n)]
    assert spark_rows(spark, rows, run_leaves=4, first_height=1, step=1) == brute(rows, lambda r: r[1])


def test_repeats_and_missing_ids(spark):
    rows = [(7, "same", "en", "s", 4)] * 20 + [(None, "x", "en", "s", 1), (None, "y", None, None, None), (7, "other", "en", "s", 5)]
    got = spark_rows(spark, rows, run_leaves=3, first_height=1, step=2)
    assert got == brute(rows, lambda r: r[1]) and all(r[-1] for r in got)


def test_empty(spark):
    assert spark_rows(spark, []) == []


def test_query_tampers_with_every_second_document(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op13_merkle(spark, sf).collect()}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import zlib

    claimed = lambda r: r[1].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None else r[1]
    expected = brute(rows, claimed)
    assert len(got) == len(expected)
    for key, leaf, subroot, root, proof, back, same in expected:
        r = got[int(key)]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) == (leaf, subroot, root, h(proof), back, same)
    assert {r["verified"] for r in got.values()} == {True, False}
