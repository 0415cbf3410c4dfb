import hashlib
import random
import re

import pytest
from linkengine.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, text, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def texts():
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ñu", "THE", "x-y", "7"]
    make = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, make(random.choice([1, 2, 4, 9, 10, 11, 30]) if i else 40)) for i in range(12)]
    items += [(20, "a a a a a a a a a a a a"), (21, "a a a"), (None, make(15)), (22, None), (23, " .. "), (0, make(12))]
    docs = []
    for i in range(40):
        parts = [make(random.randint(0, 40))]
        for _, t in random.sample(items, 3):
            w = (t or "").split(" ")
            a = random.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[a : a + random.randint(3, 30)]), make(random.randint(0, 3))]
        docs.append((i, ", ".join(parts)))
    docs += [(50, None), (51, ""), (52, "a " * 500), (None, items[0][1]), (3, docs[3][1]), (3, "other")]
    return docs, items


@pytest.mark.parametrize("grams", [winnowing.BROADCAST_GRAMS, 0])
def test_matches_brute_force(spark, monkeypatch, grams):
    monkeypatch.setattr(winnowing, "BROADCAST_GRAMS", grams)
    docs, items = texts()
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, w string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.contamination(d, b).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((i, n, h, f) for i, _, n, h, f in brute(docs, items)), key=key)
    assert sorted(((r["_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=key) == want


def test_empty_tables_and_filter(spark):
    docs, items = texts()
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, _th string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.contamination(d.limit(0), b).count() == 0
    assert {r["n_hit"] for r in winnowing.contamination(d, b.limit(0)).collect()} == {0}
    kept = winnowing.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(1 for *_, h, _ in brute(docs, items) if not h)


def test_digest_query(spark, tmp_path):
    from linkengine.llm.queries import op6_winnowing

    docs, items = texts()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((str(i), hashlib.sha256(",".join(f).encode()).hexdigest()) for i, _, _, _, f in brute(docs, items))
    assert sorted((str(r["doc_id"]), r["items_sha256"]) for r in op6_winnowing(spark, str(tmp_path)).collect()) == want
