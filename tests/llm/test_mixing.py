import hashlib
import random

import pytest
from linkengine.llm import mixing
from pyspark.sql import functions as F

LEVELS = {"domain": "domain", "lang": "lang", "source": "source"}


def fill(children, budget):
    """children: {name: (weight, capacity)} -> {name: amount}; whole families are filled first."""
    out, live = dict.fromkeys(children, 0.0), {n for n, (w, _) in children.items() if w > 0}
    while live:
        weight = sum(children[n][0] for n in live)
        share = budget / weight
        full = [n for n in live if children[n][1] <= share * children[n][0] + 1e-12]
        if not full:
            for n in live:
                out[n] = share * children[n][0]
            break
        for n in full:
            out[n] = children[n][1]
            budget -= children[n][1]
            live.discard(n)
    return out


def brute(rows, weights, share, epochs, seed):
    count = lambda t: len((t or "").split())
    leaf = {}
    for i, t, *path in rows:
        leaf.setdefault(tuple(x if x is not None else "unknown" for x in path), []).append((i, count(t)))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    weigh = lambda d, name: weights[d].get(name, 1)
    zero = lambda k: any(weigh(d, n) == 0 for d, n in enumerate(k))
    capacity = {k: 0 if zero(k) else t * epochs for k, t in tokens.items()}
    budgets = {(): float(int(sum(tokens.values()) * share))}
    for depth in range(3):
        nxt = {}
        for parent, b in budgets.items():
            names = {k[depth] for k in tokens if k[:depth] == parent}
            kids = {n: (weigh(depth, n), sum(c for k, c in capacity.items() if k[: depth + 1] == (*parent, n))) for n in names}
            nxt |= {(*parent, n): x for n, x in fill(kids, b).items()}
        budgets = nxt
    out = []
    for k, docs in leaf.items():
        b = int(round(budgets[k], 3) // 1)
        whole = min(b // tokens[k], epochs) if tokens[k] else (1 if b > 0 else 0)
        rest = b - whole * tokens[k] if whole < epochs else 0
        order = sorted({i for i, _ in docs}, key=lambda i: hashlib.md5(f"{seed}:{whole}:{'null' if i is None else i}".encode()).hexdigest())
        taken, total = set(), 0
        for i in order:
            total += sum(n for j, n in docs if j == i)
            if rest > 0 and total <= rest:
                taken.add(i)
        out += [(str(i), *k, n, whole + (i in taken)) for i, n in docs if whole + (i in taken)]
    return sorted(out)


def table(n=900):
    random.seed(12)
    rows = []
    for i in range(n):
        source = random.choice(["s0", "s0", "s0", "s1", "s2", None])
        rows.append((i, "x " * random.choice([0, 1, 5, 40, 200]), "d" + str(hash(source) % 1 if source is None else int(source[1]) % 2), random.choice(["en", "de", None]), source))
    rows += [(3, "dup dup", "d0", "en", "s0"), (3, "dup dup", "d0", "en", "s0"), (None, "no id", "d0", "en", "s0"), (5000, None, "d0", "en", "s0"), (5001, "a", "d9", "zz", "t")]
    return rows


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.6, 2), (1.7, 2), (9.0, 3), (0.0, 1)])
def test_matches_brute_force(spark, share, epochs):
    rows = table()
    weights = [{"d0": 30, "d1": 60, "d9": 10}, {"en": 5, "de": 1}, {"s2": 3}]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, domain string, lang string, source string, copies string")
    got = mixing.mix(df, {k: F.col(v) for k, v in LEVELS.items()}, weights, share, epochs, 17)
    found = sorted((str(r["doc_id"]), r["domain"], r["lang"], r["source"], r["n_tokens"], r["copies"]) for r in got.collect())
    assert found == brute(rows, weights, share, epochs, 17)


def test_zero_weight_and_empty(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string, domain string, lang string, source string")
    levels = {k: F.col(v) for k, v in LEVELS.items()}
    got = mixing.mix(df, levels, [{"d0": 0}, {}, {}], 0.5)
    assert got.filter("domain = 'd0'").count() == 0 and got.count() > 0
    assert mixing.mix(df.limit(0), levels, [{}, {}, {}], 0.5).count() == 0
