import math
import random

from linkengine.llm import licenses


def test_scan_and_inheritance(spark):
    prose = "some words that say nothing about it at all"
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/x.py", prose), ("r/a/c.py", f"{prose}\nLicensed under the Apache License, Version 2.0.\n{prose}"),
        ("r/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/d/e/y.py", prose), ("s/z.py", prose), ("top.txt", prose),
        ("r/d/e/y.py", prose), (None, None), ("r/q", ""), ("r/long", prose + "\n" + "w " * 300_000 + "\nAll rights reserved."), ("t/whole", "All rights reserved."), ("t/u", prose),
        ("v/LICENSE", prose), ("v/w", prose), ("rr/x", prose),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, license string")
    out = licenses.scan_licenses(df)
    got = {r["path"]: (r["license"], r["license_via"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        "r/LICENSE": ("MIT", "file"), "r/a/b/x.py": ("MIT", "inherited"), "r/a/c.py": ("Apache-2.0", "header"), "r/d/COPYING": ("GPL-3.0", "file"),
        "r/d/e/y.py": ("GPL-3.0", "inherited"), "s/z.py": (None, None), "top.txt": (None, None), None: (None, None), "r/q": ("MIT", "inherited"),
        "r/long": ("Proprietary", "header"), "t/whole": ("Proprietary", "file"), "t/u": ("Proprietary", "inherited"), "v/LICENSE": (None, None), "v/w": (None, None), "rr/x": (None, None),
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0


FREQUENCY = {"the": 900, "license": 80, "under": 500, "version": 30, "to": 700, "of": 800, "and": 900}


def matcher():
    return licenses.Matcher(licenses.TEMPLATES, FREQUENCY, 1000, licenses.THRESHOLD)


def brute(m, text):
    """The best of all windows of all templates, by the definition of the cosine."""
    words, best, covered = licenses._words(text), (0.0, 0, None), set()
    for name, length, vector, _ in m.templates if words else []:
        n, found = min(length, len(words)), []
        for at in range(len(words) - n + 1):
            weights = {}
            for w in words[at : at + n]:
                weights[w] = weights.get(w, 0.0) + m.idf.get(w, m.rare)
            norm = math.sqrt(sum(v * v for v in weights.values()))
            cosine = sum(v * vector.get(w, 0.0) for w, v in weights.items()) / norm
            if cosine >= licenses.THRESHOLD:
                found.append((-round(cosine, 9), at))
        mine = set()
        for cosine, at in sorted(found):
            if mine.isdisjoint(range(at, at + n)):
                mine.update(range(at, at + n))
                if (-cosine, length) > best[:2]:
                    best = (-cosine, length, name)
        covered |= mine
    return best[2], best[0], len(covered) / len(words) if words else 0.0


def test_scan_matches_brute_force():
    random.seed(3)
    m = matcher()
    templates = [t for texts in licenses.TEMPLATES.values() for t in texts]
    known = sorted(m.idf)
    for _ in range(60):
        words = random.choices(known + ["other", "word"] * 40, k=random.randint(0, 30))
        for _ in range(random.randint(0, 2)):
            of = [w for w in licenses._words(random.choice(templates)) if random.random() < random.choice([1.0, 0.9, 0.6])]
            at = random.randint(0, len(words))
            words[at:at] = of
        text = "".join(w + random.choice([" ", "\n# ", "\n"]) for w in words)
        got, want = m.scan(text), brute(m, text)
        assert got[0] == want[0] and math.isclose(got[1], want[1], abs_tol=1e-8) and math.isclose(got[2], want[2], abs_tol=1e-12)


def test_headers_and_full_texts_are_recognised():
    m = matcher()
    code = "def f(x):\n    return x + 1\n" * 20
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = text.split(" ")
            wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            assert m.scan(f"/* Copyright 2021 Someone\n{wrapped}\n */\n{code}")[0] == name
    assert m.scan(f"# SPDX-License-Identifier: EUPL-1.2\n{code}")[:2] == ("EUPL-1.2", 1.0)
    inside = "This little tool is Released under the MIT License. You are welcome to send patches to the address that is given below."
    assert m.scan(inside)[0] == "MIT"
    assert m.scan(code)[0] is None


def test_internal_names_as_extra_columns(spark):
    names = ["_row", "_path", "_text", "_dir", "_file", "_share", "_license", "_above", "_near", "_depth", "own_score", "id"]
    rows = [("r/LICENSE", "Released under the MIT License.", *(f"{n}1" for n in names)), ("r/a", "x", *(f"{n}2" for n in names))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in ["path", "text", *names]))
    got = {r["path"]: r for r in licenses.scan_licenses(df).collect()}
    assert [got[p]["license"] for p in ("r/LICENSE", "r/a")] == ["MIT", "MIT"]
    for n in names:
        if n != "own_score":
            assert (got["r/LICENSE"][n], got["r/a"][n]) == (f"{n}1", f"{n}2")
