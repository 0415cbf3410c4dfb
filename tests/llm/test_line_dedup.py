import itertools
import math
import random
import re
import time
from collections import defaultdict

import pyarrow as pa
import pytest
from linkengine.llm import line_dedup

LONG = " ".join(f"token{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    return {(r["doc_id"], n): (r["text"], r["n_lines"], r["n_dropped"]) for n, r in enumerate(line_dedup.drop_recurring_lines(df).orderBy("doc_id").collect())}


def test_recurring_templates_go_but_from_the_first(spark):
    rows = [(i, f"own words of document {chr(97 + i)} alone\nPage {i} of 12, printed 2024-01-0{i}\n{LONG if i < 3 else 'rest ' + chr(97 + i)}") for i in range(1, 6)]
    got = run(spark, rows)
    assert got[(1, 0)][2] == 0
    for i in range(2, 6):
        text, n_lines, n_dropped = got[(i, i - 1)]
        assert n_lines == 3 and f"document {chr(97 + i)}" in text and "Page" not in text
        assert n_dropped == (2 if i == 2 else 1) and (LONG in text) == (i == 1)


def test_variable_fields_without_digits(spark):
    names = ["anna", "berta", "carla", "dora"]
    rows = [(i, f"this session was opened by {n} on the usual host\nnothing in common {n} here at all {n}{n} {i * 'z'}") for i, n in enumerate(names)]
    got = run(spark, rows)
    assert [got[(i, i)][2] for i in range(4)] == [0, 1, 1, 1]


def test_lines_of_one_document_and_pairs_stay(spark):
    got = run(spark, [(1, "same line here\nsame line here\nsame line here"), (2, "shared by two\nx"), (3, "shared by two\ny")])
    assert [v[2] for v in got.values()] == [0, 0, 0]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c\n\nd"), (4, "a b c\n\nd"), (5, "a b c"), (6, "a b c\n "), (None, "a b c"), (None, "a b c\nq"), (7, "w " * 100_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    out = line_dedup.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect() if r["text"] is not None and r["doc_id"] != 7)
    assert got == [(0, "", 1, 1), (0, "q", 2, 1), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "a b c\n\nd", 3, 0), (4, "a b c\n\nd", 3, 0), (5, "", 1, 1), (6, " ", 2, 1)]
    assert line_dedup.drop_recurring_lines(df.limit(0)).count() == 0


def test_every_family_of_a_leaf_is_found(spark):
    names = ["anna", "berta", "carla", "dora"]
    rows = [(i, f"this session was opened by {n} on the usual host\nown {n}") for i, n in enumerate(names)]
    rows += [(4 + i, f"this session was opened far too late for us all\nown {i * 'z'}z") for i in range(2)]
    rows += [(6 + i, f"this session was opened near {n} when it rained again\nown q{n}") for i, n in enumerate(names)]
    got = run(spark, rows)
    assert [got[(i, i)][2] for i in range(10)] == [0, 1, 1, 1, 0, 0, 0, 1, 1, 1]


def test_passages_over_short_lines_go_from_two_documents(spark):
    lines = [" ".join(f"{c}{chr(97 + i)}" for i in range(14)) for c in ("one", "two", "six", "ten")]
    pair = [" ".join(f"{c}{chr(97 + i)}" for i in range(26)) for c in ("cat", "dog")]
    passage = "\n".join([*lines, "and its end"])
    rows = [
        (1, f"head a\n{passage}\nfoot a"), (2, f"head b\nmore b\n{passage.replace(lines[2], chr(10) + lines[2])}\nfoot b"),
        (3, f"x\n{pair[0]}\n{pair[1]}\ny"), (4, f"{pair[1]}\n{pair[0]}"), (5, f"short\n{lines[0].upper()}\n{lines[1].upper()}"), (6, f"{lines[0].upper()}\n{lines[1].upper()}\nof it"),
    ]
    got = run(spark, rows)
    assert got[(1, 0)][2] == 0 and got[(2, 1)] == ("head b\nmore b\n\nfoot b", 9, 5)
    assert [got[(i, i - 1)][2] for i in (3, 4, 5, 6)] == [0, 0, 0, 0]



def test_exact_copies_in_groups_of_two_leave_once(spark):
    import corpus_pipeline

    long = "\n".join([LONG, *(f"own line {c} of the first text" for c in "abcdefghijk")])
    short = "a line of three\nsomething only here"
    rows = [(1, long), (2, long), (3, short), (4, short), (5, "a line of three\nother words")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_lines(spark, docs, ""), "")
    got = {r["doc_id"]: r["text"] for r in out.filter("text <> ''").collect()}
    assert got == {1: long, 3: short, 5: "other words"}


def leaders_of(lines, agree=0.6, depth=4):
    """{line: leader} by comparing each line with every leader before it; ``lines`` in order."""
    leaders, of = defaultdict(list), {}
    for line in lines:
        tokens = line.split(" ")
        same = leaders[len(tokens), *tokens[:depth]]
        wanted = math.ceil(agree * (len(tokens) - depth))
        fits = [x for x in same if sum(a == b for a, b in zip(tokens[depth:], x.split(" ")[depth:])) >= wanted]
        if len(tokens) >= depth + 2 and not fits:
            same.append(line)
        of[line] = fits[0] if fits and len(tokens) >= depth + 2 else line
    return of


def brute(rows, min_docs=3, long_tokens=50):
    """{id: kept text}: every line, run and leader compared, for distinct ids that are not null."""
    from hashlib import md5

    strip = lambda x: x.strip(" \t\r\f\v")
    mask = lambda x: re.sub(r"(?<!\S)[^\s\d]*?\d\S*", "<*>", strip(x)) if re.search("[0-9]", x) else strip(x)
    docs = {i: t.split("\n") for i, t in rows if t is not None}
    where = defaultdict(set)
    for i, lines in docs.items():
        for line in lines:
            where[mask(line)].add(i)
    where.pop("", None)
    order = sorted(where, key=lambda m: (len(where[m]), md5(m.encode()).digest()), reverse=True)
    leader, template = leaders_of(order), defaultdict(set)
    for m, of in leader.items():
        template[of] |= where[m]
    gone = {i: {n for n, x in enumerate(lines) if mask(x) and len(template[leader[mask(x)]]) >= min_docs and i != min(template[leader[mask(x)]])} for i, lines in docs.items()}
    runs, wholes = defaultdict(set), defaultdict(set)
    spans = []
    for i, lines in docs.items():
        at = [n for n, x in enumerate(lines) if strip(x)]
        words = [strip(lines[n]) for n in at]
        wholes[tuple(words)].add(i)
        for a, b in itertools.combinations(range(len(at) + 1), 2):
            if sum(len(x.split(" ")) for x in words[a:b]) >= long_tokens:
                runs[tuple(words[a:b])].add(i)
                spans.append((i, tuple(words[a:b]), at[a:b]))
    for i, words, at in spans:
        if i != min(runs[words]):
            gone[i] |= set(at)
    for words, ids in wholes.items():
        for i in ids - {min(ids)}:
            if gone[i]:
                gone[i] |= {n for n, x in enumerate(docs[i]) if strip(x)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(docs[i]) if n not in gone[i]) for i, t in rows}


def random_documents(seed, n):
    r = random.Random(seed)
    word = lambda k=30: r.choice("abcdefghijklmnopqrstuvwxyzäöüß"[:k]) * 2
    stock = [" ".join(["we", "saw", "the", "same", *(word(6) for _ in range(r.choice([2, 4, 7])))]) for _ in range(40)]
    stock += [" ".join(word() for _ in range(r.choice([1, 3, 12, 30]))) for _ in range(25)] + ["", " ", "at 12:30 a2 b"]

    def line():
        of = r.random()
        if of < 0.5:
            return r.choice(stock)
        if of < 0.75:
            tokens = r.choice(stock).split(" ")
            tokens[r.randrange(len(tokens))] = r.choice([word(), f"x{r.randrange(99)}"])
            return " ".join(tokens)
        return " ".join(word() for _ in range(9))

    rows = []
    for i in range(n):
        lines = [line() for _ in range(r.randrange(1, 7))]
        if rows and r.random() < 0.4:
            other = (r.choice(rows)[1] or "").split("\n")
            lines = other if r.random() < 0.4 else [*lines[:2], *other[r.randrange(len(other)) :], *lines[2:]]
        rows.append((i, None if r.random() < 0.03 else "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result_matches_brute_force(spark, seed):
    rows = random_documents(seed, 120)
    out = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert sum(r["n_dropped"] > 0 for r in out) > 20


def test_large_leaves_are_read_in_parts(spark, monkeypatch):
    """Two families and 60 single lines in one leaf: parts find what the whole leaf does."""
    r = random.Random(5)
    lines = [f"the log tells us {x * 3} has gone to bed at night {x}{x}" for x in map(chr, range(97, 123))]
    lines += [f"the log tells us that one more of them {x} {x * 2} was seen" for x in map(chr, range(97, 123))]
    lines += ["the log tells us " + " ".join("".join(r.choices("qwertz", k=5)) for _ in range(8)) for _ in range(60)]
    rows = list(enumerate(f"{x}\nown {i * 'z'}" for i, x in enumerate(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(line_dedup.drop_recurring_lines(df).collect())
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 8)
    assert sorted(line_dedup.drop_recurring_lines(df).collect()) == want
    assert [x["n_dropped"] for x in want] == [0, *[1] * 25, 0, *[1] * 25, *[0] * 60]


def test_lines_that_share_a_block_take_linear_time():
    """The lines of one leaf agree in half of their positions, which is not enough to join."""

    def seconds(n):
        masks = ["a b c d and this much is equal " + " ".join(f"{'xyzuv'[j]}{i}" for j in range(5)) for i in range(n)]
        columns = [pa.array([7] * n), pa.array([0] * n), pa.array([1] * n), pa.array([str(i).encode() for i in range(n)]), pa.array(masks)]
        batch = pa.RecordBatch.from_arrays(columns, ["leaf", "part", "docs", "tpl", "mask"])
        since = time.perf_counter()
        assert sum(x.num_rows for x in line_dedup._grouped(iter([batch]))) == 0
        return time.perf_counter() - since

    assert seconds(16_000) < 2
    assert seconds(32_000) < 6 * seconds(8_000) + 1
