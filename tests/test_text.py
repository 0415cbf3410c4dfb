import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linkengine.functions import language, patterns, rounding, similarity, text, translit, unicode
from linkengine.operators import parsing, variants
from linkengine.sources import lines
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_normalisation_steps_in_order(spark):
    given = ["\t07) BLUE HARBOR – Night   Train", "Ledokol | Белый_шум; часть #2", "", "salt\x1fand\u2003pepper"]
    rows = text.with_normalized(lines.from_list(spark, given)).orderBy("line_id").collect()
    assert [r["normalized_input"] for r in rows] == ["blue harbor - night train", "ledokol | белый_шум часть 2", "", "salt and pepper"]
    assert rows[0]["normalization_steps"] == ["trimmed_outer_whitespace", "normalized_dash_characters", "removed_list_index_prefix", "lowercased_text", "collapsed_whitespace"]
    assert rows[1]["normalization_steps"] == ["lowercased_text", "removed_special_characters", "collapsed_whitespace"]
    assert rows[2]["normalization_steps"] == [] and rows[3]["normalization_steps"] == ["removed_control_characters", "collapsed_whitespace"]


def test_white_space_and_folding_follow_unicode(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert column(spark, [f"{c}x{c}" for c in chars], unicode.strip) == [f"{c}x{c}".strip() for c in chars]
    wide = [f"A{chr(c)}b" for c in range(1, 0x20000, 3) if not 0xD800 <= c < 0xE000]
    assert column(spark, wide, unicode.casefold) == [s.casefold() for s in wide]


def test_rounding_is_exact(spark):
    values = [0.90625, 0.87345, 0.00005, 0.00015, 1.0, 0.0]
    values += [0.35 * (a / 1e4) + 0.65 * (b / 1e4) for a in range(0, 10001, 97) for b in range(0, 10001, 89)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rounding.with_round4(df, "r", F.col("v")).collect():
        assert r["r"] == round(r["v"], 4)


def test_language(spark):
    rows = language.with_language(spark.createDataFrame([("кино",), ("kino",), ("ab вг",), ("123",), (None,)], "s string"), "s").collect()
    assert [(r["language"], r["language_confidence"]) for r in rows] == [("ru", 1.0), ("en", 1.0), ("mixed", 1.0), ("unknown", 0.0), ("unknown", 0.0)]
    with pytest.raises(ValueError):
        language.with_language(spark.range(1).withColumn("s", F.lit("")), "s", 0.9)


def test_transliteration(spark):
    assert column(spark, ["Щи да ёж, объём"], translit.to_latin) == ["shchi da yozh, obyom"]
    assert column(spark, ["tshch - jx", "Shchuka yo\nya"], translit.to_cyrillic) == ["цхч - джкс", "щука ё\nя"]


PARSES = [
    ("a - b", "artist_title", "a", "b", 0.9),
    ("b (a)", "title_artist_parenthesis", "a", "b", 0.82),
    ("b [a]", "title_artist_brackets", "a", "b", 0.82),
    ("b (feat. a)", "unknown", None, "b (feat. a)", 0.25),
    ("a - b (official video)", "artist_title", "a", "b", 0.9),
    ("a - b (live) [lyrics]", "artist_title", "a", "b", 0.9),
    ("just a title", "unknown", None, "just a title", 0.25),
    ("a: b - c", "artist_title", "a", "b - c", 0.9),
    ("(live) - x", "artist_title", "(live)", "x", 0.9),
    ("12. ", "unknown", None, None, 0.0),
]


def test_patterns(spark):
    rows = parsing.parse(lines.from_list(spark, [p[0] for p in PARSES])).orderBy("line_id").collect()
    assert [(r["raw_input"], r["pattern"], r["artist"], r["title"], r["confidence"]) for r in rows] == PARSES
    other = parsing.parse(lines.from_list(spark, ["b - a"]), "title_artist").first()
    assert (other["pattern"], other["artist"], other["title"], other["confidence"]) == ("title_artist", "a", "b", 0.78)
    with pytest.raises(ValueError):
        patterns.with_pattern(spark.range(1).withColumn("normalized_input", F.lit("")), order="x")


def test_blank_rules_differ(spark):
    df = lines.from_list(spark, ["01. ", " ", "x"])
    assert parsing.parse_lines(df).count() == 1 and parsing.drop_blank_raw(df).count() == 2


def test_match_normalisation(spark):
    given_, want = zip(("A_|/B (Official Video) [HD]", "a b"), ("Song lyrics  4K live", "song live"), ("straße remastered", "strasse"), ("hdx (karaoke)", "hdx (karaoke)"))
    assert column(spark, given_, text.match_normalize) == list(want)


def plain_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, left, used = max(max(len(a), len(b)) // 2 - 1, 0), [], set()
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_scores_match_plain_definitions(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("абвabcde ") for _ in range(random.randint(0, 12)))
    df = spark.createDataFrame([(word(), word()) for _ in range(400)], "a string, b string")
    by = {n: {(r["a"], r["b"]): (r["score"], r["distance"]) for r in f(df).collect()} for n, f in similarity.SCORERS.items()}
    for a, b in by["hybrid"]:
        d, longest = plain_levenshtein(a, b), max(len(a), len(b))
        lev = round(1 - d / longest, 4) if longest else 1.0
        j = plain_jaro(a, b)
        prefix = next((i for i in range(4) if i >= len(a) or i >= len(b) or a[i] != b[i]), 4)
        jw = j + prefix * 0.1 * (1 - j)
        mixed = round(lev * 0.35 + round(jw, 4) * 0.65, 4)
        assert by["levenshtein"][(a, b)] == (lev, d)
        assert by["jaro_winkler"][(a, b)] == (round(jw, 4), round((1 - jw) * 10000))
        assert by["hybrid"][(a, b)] == (mixed, round((1 - mixed) * 10000))
    with pytest.raises(ValueError):
        similarity.hybrid(df, 0.0, 0.0)


def test_variants(spark):
    rows = variants.with_variants(parsing.parse(lines.from_list(spark, ["Цой - Звезда", "x", "01. "]))).orderBy("line_id").collect()
    assert [(v["text"], v["source"]) for v in rows[0]["query_variants"]] == [
        ("цой - звезда", "parsed_fields"), ("кино - звезда", "artist_alias"), ("kino - звезда", "artist_alias"), ("kino - zvezda", "artist_alias"), ("tsoy - zvezda", "transliteration:cyrillic_to_latin"),
    ]
    assert [v["source"] for v in rows[1]["query_variants"]] == ["parsed_title", "transliteration:latin_to_cyrillic"]
    assert rows[2]["query_variants"] == []


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1. -—()[]#*•\t\x1f\xa0!ж"), max_size=14))
def test_normalise_matches_a_plain_definition(spark, raw):
    s = raw.strip()
    s = re.sub(r"[\x00-\x1f\x7f]", " ", s).translate({0x2014: "-"})
    s = re.sub(r"^\s*(?:\d{1,4}\s*[).\]:-]\s*|[#*]\s+|[•-]\s+)", "", s).lower()
    s = re.sub(r"\s+", " ", re.sub(r"[^\w\s\-:|()\[\]&'.,+/]", " ", s)).strip()
    assert spark.createDataFrame([(raw,)], "s string").select(text.normalize(F.col("s"))).first()[0] == s
