"""Lines that repeat: each distinct text is worked on once, and nothing of the lines' size is broadcast."""

import pytest
from linkengine.functions import similarity, staging, text
from linkengine.operators import matching
from linkengine.plans import link
from linkengine.plans import queries as plans
from linkengine.sources import lines
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that the plan wrote, by label."""
    rows = {}

    def counted(df, label="table"):
        out = staging.materialize(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(link, "materialize", counted)
    return rows


def test_repeated_lines_are_linked_once_and_all_come_back(spark, written):
    texts = ["1. Blue Harbor - Night Train", "ледокол: белый шум", "zzz", "01. "]
    raw = spark.range(400).select((F.col("id") * 3).alias("line_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("raw_input"), F.col("id").alias("kept"))
    catalog = [("shop", lines.demo_catalog(spark))]
    items, matches = link.parse_and_match(raw.union(spark.createDataFrame([(-1, " ", 0), (-2, None, 0)], "line_id long, raw_input string, kept long")), catalog, 2)
    assert written["parsed"] == 4 and written["matches"] <= 8
    got = {r["line_id"]: r for r in items.collect()}
    assert sorted(got) == list(range(0, 1200, 3)) and items.columns[:3] == ["line_id", "raw_input", "kept"]
    assert all(r["kept"] * 3 == i and r["raw_input"] == texts[r["kept"] % 4] for i, r in got.items())
    alone, ranked = link.parse_and_match(lines.from_list(spark, texts), catalog, 2)
    want = {r["raw_input"]: r for r in alone.collect()}
    assert all(r[c] == want[r["raw_input"]][c] for r in got.values() for c in ("best", "best_score", "is_uncertain", "query_variants"))
    keys = ["rank", "source", "track_id", "score", "distance", "query_variant_source"]
    each = {i: sorted(tuple(r[c] for c in keys) for r in ranked.collect() if r["line_id"] == i) for i in range(4)}
    by_line = {}
    for r in matches.collect():
        by_line.setdefault(r["line_id"], []).append(tuple(r[c] for c in keys))
    assert all(sorted(by_line.get(i * 3, [])) == each[i % 4] for i in range(400))


@pytest.mark.parametrize("query", [plans.parse_and_match, plans.uncertain_summary])
def test_no_side_is_broadcast_by_the_size_of_its_files(spark, monkeypatch, query):
    # Files of few distinct values are small at any number of lines; only counts may prove a side small.
    monkeypatch.setattr(staging, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(matching, "is_small", lambda _: True)
    plan = plan_of(query(spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_filter_scores_each_distinct_pair_once(spark, monkeypatch):
    rows = plans.part_lines(spark, SF).select("line_id", "raw_input", "p_name")
    many = rows.crossJoin(spark.range(5).select("id")).withColumn("line_id", F.col("line_id") * 5 + F.col("id")).drop("id")
    seen, first = [], staging.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, label: seen.append(first(df, label)) or seen[-1])
    got = plans.similar_fields(many, "raw_input", "p_name", 0.7)
    score = similarity.jaro_winkler_score(text.match_normalize(F.col("raw_input")), text.match_normalize(F.col("p_name")))
    want = {r["line_id"]: r["score"] for r in rows.select("line_id", score.alias("score")).collect() if r["score"] >= 0.7}
    assert {r["line_id"]: r["score"] for r in got.collect()} == {i * 5 + k: s for i, s in want.items() for k in range(5)}
    assert seen[0].count() == got.select("raw_input", "p_name").distinct().count() < got.count()


def test_the_summary_weighs_distinct_texts_and_never_meets_the_lines_again(spark, written):
    texts = ["1. Blue Harbor - Night Train", "ледокол: белый шум", "zzz", "01. "]
    some = spark.createDataFrame([(i, texts[min(i % 7, 3)]) for i in range(400)] + [(-1, " "), (-2, None)], "line_id long, raw_input string")
    catalog = [("shop", lines.demo_catalog(spark))]
    want = link.summarize(link.parse_and_match(some, catalog, 2)[0]).first()
    written.clear()
    got = link.count_uncertain(some, catalog, 2)
    assert got.first() == want and want["total"] == 400 and 0 < want["uncertain_count"] < 400
    # Only what distinct texts gave is written; no table has a row for each line.
    assert set(written) == {"parsed", "found", "matches"} and written["parsed"] == 4 and written["matches"] <= 8
    assert link.count_uncertain(some.filter("line_id < 0"), catalog, 2).first() == (0, 0)
    assert got.schema.simpleString() == "struct<total:bigint,uncertain_count:bigint>"


def test_the_summary_query_counts_by_text(spark, written):
    assert plans.uncertain_summary(spark, SF).first()["total"] == plans.part_lines(spark, SF).count()
    assert set(written) == {"parsed", "found", "matches"}
