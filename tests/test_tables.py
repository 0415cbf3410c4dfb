"""Versions and layout of the catalog tables, limits on what is saved, counts in the same pass."""

from datetime import datetime

import pytest
from linkengine.operators import lists, stats, tables, validation
from pyspark.sql import Observation
from pyspark.sql import functions as F


@pytest.fixture
def database(spark, tmp_path):
    name = f"d{abs(hash(str(tmp_path)))}"
    spark.sql(f"CREATE DATABASE {name} LOCATION 'file://{tmp_path}/db'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def some_items(spark, n=40, k=7):
    rows = [(f"i{i}", f"p{i % k}", i // k, f"raw {i}", None, f"T{i}", 0.5, None, None, i / n, "hybrid" if i % 2 else "manual", "shop", i % 3 == 0, "{}") for i in range(n)]
    return spark.createDataFrame(rows, lists.ITEM_SCHEMA)


def some_lists(spark, k=8):
    return spark.createDataFrame([(f"p{i}", f"s{i % 2}", f"n{i}", datetime(2024, 1, 1 + i)) for i in range(k)], lists.LIST_SCHEMA)


def test_an_old_database_is_upgraded(spark, database):
    assert tables.version(spark, database) == 0
    assert tables.migrate(spark, database, 1, buckets=2) == 1
    old = some_items(spark).drop("match_external_url")
    tables.append(old, database, tables.ITEMS)
    with pytest.raises(ValueError, match="match_external_url"):
        tables.append(some_items(spark), database, tables.ITEMS)
    assert not spark.catalog.tableExists(f"{database}.{tables.SESSIONS}")
    assert tables.migrate(spark, database) == 3 == tables.version(spark, database)
    new = some_items(spark).withColumns({"item_id": F.concat(F.lit("new-"), F.col("item_id")), "match_external_url": F.lit("u")})
    tables.append(new, database, tables.ITEMS)
    read = spark.table(f"{database}.{tables.ITEMS}")
    assert set(read.columns) == set(some_items(spark).columns)
    urls = {r["item_id"]: r["match_external_url"] for r in read.collect()}
    assert len(urls) == 80 and all((u == "u") == k.startswith("new-") and (u is None or u == "u") for k, u in urls.items())
    kept = {tuple(r) for r in read.filter("NOT item_id LIKE 'new-%'").select(*old.columns).collect()}
    assert kept == {tuple(r) for r in old.collect()}
    assert [r["version"] for r in spark.table(f"{database}.{tables.VERSIONS}").orderBy("version").collect()] == [1, 2, 3]
    # Running it again changes nothing; there is no way back, and no version beyond the last.
    assert tables.migrate(spark, database) == 3 and spark.table(f"{database}.{tables.VERSIONS}").count() == 3
    for to in (1, 9):
        with pytest.raises(ValueError):
            tables.migrate(spark, database, to)


def test_a_step_that_was_not_recorded_runs_again(spark, database, monkeypatch):
    def broken(s, d, b):
        tables._third(s, d, b)
        raise RuntimeError("lost before it was recorded")

    steps = list(tables.STEPS)
    monkeypatch.setattr(tables, "STEPS", [*steps[:2], ("urls of matches", broken)])
    with pytest.raises(RuntimeError):
        tables.migrate(spark, database, buckets=2)
    assert tables.version(spark, database) == 2
    monkeypatch.setattr(tables, "STEPS", steps)
    assert tables.migrate(spark, database, buckets=2) == 3
    assert spark.table(f"{database}.{tables.ITEMS}").columns.count("match_external_url") == 1


def test_work_by_list_needs_no_exchange(spark, database):
    made = tables.save_by_list(some_lists(spark), f"{database}.by_list", 4)
    items = tables.save_by_list(some_items(spark), f"{database}.items_by_list", 4, ("playlist_id", "position"))
    gone = made.filter("session_id = 's1'")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, left = lists.delete_lists(made, items, gone)
        for frame in (stats.list_stats(items), lists.summaries(made, items), kept, left, lists.summaries(kept, left), lists.with_items(made, items)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SelectedBucketsCount" in plan
        assert {r["playlist_id"] for r in left.select("playlist_id").collect()} == {"p0", "p2", "p4", "p6"}
        plain = {tuple(map(str, r)) for r in stats.list_stats(some_items(spark)).collect()}
        assert {tuple(map(str, r)) for r in stats.list_stats(items).collect()} == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_limits_and_counts_in_one_pass(spark, tmp_path):
    good = some_items(spark, 10)
    bad = good.limit(1).select(*(F.col(c) for c in good.columns))
    wrong = [
        bad.withColumn("match_score", F.lit(1.5)), bad.withColumn("match_score", F.lit(float("nan"))), bad.withColumn("parsed_title", F.repeat(F.lit("x"), 256)),
        bad.withColumns({"raw_input": F.lit(""), "position": F.lit(-1)}), bad.withColumn("item_id", F.lit(None).cast("string")),
    ]
    rows = good
    for w in wrong:
        rows = rows.unionByName(w)
    edge = bad.withColumns({"parsed_title": F.repeat(F.lit("é"), 255), "match_score": F.lit(1.0), "match_algorithm": F.lit(None).cast("string")})
    rows = spark.createDataFrame(rows.unionByName(edge).collect(), lists.ITEM_SCHEMA)
    seen, counts = Observation(), Observation()
    jobs_before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    validation.counted(validation.checked(rows, seen), counts).write.parquet(f"file://{tmp_path}/saved")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs_before
    got = seen.get
    assert (got["total"], got["rejected"]) == (16, 5)
    assert {k: v for k, v in got.items() if v and k not in ("total", "rejected")} == {
        "match_score_out_of_range": 2, "parsed_title_too_long": 1, "raw_input_empty": 1, "position_negative": 1, "item_id_missing": 1,
    }
    assert counts.get == {"total": 11, "uncertain_count": sum(i % 3 == 0 for i in range(10)) + 1}
    assert jobs == 1 and spark.read.parquet(f"file://{tmp_path}/saved").count() == 11
    assert validation.checked(spark.range(3)).count() == 3


def test_names_of_new_lists(spark):
    asked = spark.createDataFrame([(1, "s", " Mine\t"), (2, "s", " \n"), (3, "s", None), (4, "s", "")], "playlist_id int, session_id string, name string")
    made = {r["playlist_id"]: r["name"] for r in lists.new_lists(asked).collect()}
    assert made == {"1": "Mine", "2": lists.DEFAULT_NAME, "3": lists.DEFAULT_NAME, "4": lists.DEFAULT_NAME}
    assert lists.new_lists(asked).schema.names == ["playlist_id", "session_id", "name", "created_at"]
