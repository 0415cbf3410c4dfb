import json

import pytest
from linkengine.operators import evaluation, lists, matching, stats
from linkengine.plans import link
from linkengine.sources import export, lines, rest
from linkengine.streaming.parse_stream import link_stream, parse_stream
from pyspark.sql import functions as F

CATALOG = "track_id string, artist string, title string, external_url string, cand_ord int"


@pytest.fixture(scope="module")
def catalogs(spark):
    shop = [("c1", "Blue Harbor", "Night Train", "u1", 0), ("c2", "Blue Harbor", "Night Trains", None, 1), ("c4", "Ледокол", "Белый шум", None, 2), ("c5", "Ledokol", "Belyy Shum", None, 3), ("c1", "Blue Harbor", "Night Train", "u1", 4)]
    video = [("c3", None, "Blue Harbor - Night Train (Official Video) [HD]", None, 0)]
    return [("shop", spark.createDataFrame(shop, CATALOG)), ("video", spark.createDataFrame(video, CATALOG))]


def test_parse_and_match(spark, catalogs):
    raw = lines.from_list(spark, ["1. Blue Harbor — Night Train", "ледокол: белый шум", "completely different", " ", "01. "])
    items, matches = link.parse_and_match(raw, catalogs, 3)
    got = {r["line_id"]: r for r in items.collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert (got[0]["best"]["track_id"], got[0]["best_score"], got[0]["is_uncertain"]) == ("c3", 1.0, False)
    assert got[1]["best"]["track_id"] == "c4" and got[2]["is_uncertain"] and got[4]["best"] is None and got[4]["best_score"] == 0.0
    ranked = matches.filter("line_id = 0").orderBy("rank").collect()
    assert len({(r["source"], r["track_id"]) for r in ranked}) == len(ranked) == 3
    assert {r["track_id"] for r in ranked[:2]} == {"c1", "c3"} and ranked[1]["score"] == 1.0
    total = link.summarize(items).first()
    assert (total["total"], total["uncertain_count"]) == (4, 2)
    for bad in ({"threshold": 1.5}, {"match_limit": 0}):
        with pytest.raises(ValueError):
            link.parse_and_match(raw, catalogs, **bad)


def test_search_keeps_one_row_per_id_and_reports_zero(spark, catalogs):
    asked = spark.createDataFrame([(0, "blue harbor - night train"), (1, " "), (2, None)], "line_id long, query string")
    found = matching.search(asked, catalogs, 5)
    assert found.count() == 5 and found.select("line_id").distinct().count() == 1
    report = {r["source"]: (r["status"], r["candidate_count"]) for r in matching.source_reports(asked, found, ["shop", "video", "gone"], {"gone": "forbidden"}).collect()}
    assert report == {"shop": ("success", 4), "video": ("success", 1), "gone": ("failed", 0)}
    with pytest.raises(ValueError):
        matching.rank(asked, matching.union_catalogs(catalogs), "nope")


def test_large_catalogs_are_not_broadcast(spark, catalogs, monkeypatch):
    asked = spark.createDataFrame([(0, "night train")], "line_id long, query string")
    candidates = matching.union_catalogs(catalogs)
    want = sorted((r["source"], r["track_id"], r["rank"]) for r in matching.rank(asked, candidates, k=4).collect())
    monkeypatch.setattr(matching, "is_small", lambda df: False)
    assert sorted((r["source"], r["track_id"], r["rank"]) for r in matching.rank(asked, candidates, k=4).collect()) == want


def test_evaluation(spark, catalogs):
    labelled = spark.createDataFrame([("A - B", "a", "b", "artist_title", None), ("C", "x", "c", "unknown", None)], lines.LABELLED_LINE_SCHEMA)
    row = evaluation.evaluate_parser(labelled).first()
    assert (row["total"], row["artist_accuracy"], row["title_accuracy"], row["exact_accuracy"]) == (2, 0.5, 1.0, 0.5)
    assert tuple(evaluation.evaluate_parser(labelled.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    queries = spark.createDataFrame([(0, "blue harbor - night train", "c1"), (1, "ledokol - belyy shum", "c5")], "line_id long, query string, expected_track_id string")
    rows = evaluation.compare_matchers(queries, catalogs, 3).collect()
    assert [r["algorithm"] for r in rows] == ["hybrid", "jaro_winkler", "levenshtein"]
    assert all(r["top_k_accuracy"] == 1.0 and r["ambiguous_count"] >= 1 for r in rows)


@pytest.fixture
def tables(spark):
    some = [("i1", "p1", 0, "raw, \"x\"", "A", "B", 0.9, "t1", "http://u", 1.0, "hybrid", "shop", False, '{"parsed_track":{"a":1},"n":"q\\"x"}'), ("i2", "p1", 1, "raw2", "", None, 0.0005, None, "", None, None, None, True, None)]
    owners = spark.createDataFrame([("p1", "s", "N"), ("p2", "s", None)], "playlist_id string, session_id string, name string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    return owners, spark.createDataFrame(some, lists.ITEM_SCHEMA)


def test_stats(tables):
    row = stats.list_stats(tables[1]).first()
    assert (row["total_items"], row["uncertain_items"], row["confirmed_items"], row["avg_match_score"], row["uncertain_positions"]) == (2, 1, 1, 1.0, [1])
    assert row["source_counts"] == {"shop": 1} and row["algorithm_counts"] == {"hybrid": 1}


def test_exports(tables):
    text = {f: {r["playlist_id"]: r["content"] for r in export.export_lists(*tables, f).collect()} for f in ("csv", "m3u", "json")}
    header = ",".join(export.CSV_COLUMNS)
    assert text["csv"]["p1"] == f'{header}\n0,"raw, ""x""",A,B,0.9,t1,http://u,1.0,hybrid,shop,False\n1,raw2,,,0.0005,,,,,,True\n'
    assert text["csv"]["p2"] == header + "\n" and text["m3u"]["p2"] == "#EXTM3U\n"
    assert text["m3u"]["p1"] == "#EXTM3U\n#EXTINF:-1,A - B\nhttp://u\n#EXTINF:-1,raw2\nraw2\n"
    body = json.loads(text["json"]["p1"])
    assert body["total_items"] == 2 and body["items"][1]["match_score"] is None and body["items"][0]["raw_input"] == 'raw, "x"'
    with pytest.raises(ValueError):
        export.export_lists(*tables, "xml")


def test_changes(spark, tables):
    owners, items = tables
    renamed = lists.rename_lists(owners, spark.createDataFrame([("p1", None)], "playlist_id string, name string"))
    assert {r["playlist_id"]: r["name"] for r in renamed.collect()} == {"p1": None, "p2": None}
    kept, left = lists.delete_lists(owners, items, owners.filter("playlist_id = 'p1'"))
    assert kept.count() == 1 and left.count() == 0
    assert [r["position"] for r in lists.delete_items(items, items.filter("position = 0")).collect()] == [1]
    review = spark.createDataFrame([("i1", "p1", "m", None, 0.7, None, None, None), ("i2", "p1", " ", None, None, None, None, None)], "item_id string, playlist_id string, match_track_id string, match_external_url string, match_score double, match_algorithm string, source string, is_uncertain boolean")
    done = {r["item_id"]: r for r in lists.apply_reviews(items, review).collect()}
    assert (done["i1"]["match_track_id"], done["i1"]["match_score"], done["i1"]["match_algorithm"], done["i1"]["is_uncertain"]) == ("m", 0.7, "manual", False)
    assert (done["i2"]["match_track_id"], done["i2"]["match_score"]) == ("manual:i2", 0.99)
    meta = json.loads(done["i1"]["metadata_json"])
    assert meta["parsed_track"] == {"a": 1} and meta["n"] == 'q"x' and meta["manual_review"]["match_track_id"] == "m"
    with pytest.raises(lists.NotFound):
        lists.get_list(owners, "p9")
    nested = {r["playlist_id"]: r["items"] for r in lists.with_items(owners, items).collect()}
    assert [i["position"] for i in nested["p1"]] == [0, 1] and nested["p2"] is None


def test_review_keeps_the_types_of_metadata(spark):
    fields = "match_track_id string, match_external_url string, match_score double, match_algorithm string, source string, is_uncertain boolean"
    meta = ['{"date":"2024-01-01","n":"12","t":"true","b":"[x]","f":1.5,"z":null,"o":{"a":[1,"2",null],"q":"x\\"y"},"manual_review":{"x":1}}', None, "{}", "broken"]
    items = spark.createDataFrame([(f"i{k}", "p", None, None, None, None, None, True, m) for k, m in enumerate(meta)], f"item_id string, playlist_id string, {fields}, metadata_json string")
    reviews = spark.createDataFrame([(f"i{k}", "p", "m", None, 0.5, None, None, None) for k in range(4)], f"item_id string, playlist_id string, {fields}")
    got = {r["item_id"]: json.loads(r["metadata_json"]) for r in lists.apply_reviews(items, reviews).collect()}
    review = {"match_track_id": "m", "match_external_url": None, "match_score": 0.5, "match_algorithm": "manual", "source": "manual", "is_uncertain": False}
    kept = {k: v for k, v in json.loads(meta[0]).items() if k != "manual_review"}
    assert got["i0"] == kept | {"manual_review": review}
    assert got["i1"] == got["i2"] == {"manual_review": review}
    # What is no JSON object is kept as it was.
    assert got["i3"] == {"manual_review": review | {"replaced_metadata": "broken"}}


def test_build_items(spark, catalogs):
    items, _ = link.parse_and_match(lines.from_list(spark, ["zzz", " ", "Blue Harbor - Night Train"]), catalogs)
    rows = lists.build_items(items.withColumn("playlist_id", F.lit("p"))).orderBy("position").collect()
    assert [(r["position"], r["raw_input"]) for r in rows] == [(0, "zzz"), (1, "Blue Harbor - Night Train")]
    assert json.loads(rows[1]["metadata_json"])["parsed_track"]["artist"] == "blue harbor"


def test_rest_payloads(spark):
    tracks = '{"tracks":{"items":[{"id":"1","name":"N","artists":[{"name":"A"},{"name":"B"}],"external_urls":{"spotify":"u"}},{"id":"2","name":"M","artists":[]}]}}'
    videos = '{"items":[{"id":{"kind":"youtube#video","videoId":"v"},"snippet":{"title":"A &amp; B"}},{"id":{"kind":"youtube#channel","channelId":"c"},"snippet":{"title":"C"}}]}'
    df = spark.createDataFrame([(1, tracks, videos)], "q int, t string, v string")
    got = [tuple(r) for r in rest.tracks_from_json(df.drop("v"), "t").select("track_id", "artist", "title", "external_url").collect()]
    assert got == [("spotify:1", "A, B", "N", "u"), ("spotify:2", None, "M", None)]
    assert [(r["track_id"], r["title"]) for r in rest.videos_from_json(df.drop("t"), "v").collect()] == [("youtube:v", "A & B")]
    answers, waits = iter([(500, ""), (429, ""), (200, "ok")]), []
    assert rest.with_retries(lambda: next(answers), sleep=waits.append) == (200, "ok") and waits == [0.25, 0.5]
    now, calls = [0.0], []
    token = rest.Token(lambda: (calls.append(1) or f"t{len(calls)}", 100), clock=lambda: now[0])
    assert token.get() == token.get() == "t1"
    now[0] = 41.0
    assert token.get() == "t2"


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"track_id":"1","title":"T","source":"s"}\n\n{"track_id":"2","title":"U","source":"s","artist":"A"}\n')
    assert lines.read_catalog(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):  # noqa: B017  the reader's own error type
        lines.read_catalog(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        lines.from_list(spark, [])
    split = lines.split_text(spark.createDataFrame([(1, " a \n\n b")], "doc_id int, text string")).collect()
    assert [(r["line_id"], r["raw_input"]) for r in split] == [(0, "a"), (2, "b")]
    assert lines.demo_catalog(spark).count() == 4


def test_streams(spark, catalogs, tmp_path):
    source = tmp_path / "in"
    lines.from_list(spark, ["Blue Harbor - Night Train", " "]).write.json(str(source))
    stream = spark.readStream.schema("line_id long, raw_input string").json(str(source))
    query = parse_stream(stream).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("parsed").count() == 1
    seen = []
    query = link_stream(stream, catalogs, lambda items, i: seen.extend(items.select("line_id", "best_score").collect())).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert [tuple(r) for r in seen] == [(0, 1.0)]


def test_repeated_changes_count_once(spark, tables):
    lists_, items = tables
    names = spark.createDataFrame([("p1", "old", 1), ("p1", None, 2), ("p1", None, 2), (None, "x", 9)], "playlist_id string, name string, changed_at int")
    renamed = lists.rename_lists(lists_, names)
    assert renamed.count() == lists_.count() and renamed.filter("playlist_id = 'p1'").first()["name"] is None
    # Without an order the greatest row counts.
    assert lists.rename_lists(lists_, names.drop("changed_at")).filter("playlist_id = 'p1'").collect()[0]["name"] == "old"
    fields = "item_id string, playlist_id string, match_track_id string, match_external_url string, match_score double, match_algorithm string, source string, is_uncertain boolean, changed_at int"
    reviews = spark.createDataFrame([("i1", "p1", "late", None, None, None, None, None, 5), ("i1", "p1", "zz", "u", 0.9, None, None, True, 4), ("i1", "p1", "late", None, None, None, None, None, 5)], fields)
    done = lists.apply_reviews(items, reviews)
    row = done.filter("item_id = 'i1'").collect()
    assert done.count() == items.count() and len(row) == 1
    assert (row[0]["match_track_id"], row[0]["match_external_url"], row[0]["match_score"], row[0]["is_uncertain"]) == ("late", None, 0.99, False)


def test_review_keeps_null_members_and_odd_metadata(spark, tables):
    import json

    _, items = tables
    fields = "item_id string, playlist_id string, match_track_id string, match_external_url string, match_score double, match_algorithm string, source string, is_uncertain boolean"
    review = spark.createDataFrame([("i1", "p1", "m", None, None, None, None, None)], fields)
    for before, kept, replaced in [('{"a": 1}', {"a": 1}, None), ("no json", {}, "no json"), ("[1, 2]", {}, "[1, 2]"), (None, {}, None)]:
        rows = items.withColumn("metadata_json", F.lit(before).cast("string"))
        meta = json.loads(lists.apply_reviews(rows, review).filter("item_id = 'i1'").first()["metadata_json"])
        told = meta.pop("manual_review")
        assert meta == kept and told["match_external_url"] is None and "match_external_url" in told and told.get("replaced_metadata") == replaced
