import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from linkengine.operators import lists, parsing
from linkengine.operators.store import Conflict, Store
from linkengine.plans import link
from linkengine.sources import export, lines, rest, settings
from pyspark.sql import functions as F

CATALOG = "track_id string, artist string, title string, external_url string, cand_ord int"


@pytest.fixture
def catalog(spark):
    return [("shop", spark.createDataFrame([("c1", "Blue Harbor", "Night Train", "u1", 0)], CATALOG))]


def test_store_keeps_lists(spark, catalog, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.table("lists").count() == 0
    owner = store.create_session("Kim", datetime(2024, 1, 1))
    assert store.session(owner).first()["display_name"] == "Kim"
    assert store.touch(owner, datetime(2024, 2, 1)).first()["last_seen_at"] == datetime(2024, 2, 1)
    items, _ = link.parse_and_match(lines.from_list(spark, ["Blue Harbor - Night Train", "zzz"]), catalog)
    total = store.save(items, owner, None, datetime(2024, 3, 1)).first()
    assert (total["name"], total["total_items"], total["uncertain_count"]) == (None, 2, 1)
    second = store.save(items, owner, "B", datetime(2024, 4, 1)).first()["playlist_id"]
    key = total["playlist_id"]
    assert [r["playlist_id"] for r in store.lists_of_session(owner).collect()] == [second, key]
    nested = store.list_with_items(key).first()["items"]
    assert [i["position"] for i in nested] == [0, 1]
    found = store.item(key, nested[0]["item_id"]).first()
    meta = json.loads(found["metadata_json"])
    assert found["match_track_id"] == "c1" and list(meta["parsed_track"]) == lists.PARSED_FIELDS and meta["source_reports"] == []
    for call in (lambda: store.item(second, nested[0]["item_id"]), lambda: store.list_with_items("no"), lambda: store.session("no"), lambda: store.touch("no")):
        with pytest.raises(lists.NotFound):
            call()
    with pytest.raises(ValueError):
        store.save(items, "", None)
    store.rename(spark.createDataFrame([(key, "C")], "playlist_id string, name string"))
    before = store.version()
    store.delete(spark.createDataFrame([(second,)], "playlist_id string"))
    assert [r["name"] for r in store.table("lists").collect()] == ["C"] and store.table("items").count() == 2
    assert store.table("items", before).count() == 4


def test_store_refuses_a_second_commit_on_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    at = store.version()
    rows = spark.createDataFrame([("p", "s", "N", datetime(2024, 1, 1))], lists.LIST_SCHEMA)
    store.commit(at, append={"lists": rows})
    with pytest.raises(Conflict):
        store.commit(at, append={"lists": rows})
    assert store.table("lists").count() == 1 and store.version() == 1
    assert [p.name for p in (tmp_path / "store/commits").glob("*.json")] == [f"{1:020d}.json"]


def test_settings():
    s = settings.Settings.from_env({"LINKENGINE_CONFIDENCE_THRESHOLD": "0.5", "LINKENGINE_ENABLE_DEMO_PROVIDER": "off", "LINKENGINE_YOUTUBE_API_KEY": "k", "OTHER": "x"})
    assert (s.confidence_threshold, s.enable_demo_provider, s.environment) == (0.5, False, "development")
    assert settings.catalogs(None, s) == [] and [n for n, _ in settings.searches(s)] == ["youtube"]
    assert [n for n, _ in settings.searches(settings.Settings(spotify_client_id="a"))] == []
    assert [n for n, _ in settings.searches(settings.Settings(spotify_client_id="a", spotify_client_secret="b", youtube_api_key="k"))] == ["spotify", "youtube"]
    for wrong in ({"LINKENGINE_CONFIDENCE_THRESHOLD": "1.5"}, {"LINKENGINE_ENABLE_DEMO_PROVIDER": "perhaps"}):
        with pytest.raises(ValueError):
            settings.Settings.from_env(wrong)


class Service(BaseHTTPRequestHandler):
    """Answers track searches; ``fails`` is refused, ``flaky`` works the second time."""

    seen: list[str] = []

    def _answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        self.seen.append("token")
        self._answer(200, {"access_token": "secret", "expires_in": 3600})

    def do_GET(self):
        query = parse_qs(urlparse(self.path).query)["q"][0]
        self.seen.append(query)
        if self.headers["Authorization"] != "Bearer secret" or "fails" in query:
            return self._answer(403, {})
        if "flaky" in query and self.seen.count(query) < 2:
            return self._answer(503, {})
        track = {"id": "1", "name": query.title(), "artists": [], "external_urls": {"spotify": "u"}}
        return self._answer(200, {"tracks": {"items": [track, track]}})

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen.clear()
    url = f"http://127.0.0.1:{server.server_port}"
    yield rest.TrackSearch(client_id="a", client_secret="b", url=url, accounts_url=url)
    server.shutdown()


def test_services_are_searched_and_reported(spark, catalog, service):
    queries = spark.createDataFrame([(0, "one"), (1, "fails"), (2, "flaky"), (3, " "), (4, "one"), (5, None)], "line_id long, query string")
    found, reports = rest.search_services(queries, [("spotify", service)], sleep=lambda _: None)
    assert sorted((r["line_id"], r["track_id"], r["title"]) for r in found.collect()) == [(0, "spotify:1", "One"), (2, "spotify:1", "Flaky"), (4, "spotify:1", "One")]
    told = {r["line_id"]: (r["status"], r["candidate_count"], r["error_code"]) for r in reports.collect()}
    assert told == {0: ("success", 2, None), 1: ("failed", 0, "forbidden"), 2: ("success", 2, None), 4: ("success", 2, None)}
    assert Service.seen.count("one") == 1
    with pytest.raises(rest.SourceFailed):
        rest.search_services(queries, [("spotify", service)], allow_partial=False, sleep=lambda _: None)
    with pytest.raises(ValueError):
        rest.fetch(queries, service, 51)
    items, matches = link.parse_and_match(lines.from_list(spark, ["Blue Harbor - Night Train", "fails"]), catalog, services=[("spotify", service)])
    got = {r["line_id"]: r for r in items.collect()}
    assert [(r["source"], r["status"], r["error_code"]) for r in got[1]["source_reports"]] == [("shop", "success", None), ("spotify", "failed", "forbidden")]
    assert {r["source"] for r in matches.filter("line_id = 0").collect()} == {"shop", "spotify"}
    meta = json.loads(lists.build_items(items.withColumn("playlist_id", F.lit("p"))).filter("position = 1").first()["metadata_json"])
    assert meta["source_reports"][1]["error_code"] == "forbidden"


def test_an_unreachable_service_is_a_failed_source(spark):
    closed = rest.TrackSearch("t", url="http://127.0.0.1:9")
    rows = rest.fetch(spark.createDataFrame([(0, "x")], "line_id long, query string"), closed, sleep=lambda _: None).collect()
    assert [(r["payload"], r["error_code"]) for r in rows] == [(None, "request_failed")]


def test_json_lines_name_the_wrong_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"query":"a"}\n\n{"query":"b"}\n{nope\n')
    with pytest.raises(ValueError, match="Invalid JSON on line 4"):
        lines.read_labelled_queries(spark, str(path))
    path.write_text('{"query":"a"}\n[1]\n')
    with pytest.raises(ValueError, match="object on line 2"):
        lines.read_labelled_queries(spark, str(path))
    path.write_text('{"query":"a","expected_track_id":"t"}\n \n')
    assert [tuple(r) for r in lines.read_labelled_queries(spark, str(path)).collect()] == [("a", "t", None)]


def test_detector_keeps_case_and_names_count(spark):
    row = parsing.detect(lines.from_list(spark, ["3) Blue Harbor — Night TRAIN (live)"])).first()
    assert (row["artist"], row["title"]) == ("Blue Harbor", "Night TRAIN")
    some = [("i1", "p", 0, "r", "A/B", "C", "https://youtu.be/1"), ("i2", "p", 1, "r", None, "D", "https://x"), ("i3", "p", 2, "raw?", "A", None, "https://youtube.com/2")]
    items = spark.createDataFrame(some, "item_id string, playlist_id string, position int, raw_input string, parsed_artist string, parsed_title string, match_external_url string")
    assert [r["filename"] for r in export.download_names(items).orderBy("ordinal").collect()] == ["01 - AB - C", "02 - raw"]
