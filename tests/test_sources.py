"""The search source, the sink of list files and ranges of relational tables."""

import json
import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import pytest
from linkengine.operators import lists
from linkengine.sources import export, lines, list_files, rest, search_source
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


class Videos(BaseHTTPRequestHandler):
    """Answers video searches; ``bad`` is a bad request and ``odd`` no JSON."""

    seen: list[str] = []
    busy = most = 0
    lock = threading.Lock()

    def do_GET(self):
        query = parse_qs(urlparse(self.path).query)["q"][0]
        with self.lock:
            Videos.busy += 1
            Videos.most = max(Videos.most, Videos.busy)
            self.seen.append(query)
        body = json.dumps({"items": [{"id": {"kind": "youtube#video", "videoId": query[:1]}, "snippet": {"title": f"{query} &amp; more"}}]})
        threading.Event().wait(0.05)
        with self.lock:
            Videos.busy -= 1
        self.send_response(400 if query == "bad" else 200)
        self.end_headers()
        self.wfile.write(b"no json" if query == "odd" else body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def videos():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Videos)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Videos.seen.clear()
    Videos.most = 0
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def source(spark, **options):
    search_source.register(spark)
    return spark.read.format(search_source.NAME).options(**options).load()


def test_search_source_asks_queries_and_pushes_filters(spark, videos):
    rows = source(spark, service="videos", api_key="k", url=videos, queries='["one", "two", "one", " ", "bad", "odd"]', partitions="3")
    assert rows.rdd.getNumPartitions() == 3
    told = {r["query"]: (r["payload"] is not None, r["error_code"]) for r in rows.collect()}
    assert told == {"one": (True, None), "two": (True, None), "bad": (False, "bad_request"), "odd": (False, "invalid_response")}
    assert sorted(Videos.seen) == ["bad", "odd", "one", "two"]
    assert Videos.most <= 3
    Videos.seen.clear()
    assert [r["query"] for r in rows.filter("query = 'two' AND error_code IS NULL").collect()] == ["two"] and Videos.seen == ["two"]
    found = rest.videos_from_json(rows.filter(F.col("query").isin("one", "three")).drop("error_code")).collect()
    assert [(r["track_id"], r["title"]) for r in found] == [("youtube:o", "one & more")]


def test_search_source_in_sql(spark, videos):
    source(spark, service="videos", api_key="k", url=videos).createOrReplaceTempView("searches")
    rows = spark.sql("SELECT query, get_json_object(payload, '$.items[0].id.videoId') AS id FROM searches WHERE query IN ('ab', 'cd')").collect()
    assert sorted(map(tuple, rows)) == [("ab", "a"), ("cd", "c")]
    with pytest.raises(Exception, match="name the queries"):
        spark.sql("SELECT * FROM searches WHERE query LIKE 'a%'").collect()


@pytest.mark.parametrize("options", [{}, {"service": "nope"}, {"service": "videos", "api_key": "k", "limit": "51"}, {"service": "videos", "api_key": "k", "partitions": "0"}, {"service": "videos", "api_key": "k", "queries": "[1]"}, {"service": "tracks", "queries": "[]"}])
def test_search_source_refuses(spark, options):
    with pytest.raises(Exception):
        source(spark, **options).filter("query = 'a'").collect()


def test_saved_answers(spark, tmp_path):
    rows = [("a", '{"items": []}'), ("b", None), ("c", "[1]"), ("d", '{"items": []}')]
    spark.createDataFrame(rows, "query string, payload string").repartition(2).write.parquet(f"file://{tmp_path}/answers")
    got = source(spark, answers=f"file://{tmp_path}/answers")
    assert {r["query"]: r["error_code"] for r in got.collect()} == {"a": None, "b": "invalid_response", "c": "invalid_response", "d": None}
    assert [r["query"] for r in got.filter("query IN ('d', 'x')").collect()] == ["d"]
    (tmp_path / "none").mkdir()
    assert source(spark, answers=f"file://{tmp_path}/none").collect() == []


def test_error_codes_by_request():
    refused = rest.TrackSearch("token")
    answers = {(400, False): "request_failed", (400, True): "bad_request", (403, False): "forbidden", (500, True): "request_failed"}
    assert {k: rest.error_code(*k) for k in answers} == answers
    assert rest.answer(lambda q, n: (400, ""), "x", 1) == (None, "bad_request")
    refused.__class__ = type("Refusing", (rest.TrackSearch,), {"__call__": lambda self, q, n: (400, "")})
    assert rest.answer(refused, "x", 1) == (None, "request_failed")


def test_requests_at_once_are_bounded(spark, videos):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(24)], "line_id long, query string").repartition(12)
    got = rest.fetch(queries, rest.VideoSearch("k", url=videos), parallel=2)
    assert got.count() == 24 and len(Videos.seen) == 24 and Videos.most <= 2


def exported(spark, fmt):
    items = spark.createDataFrame(
        [(f"i{i}", f"p{i % 4}", i, "raw, x", None, f"T{i}", 0.5, None, None, None, None, None, True, None) for i in range(12)], lists.ITEM_SCHEMA
    )
    made = spark.createDataFrame([(f"p{i}", "s", None, None) for i in range(5)], lists.LIST_SCHEMA)
    list_files.register(spark)
    return export.export_lists(made, items, fmt)


@pytest.mark.parametrize("fmt", ["csv", "m3u", "json"])
def test_list_files_equal_the_export(spark, tmp_path, fmt):
    rows = exported(spark, fmt).repartition(3)
    rows.write.format(list_files.NAME).mode("append").save(f"file://{tmp_path}/out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {r["filename"]: r["content"] for r in rows.collect()}
    with pytest.raises(Exception, match="there already"):
        rows.write.format(list_files.NAME).mode("append").save(f"file://{tmp_path}/out")
    changed = rows.withColumn("content", F.lit(None).cast("string")).filter(f"filename = 'playlist-p1.{fmt}'")
    changed.write.format(list_files.NAME).mode("overwrite").save(f"file://{tmp_path}/out")
    assert (tmp_path / "out" / f"playlist-p1.{fmt}").read_text() == "" and len(list((tmp_path / "out").iterdir())) == 5


def visible(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("_"))


def test_a_failed_task_leaves_no_files(spark, tmp_path):
    rows = exported(spark, "csv").repartition(4, "filename")
    broken = rows.withColumn("content", F.when(F.col("filename") == "playlist-p3.csv", F.raise_error(F.lit("broken row"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format(list_files.NAME).mode("append").save(f"file://{tmp_path}/out")
    assert visible(tmp_path / "out") == []
    for wrong in ("a/b", "", "_hidden", ".x", None):
        with pytest.raises(Exception, match="plain file name"):
            rows.withColumn("filename", F.lit(wrong).cast("string")).write.format(list_files.NAME).mode("append").save(f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="share the file name"):
        rows.withColumn("filename", F.lit("same.csv")).repartition(4).write.format(list_files.NAME).mode("append").save(f"file://{tmp_path}/out")
    assert visible(tmp_path / "out") == []


def test_relational_tables_in_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    nulls = orders.limit(3).withColumn("o_orderkey", F.lit(None).cast("long"))
    orders.unionByName(nulls).write.format("jdbc").options(url=url, dbtable="orders", createTableColumnTypes="o_orderstatus VARCHAR(1)", **driver).save()
    read = lines.read_jdbc(spark, url, "orders", "o_orderkey", 4, **driver)
    assert read.rdd.getNumPartitions() == 4
    assert read.count() == orders.count() + 3 and read.filter("o_orderkey IS NULL").count() == 3
    expected = orders.select("o_orderkey", "o_custkey", "o_totalprice").collect()
    assert sorted(map(tuple, read.filter("o_orderkey IS NOT NULL").select("o_orderkey", "o_custkey", "o_totalprice").collect())) == sorted(map(tuple, expected))
    open_ = read.filter("o_orderstatus = 'O'").select("o_orderkey")
    plan = open_._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "numPartitions=4" in plan
    assert open_.count() == orders.filter("o_orderstatus = 'O'").count() + nulls.filter("o_orderstatus = 'O'").count()
    few = lines.read_jdbc(spark, url, "(SELECT * FROM orders WHERE 1 = 0) t", "o_orderkey", 4, **driver)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 0
    dates = lines.read_jdbc(spark, url, "orders", "o_orderdate", 3, **driver)
    assert dates.rdd.getNumPartitions() == 3 and dates.count() == orders.count() + 3


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from linkengine.sources import list_files, rest, search_source
from linkengine.plans import queries
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
assert queries.saved_searches(spark, {sf!r}).count() > 0 and queries.list_files(spark, {sf!r}).count() == 50
asked = spark.createDataFrame([(0, "x")], "line_id long, query string")
assert rest.fetch(asked, rest.TrackSearch("t", url="http://127.0.0.1:9"), sleep=lambda _: None).first()["error_code"] == "request_failed"
assert queries.queries()["hybrid_topk"](spark, {sf!r}).count() > 0
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    (tmp_path / "elsewhere").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = FOREIGN.format(repo=repo, shared=f"file://{tmp_path}/shared", sf=SF)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
