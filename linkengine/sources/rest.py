"""Candidates from search responses, saved as JSON or fetched by a data source."""

from __future__ import annotations

import base64
import html
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import materialize
from ..functions.unicode import strip

TRACK_PAYLOAD = "tracks struct<items: array<struct<id: string, name: string, artists: array<struct<name: string>>, external_urls: struct<spotify: string>>>>"
VIDEO_PAYLOAD = "items array<struct<id: struct<kind: string, videoId: string, channelId: string>, snippet: struct<title: string, channelTitle: string>>>"
#: Error codes by HTTP status, and of which requests a 400 has a code of its own (not of track searches).
ERROR_CODES = {400: "bad_request", 401: "unauthorized", 403: "forbidden", 429: "rate_limited"}
VIDEO_URL = "https://www.youtube.com/watch?v="


def tracks_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(query columns, cand_ord, track_id, artist, title, external_url) of track searches."""
    rows = payloads.withColumn("_p", F.from_json(payload, TRACK_PAYLOAD))
    rows = rows.select(*(c for c in payloads.columns if c != payload), F.posexplode("_p.tracks.items").alias("cand_ord", "t"))
    artist = F.array_join(F.filter(F.transform("t.artists", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), ", ")
    valid = F.col("t.id").isNotNull() & F.col("t.name").isNotNull()
    return rows.filter(valid).select(
        *(c for c in rows.columns if c != "t"),
        F.concat(F.lit("spotify:"), F.col("t.id")).alias("track_id"),
        F.nullif(artist, F.lit("")).alias("artist"),
        F.col("t.name").alias("title"),
        F.col("t.external_urls.spotify").alias("external_url"),
    )


def html_unescape(s: Column) -> Column:
    @F.pandas_udf("string")
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return F.when(s.contains("&"), unescape(s)).otherwise(s)


def videos_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Candidates of video searches: videos only, titles unescaped, no artist."""
    rows = payloads.withColumn("_p", F.from_json(payload, VIDEO_PAYLOAD))
    rows = rows.select(*(c for c in payloads.columns if c != payload), F.posexplode("_p.items").alias("cand_ord", "t"))
    rows = rows.filter((F.col("t.id.kind") == "youtube#video") & F.col("t.id.videoId").isNotNull() & F.col("t.snippet.title").isNotNull())
    return rows.select(
        *(c for c in rows.columns if c != "t"),
        F.concat(F.lit("youtube:"), F.col("t.id.videoId")).alias("track_id"),
        F.lit(None).cast("string").alias("artist"),
        html_unescape(F.col("t.snippet.title")).alias("title"),
        F.concat(F.lit(VIDEO_URL), F.col("t.id.videoId")).alias("external_url"),
    )


def error_code(status: int, bad_request: bool = True) -> str | None:
    """The code of a failed response; null for success. Without ``bad_request`` a 400 is a failed request like others."""
    if status < 400:
        return None
    if status == 400 and not bad_request:
        return "request_failed"
    return ERROR_CODES.get(status, "request_failed")


def with_retries(call: Callable[[], tuple[int, str]], retries: int = 2, base: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """(status, body) of ``call``; 429, 5xx and transport errors are tried again, the wait doubling."""
    for attempt in range(retries + 1):
        try:
            status, body = call()
            if status != 429 and status < 500 or attempt == retries:
                return status, body
        except OSError:
            if attempt == retries:
                raise
        sleep(base * 2**attempt)
    raise AssertionError("unreachable")


class Token:
    """A bearer token, kept until a minute before it expires (a second at least)."""

    def __init__(self, fetch: Callable[[], tuple[str, int]], clock: Callable[[], float] = time.monotonic):
        self._fetch, self._clock, self._value, self._until = fetch, clock, None, 0.0

    def get(self) -> str:
        if self._value is None or self._clock() >= self._until:
            self._value, seconds = self._fetch()
            self._until = self._clock() + max(1, seconds - 60)
        return self._value


def http(url: str, headers: dict[str, str], data: bytes | None = None, timeout: float = 10.0) -> tuple[int, str]:
    """(status, body); a failed status is an answer, a broken connection an ``OSError``."""
    request = urllib.request.Request(url, data=data, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


class TrackSearch:
    """Requests of the track service; the token is fetched once per worker and kept."""

    mapping = staticmethod(tracks_from_json)
    #: Its searches do not tell a bad request from other failures; its token requests do.
    bad_request = False

    def __init__(
        self, access_token: str | None = None, client_id: str | None = None, client_secret: str | None = None, market: str | None = None,
        url: str = "https://api.spotify.com/v1", accounts_url: str = "https://accounts.spotify.com",
    ):
        if not access_token and not (client_id and client_secret):
            raise ValueError("an access token or a client id and secret are needed")
        self.access_token, self.client_id, self.client_secret = access_token, client_id, client_secret
        self.market, self.url, self.accounts_url, self._token = market, url, accounts_url, None

    def _fetch_token(self) -> tuple[str, int]:
        secret = base64.b64encode(f"{self.client_id}:{self.client_secret}".encode()).decode()
        headers = {"Authorization": f"Basic {secret}", "Content-Type": "application/x-www-form-urlencoded"}
        status, body = with_retries(lambda: http(f"{self.accounts_url}/api/token", headers, b"grant_type=client_credentials"))
        if status >= 400:
            raise TokenRefused(status)
        answer = json.loads(body)
        return answer["access_token"], int(answer.get("expires_in", 3600))

    def __call__(self, query: str, limit: int) -> tuple[int, str]:
        if self.access_token is None and self._token is None:
            self._token = Token(self._fetch_token)
        token = self.access_token or self._token.get()
        params = {"q": query, "type": "track", "limit": limit} | ({"market": self.market} if self.market else {})
        return http(f"{self.url}/search?{urllib.parse.urlencode(params)}", {"Authorization": f"Bearer {token}"})


class VideoSearch:
    """Requests of the video service."""

    mapping = staticmethod(videos_from_json)
    bad_request = True

    def __init__(self, api_key: str, region_code: str | None = None, relevance_language: str | None = None, url: str = "https://www.googleapis.com/youtube/v3"):
        self.api_key, self.region_code, self.relevance_language, self.url = api_key, region_code, relevance_language, url

    def __call__(self, query: str, limit: int) -> tuple[int, str]:
        params = {"part": "snippet", "type": "video", "q": query, "maxResults": limit, "key": self.api_key}
        extra = {"regionCode": self.region_code, "relevanceLanguage": self.relevance_language}
        return http(f"{self.url}/search?{urllib.parse.urlencode(params | {k: v for k, v in extra.items() if v})}", {})


class TokenRefused(Exception):
    """The accounts service refused a token."""

    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


class SourceFailed(RuntimeError):
    """A source failed where partial results are not wanted."""

    def __init__(self, source: str, code: str):
        super().__init__(f"{source}: {code}")
        self.source, self.code = source, code


def answer(request: Callable[[str, int], tuple[int, str]], query: str, limit: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(payload, error code) of one query; one of them is null."""
    try:
        status, body = with_retries(lambda: request(query, limit), sleep=sleep)
    except OSError:
        return None, "request_failed"
    except TokenRefused as error:
        return None, error_code(error.status)
    code = error_code(status, getattr(request, "bad_request", True))
    if code is None:
        try:
            if not isinstance(json.loads(body), dict):
                code = "invalid_response"
        except ValueError:
            code = "invalid_response"
    return (None if code else body), code


def fetch(queries: DataFrame, request: Callable[[str, int], tuple[int, str]], limit: int = 10, sleep: Callable[[float], None] = time.sleep, parallel: int = 8) -> DataFrame:
    """(line_id, payload, error_code) of every distinct query's answer; blank queries are not sent.

    ``request`` goes to the workers, and at most ``parallel`` of them ask at once. Equal queries are asked once; what fails is a row with a
    code, so one query cannot fail the others. A lost executor asks its queries again.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    if parallel < 1:
        raise ValueError("parallel must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [answer(request, q, limit, sleep) for q in batch["query"]]
            yield pd.DataFrame({"query": batch["query"], "payload": [p for p, _ in got], "error_code": [c for _, c in got]})

    asked = queries.filter(strip(F.coalesce(F.col("query"), F.lit(""))) != "").select("line_id", "query")
    answers = asked.select("query").distinct().repartition(parallel, "query").mapInPandas(run, "query string, payload string, error_code string")
    return asked.join(materialize(answers, "answers"), "query").select("line_id", "payload", "error_code")


def search_services(queries: DataFrame, services: list[tuple[str, TrackSearch | VideoSearch]], limit: int = 10, allow_partial: bool = True, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(candidates, reports) of (line_id, query) from every service in order.

    Candidates are one row per (line, source, id), the first answer's; reports are
    (line_id, source, status, candidate_count, error_code). Without ``allow_partial`` the
    first failed source raises.
    """
    candidates = reports = None
    for i, (source, service) in enumerate(services):
        answers = fetch(queries, service, limit, sleep)
        if not allow_partial:
            failed = answers.filter("error_code IS NOT NULL").orderBy("line_id").first()
            if failed:
                raise SourceFailed(source, failed["error_code"])
        rows = service.mapping(answers.filter("error_code IS NULL").drop("error_code"))
        rows = rows.withColumns({"source": F.lit(source), "provider_ord": F.lit(i)})
        counts = rows.groupBy("line_id").agg(F.count("*").alias("n"))
        status = F.when(F.col("error_code").isNull(), "success").otherwise("failed")
        report = answers.join(counts, "line_id", "left")
        report = report.select("line_id", F.lit(source).alias("source"), status.alias("status"), F.coalesce("n", F.lit(0)).alias("candidate_count"), "error_code")
        first = rows.groupBy("line_id", "source", "track_id").agg(F.min_by(F.struct("artist", "title", "external_url", "provider_ord", "cand_ord"), "cand_ord").alias("c"))
        rows = first.select("line_id", "source", "track_id", "c.*")
        candidates = rows if candidates is None else candidates.unionByName(rows)
        reports = report if reports is None else reports.unionByName(report)
    if candidates is None:
        raise ValueError("at least one service is needed")
    return candidates, reports
