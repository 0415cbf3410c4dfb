"""Search services as a source that ``spark.read`` and SQL can name.

    register(spark)
    spark.read.format("linkengine_search").options(service="videos", api_key=..., queries='["a", "b"]').load()
    spark.sql("SELECT * FROM searches WHERE query IN ('a', 'b')")       -- over a view of the source

Rows are (query, payload, error_code), the payload as the service sent it; ``rest.tracks_from_json`` and
``rest.videos_from_json`` make candidates of them. What is asked is the option ``queries`` (a JSON array), what filters on ``query``
name (equality and IN are pushed down), or both, then only queries in both. Blank queries and repeats are not asked. Queries are dealt
to ``partitions`` partitions, each of which asks one at a time, so that is how many requests run at once. Tables of queries
belong in ``rest.fetch``.

``answers`` names a folder of saved answers instead, Parquet files of (query, payload), which are read a file per partition;
pushed filters reach the files. A saved answer of null, or one that is no JSON object, is an ``invalid_response``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import rest

NAME, SCHEMA = "linkengine_search", "query string, payload string, error_code string"
_SERVICES = {
    "tracks": (rest.TrackSearch, ["access_token", "client_id", "client_secret", "market", "url", "accounts_url"]),
    "videos": (rest.VideoSearch, ["api_key", "region_code", "relevance_language", "url"]),
}


@dataclass
class Asked(InputPartition):
    """Queries to ask, or a file of answers to read (all of it without queries)."""

    queries: tuple[str, ...] | None
    file: str | None = None


def _valid(body: str | None) -> bool:
    try:
        return isinstance(json.loads(body or ""), dict)
    except ValueError:
        return False


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service, self.answers = options.get("service"), options.get("answers")
        self.limit, self.count = int(options.get("limit", "10")), int(options.get("partitions", "4"))
        if not 1 <= self.limit <= 50:
            raise ValueError("limit must be between 1 and 50")
        if self.count < 1:
            raise ValueError("partitions must be at least 1")
        given = json.loads(options["queries"]) if "queries" in options else None
        if given is not None and not (isinstance(given, list) and all(isinstance(q, str) for q in given)):
            raise ValueError("queries must be a JSON array of strings")
        self.queries = None if given is None else tuple(dict.fromkeys(given))
        self.request = None
        if not self.answers:
            if self.service not in _SERVICES:
                raise ValueError(f"service must be one of {', '.join(_SERVICES)}, or answers a folder")
            kind, names = _SERVICES[self.service]
            self.request = kind(**{n: options[n] for n in names if n in options})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                wanted = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                wanted = tuple(dict.fromkeys(q for q in wanted if q is not None))
                self.queries = wanted if self.queries is None else tuple(q for q in self.queries if q in wanted)
            else:
                yield f

    def partitions(self) -> list[Asked]:
        if self.answers:
            from pyarrow import fs

            where, path = fs.FileSystem.from_uri(self.answers)
            files = where.get_file_info(fs.FileSelector(path, recursive=True))
            return [Asked(self.queries, f.path) for f in files if f.is_file and f.base_name.endswith(".parquet")] or [Asked(())]
        if self.queries is None:
            raise ValueError("name the queries, by the option queries or by a filter on query")
        asked = [q for q in self.queries if q.strip()]
        return [Asked(tuple(asked[i :: self.count])) for i in range(min(self.count, len(asked)))] or [Asked(())]

    def read(self, partition: Asked) -> Iterator[pa.RecordBatch]:
        names = ["query", "payload", "error_code"]
        if partition.file:
            from pyarrow import dataset, fs

            where, _ = fs.FileSystem.from_uri(self.answers)
            wanted = None if partition.queries is None else dataset.field("query").isin(list(partition.queries))
            for batch in dataset.dataset(partition.file, filesystem=where).to_batches(columns=["query", "payload"], filter=wanted):
                bodies = batch.column("payload").to_pylist()
                good = [_valid(b) for b in bodies]
                columns = [batch.column("query").cast(pa.string()), pa.array([b if ok else None for b, ok in zip(bodies, good)], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([None if ok else "invalid_response" for ok in good], pa.string())], names)
        else:
            for query in partition.queries:
                payload, code = rest.answer(self.request, query, self.limit)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (query, payload, code)], names)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
