"""Sessions, lists and items as tables in one folder of any Hadoop file system.

A commit first writes its rows to new folders and then publishes one small file that
names every folder of every table. That file appears by a rename that does not overwrite, so
a commit is seen whole or not at all, and of two commits on one version the second fails.
Readers stay on the version they began with. Appending a list rewrites nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lists
from .lists import ITEM_SCHEMA, LIST_SCHEMA, SESSION_SCHEMA, NotFound

SCHEMAS = {"sessions": SESSION_SCHEMA, "lists": LIST_SCHEMA, "items": ITEM_SCHEMA}


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        fs, folder = self._fs(), self._hadoop("commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {name: [] for name in SCHEMAS}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:020d}.json", wholetext=True).first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        folders = self._folders(self.version() if version is None else version)[name]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, version: int, append: Mapping[str, DataFrame] | None = None, replace: Mapping[str, DataFrame] | None = None) -> int:
        """Publish the next version after ``version``: rows added to tables, or whole new tables."""
        folders = self._folders(version)
        for changes, old in ((append or {}, True), (replace or {}, False)):
            for name, rows in changes.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{self.path}/{folder}")
                folders[name] = [*(folders[name] if old else []), folder]
        self._publish(version + 1, json.dumps(folders))
        return version + 1

    def _publish(self, version: int, text: str) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, final = self._hadoop(f"commits/.{uuid.uuid4().hex}"), self._hadoop(f"commits/{version:020d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as error:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {version} is already there") from None
            raise

    # Sessions

    def create_session(self, display_name: str | None = None, at: datetime | None = None) -> str:
        session_id, at = str(uuid.uuid4()), at or datetime.now()
        row = self.spark.createDataFrame([(session_id, display_name, at, at)], SESSION_SCHEMA)
        self.commit(self.version(), append={"sessions": row})
        return session_id

    def session(self, session_id: str, version: int | None = None) -> DataFrame:
        return lists.found_or_raise(self.table("sessions", version).filter(F.col("id") == session_id), f"session {session_id}")

    def touch(self, session_id: str, at: datetime | None = None) -> DataFrame:
        """Set when a session was last seen; an unknown one is not found."""
        version = self.version()
        self.session(session_id, version)
        touches = self.spark.createDataFrame([(session_id, at or datetime.now())], "id string, ts timestamp")
        return self.session(session_id, self.commit(version, replace={"sessions": lists.touch(self.table("sessions", version), touches)}))

    # Lists

    def save(self, results: DataFrame, session_id: str, name: str | None = None, at: datetime | None = None) -> DataFrame:
        """Store the items of ``parse_and_match`` as one list; one row that sums it up."""
        if not session_id:
            raise ValueError("session_id must not be empty")
        playlist_id = str(uuid.uuid4())
        row = self.spark.createDataFrame([(playlist_id, session_id, name, at or datetime.now())], LIST_SCHEMA)
        items = lists.build_items(results.withColumn("playlist_id", F.lit(playlist_id)))
        return lists.summaries(*self.save_all(row, items)).filter(F.col("playlist_id") == playlist_id)

    def save_all(self, new_lists: DataFrame, new_items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Append many lists with their items in one commit; both tables as they are then."""
        version = self.commit(self.version(), append={"lists": new_lists, "items": new_items})
        return self.table("lists", version), self.table("items", version)

    def lists_of_session(self, session_id: str) -> DataFrame:
        return lists.lists_of_session(self.table("lists"), session_id)

    def list_with_items(self, playlist_id: str) -> DataFrame:
        version = self.version()
        items = self.table("items", version).filter(F.col("playlist_id") == playlist_id)
        return lists.with_items(lists.get_list(self.table("lists", version), playlist_id), items)

    def item(self, playlist_id: str, item_id: str) -> DataFrame:
        version = self.version()
        lists.get_list(self.table("lists", version), playlist_id)
        return lists.get_item(self.table("items", version), item_id, playlist_id)

    def rename(self, names: DataFrame) -> None:
        version = self.version()
        self.commit(version, replace={"lists": lists.rename_lists(self.table("lists", version), names)})

    def delete(self, gone: DataFrame) -> None:
        """Delete lists with their items, in one commit."""
        version = self.version()
        kept, items = lists.delete_lists(self.table("lists", version), self.table("items", version), gone)
        self.commit(version, replace={"lists": kept, "items": items})

    def delete_items(self, gone: DataFrame) -> None:
        version = self.version()
        self.commit(version, replace={"items": lists.delete_items(self.table("items", version), gone)})

    def review(self, reviews: DataFrame) -> None:
        version = self.version()
        self.commit(version, replace={"items": lists.apply_reviews(self.table("items", version), reviews)})


__all__ = ["Conflict", "NotFound", "Store"]
