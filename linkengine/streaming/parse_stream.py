"""Parsing and scoring of a stream of lines.

Parsing is stateless, so it runs on a stream as it is. Ranking needs row numbers, which
streams reject outside time windows; it therefore runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.parsing import parse_lines
from ..plans.link import parse_and_match


def parse_stream(lines: DataFrame, skip_blank: bool = True) -> DataFrame:
    """A stream of (line_id, raw_input) to a stream of parsed rows."""
    return parse_lines(lines, skip_blank)


def link_stream(lines: DataFrame, catalogs: list[tuple[str, DataFrame]], sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that links every micro-batch and hands its items to ``sink`` (items, batch id).
    Retried batches come with the same id, so an idempotent sink gets each line once."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        items, _ = parse_and_match(rows, catalogs, **options)
        sink(items, batch_id)

    return lines.writeStream.foreachBatch(batch)
