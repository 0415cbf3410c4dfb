"""Line deduplication with a log-template tree.

Lines are parsed at a fixed depth: fields with digits become ``<*>``, and the token
count with the leading ``DEPTH`` tokens names a leaf. In a leaf the line found in most
documents is the first leader; lines that agree with it in most of the remaining positions
share its template, in which the positions that differ are variable fields. The same is
repeated on the rest of the leaf until every line has a leader or leads. A template that recurs across documents is dropped from
all of them but those with its least document id.

A template recurs from ``MIN_DOCS`` documents on. Counts are over documents, so lines
repeated inside one document alone stay.

A passage recurs from two documents on: a line, or a run of equal lines in the same order (blank
lines between them do not count), that holds ``LONG_TOKENS`` or more tokens. It stays in
the least document id. Runs are found by their shortest windows of that many tokens from
each line on and up to each line, which cover every such run and are equal wherever it
stands. A text equal line by line to one of a lesser id loses all its lines as soon as it
loses one, so no fragment of a copy stays.

Only digests of 128 bits of lines and runs are exchanged, except for the lines of leaves
that hold several different lines; two texts of one digest are not to be expected at any
corpus size. Leaves and templates are aggregated before they meet. A leaf's distinct
lines pass through one task in order, which holds its leaders; a leaf of more than
``LEAF_LINES`` is read in parts first, whose leaders are grouped the same way, so that a line there shares
the template of its part's leader. A line is compared with the leaders listed under its rarest
tokens only. Texts are rewritten by line position, in time linear in their lines.

Cases: null texts stay null; blank lines stay. Repeated rows (id and text equal) are one
document and are treated alike. Rows without an id never count as the least document and
keep lines only found in such rows. Of lines found in equally many documents the one of the larger
digest leads. A text of recurring lines only becomes empty; its row stays. Very long texts are
read whole. An empty table gives an empty result. Other columns pass through, whatever their names;
``n_lines`` and ``n_dropped`` replace columns of the same name, or are named otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, lookup_join, materialize, remaining, row_key, unpacked

DEPTH = 4
#: Share of the positions beyond the leading tokens in which a line must equal its leader.
AGREE = 0.6
MIN_DOCS = 3
#: Lines of a leaf, or of a part of one, that one task reads.
LEAF_LINES = 1 << 16
LONG_TOKENS = 50
_BASES = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)
_FIELD = r"(?<!\S)[^\s\d]*+\d\S*"


def masked(line: Column) -> Column:
    """A line with its outer white space gone and its fields with digits generalised."""
    line = F.btrim(line, F.lit(" \t\r\f\v"))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def _template(mask: Column) -> Column:
    """The digest that stands for a masked line."""
    return F.unhex(F.md5(mask.cast("binary")))


def _lines(documents: DataFrame, text: str) -> DataFrame:
    """(_id, _th, mask) of every line that is not blank."""
    # The mask comes out of the generator, so the filters and keys above never repeat it.
    masks = F.explode(F.transform(F.split(F.col(text), "\n"), masked)).alias("mask")
    return documents.select(*row_key("doc_id", text), masks).filter("mask <> ''")


def _parsed(lines: DataFrame) -> DataFrame:
    """Add (n, leaf, tpl): token count, leaf of the tree and the line's own template."""
    n = F.octet_length("mask") - F.octet_length(F.replace("mask", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n)
    leaf = F.xxhash64("n", F.substring_index("mask", " ", DEPTH))
    return lines.withColumns({"leaf": leaf, "tpl": _template(F.col("mask"))})


class _Leaders:
    """The leaders of one leaf in order, listed under their tokens at each position."""

    def __init__(self) -> None:
        self.lines: list[tuple[bytes, list[str]]] = []
        self.led: set[int] = set()
        self.lists: dict[tuple, list[dict[str, list[int]]]] = {}

    def join(self, tpl: bytes, lead: tuple[str, ...], tokens: list[str]) -> int | None:
        """The first leader the line agrees with; without one the line leads."""
        k = len(tokens)
        wanted = math.ceil(AGREE * k)
        # Two leaves of one hash never mix, since the lead is part of what is compared.
        lists = self.lists.setdefault((k, lead), [{} for _ in tokens])
        found = sorted((at.get(token, ()) for at, token in zip(lists, tokens)), key=len)
        # Lines that agree differ in k - wanted positions at most, so of any k - wanted + 1
        # positions they share one: those with the fewest leaders tell all candidates.
        for at in sorted(set().union(*found[: k - wanted + 1])):
            if sum(map(eq, tokens, self.lines[at][1])) >= wanted:
                return at
        for at, token in zip(lists, tokens):
            at.setdefault(token, []).append(len(self.lines))
        self.lines.append((tpl, tokens))
        return None


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tpl, template) of the lines that share a leader, themselves leaders included.

    Rows (leaf, part, docs, tpl, mask) arrive by leaf and part, the lines of most documents
    first. A line joins the first leader it agrees with and leads otherwise, which is the
    leader step repeated on what is left of a leaf. Memory holds the leaders of one part.
    """
    of: tuple[int, int] | None = None
    leaders = _Leaders()
    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        for leaf, part, tpl, mask in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if of != (leaf, part):
                of, leaders = (leaf, part), _Leaders()
            tokens = mask.split(" ")
            at = leaders.join(tpl, tuple(tokens[:DEPTH]), tokens[DEPTH:])
            if at is not None:
                leader = leaders.lines[at][0]
                if at not in leaders.led:
                    leaders.led.add(at)
                    out.append((leader, leader))
                out.append((tpl, leader))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["tpl", "template"])


def _with_leaders(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tpl, template) of the lines (leaf, docs, tpl, mask) that share a leader.

    ``sizes`` counts the lines of each leaf. Leaves of more than ``LEAF_LINES`` are first
    read in parts by digest, over many tasks, as often as that leaves a quarter fewer
    leaders; the leaders that remain of a leaf then meet in order, and lines follow the
    leader of their part.
    """

    def led(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("leaf", "part", "docs", "tpl", "mask").repartition("leaf", "part")
        rows = rows.sortWithinPartitions("leaf", "part", F.desc("docs"), F.desc("tpl"))
        return materialize(rows.mapInArrow(_grouped, "tpl binary, template binary"), name)

    steps: list[DataFrame] = []
    before = math.inf
    while True:
        large = sizes.filter(F.col("members") > LEAF_LINES)
        n = large.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        if not n or n > 0.75 * before:
            break
        if not steps:
            texts = materialize(texts, "in-leaves")
        parts = F.pmod(F.xxhash64(F.lit(len(steps)), "tpl"), F.ceil(F.col("members") / LEAF_LINES))
        step = led(lookup_join(texts, materialize(large, "large"), ["leaf"], "inner").withColumn("part", parts), "in-parts")
        texts = materialize(lookup_join(texts, step.filter("tpl <> template").select("tpl"), ["tpl"], "left_anti"), "leading")
        sizes = materialize(texts.groupBy("leaf").agg(F.count("*").alias("members")), "sizes")
        steps, before = [*steps, step], n
    merged = led(texts.withColumn("part", F.lit(0).cast("long")), "merged")
    for step in reversed(steps):
        above = merged.select(F.col("tpl").alias("via"), F.col("template").alias("over"))
        follow = lookup_join(step.withColumnRenamed("template", "via"), above, ["via"]).select("tpl", F.coalesce("over", "via").alias("template"))
        merged = materialize(follow.union(lookup_join(merged, step, ["tpl"], "left_anti")), "merged")
    return merged


def recurring(documents: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, templates): (tpl, _id, _th) per line and document, and
    (tpl, template, first_id) of the lines whose template recurs."""
    lines = _parsed(_lines(documents, text))
    seen = materialize(lines.select("tpl", "leaf", "n", "_id", "_th").distinct(), "lines")
    own = materialize(seen.groupBy("tpl", "leaf", "n").agg(F.count("*").alias("docs"), F.min("_id").alias("first_id")), "own")

    # Leaves with several lines have leaders. With one position beyond the leading tokens
    # agreement is equality, so shorter lines are templates of their own already.
    leaves = own.filter(F.col("n") >= DEPTH + 2).groupBy("leaf").agg(F.count("*").alias("members"), F.sum("docs").alias("docs"))
    leaves = materialize(leaves.filter("members > 1 and docs > 1").select("leaf", "members"), "leaves")
    texts = lookup_join(lines.select("leaf", "tpl", "mask").filter(F.col("n") >= DEPTH + 2), leaves.select("leaf"), ["leaf"], "inner")
    texts = materialize(texts.groupBy("leaf", "tpl").agg(F.first("mask").alias("mask")), "texts")
    texts = lookup_join(texts, own.select("tpl", "docs"), ["tpl"], "inner", 0).select("leaf", "docs", "tpl", "mask")
    merged = _with_leaders(texts, leaves)

    enough = F.col("docs") >= min_docs
    alone = lookup_join(own.filter(enough), merged, ["tpl"], "left_anti").select("tpl", F.col("tpl").alias("template"), "first_id")
    of_merged = lookup_join(seen, merged, ["tpl"], "inner").select("template", "_id", "_th").distinct()
    groups = of_merged.groupBy("template").agg(F.count("*").alias("docs"), F.min("_id").alias("first_id"))
    groups = materialize(groups.filter(enough).select("template", "first_id"), "groups")
    shared = lookup_join(merged, groups, ["template"], "inner").select("tpl", "template", "first_id")
    return seen.select("tpl", "_id", "_th"), materialize(alone.union(shared), "recurring")


def _windows(long_tokens: int):
    """Rows (_id, _th, lines, others, counts) to (run, _id, _th, first, last, whole), one per
    window; ``lines`` and ``others`` are two hashes of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x) for x in batch.column(2)], dtype=np.int64)
            hashes = np.stack([batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3)])
            count = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row, start = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.arange(len(count)) - start
            keep = count > 0
            hashes, count, row, at = hashes[:, keep], count[keep], row[keep], at[keep]
            n = len(count)
            if not n:
                continue
            begin, end = np.searchsorted(row, row), np.searchsorted(row, row, side="right") - 1
            upto = np.concatenate(([0], np.cumsum(count)))
            here = np.arange(n)
            to = np.searchsorted(upto, upto[:-1] + long_tokens) - 1
            since = np.searchsorted(upto, upto[1:] - long_tokens, side="right") - 1
            forward, backward = to <= end, (since >= begin) & (since < here)
            heads = here[here == begin]
            first = np.concatenate((here[forward], since[backward], heads))
            last = np.concatenate((to[forward], here[backward], end[heads]))
            whole = np.arange(len(first)) >= len(first) - len(heads)
            extra = (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ whole.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            value = np.empty((len(first), 2), dtype=np.uint64)
            for i, (line, base) in enumerate(zip(hashes, _BASES)):
                # A window's hash is its part of a polynomial, divided by the power at its start.
                factors = np.full((2, n + 1), [[base], [pow(base, -1, 1 << 64)]], dtype=np.uint64)
                factors[:, 0] = 1
                power, inverse = np.cumprod(factors, axis=1, dtype=np.uint64)
                total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(line * power[:n], dtype=np.uint64)))
                value[:, i] = (total[last + 1] - total[first]) * inverse[first] ^ extra
            runs = pa.Array.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(value.tobytes())]).cast(pa.binary())
            docs = pa.array(row[first])
            columns = [runs, batch.column(0).take(docs), batch.column(1).take(docs), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, ["run", "_id", "_th", "first", "last", "whole"])

    return run


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _marked(spans: pd.Series) -> pd.Series:
    """Which lines the spans (first, last) of a document cover."""
    out = []
    for of in spans:
        steps = np.zeros(max((s["last"] for s in of), default=-1) + 2, dtype=np.int64)
        for s in of:
            steps[s["first"]] += 1
            steps[s["last"] + 1] -= 1
        out.append((np.cumsum(steps)[:-1] > 0).tolist())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _recur(lines: pd.Series, drops: pd.Series) -> pd.Series:
    """Which of a document's lines are among its recurring templates; null without any."""
    out = []
    for of, gone in zip(lines, drops):
        known = None if gone is None else set(gone)
        out.append(None if known is None else [x in known for x in of])
    return pd.Series(out)


def recurring_runs(documents: DataFrame, text: str = "text", long_tokens: int = LONG_TOKENS) -> DataFrame:
    """(_id, _th, _runs, _whole): the lines of recurring runs in documents that are not their
    least, by position, and the span of a text that is a whole copy of a lesser one."""
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    of = documents.filter(F.col(text).isNotNull()).select(*row_key("doc_id", text), F.explode(F.array(trimmed)).alias("_all"))
    tokens = lambda x: F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    hashes = [F.transform("_all", lambda x: F.xxhash64(x)), F.transform("_all", lambda x: F.xxhash64(F.lit(1), x))]
    of = of.select("_id", "_th", hashes[0].alias("lines"), hashes[1].alias("others"), F.transform("_all", tokens).alias("counts"))
    kind = of.schema["_id"].dataType.simpleString()
    found = of.mapInArrow(_windows(long_tokens), f"run binary, _id {kind}, _th long, first int, last int, whole boolean")
    found = materialize(found, "windows")
    # Two documents of one hash would count as one here, which keeps text.
    known = found.withColumn("_uid", F.xxhash64("_id", "_th")).groupBy("run").agg(F.min("_id").alias("first_id"), F.min("_uid").alias("a"), F.max("_uid").alias("b"))
    known = materialize(known.filter("a <> b and first_id is not null").select("run", "first_id"), "runs")
    again = lookup_join(found, known, ["run"], "inner").filter(~F.col("_id").eqNullSafe(F.col("first_id")))
    span = F.struct("first", "last")
    spans = again.groupBy("_id", "_th").agg(F.collect_set(F.when(~F.col("whole"), span)).alias("_spans"), F.max(F.when(F.col("whole"), F.col("last"))).alias("_whole"))
    spans = materialize(spans, "spans")
    return materialize(spans.select("_id", "_th", F.when(F.size("_spans") > 0, _marked("_spans")).alias("_runs"), "_whole"), "marked")


def drop_recurring_lines(
    documents: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, long_tokens: int = LONG_TOKENS, into: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``documents`` with recurring lines cut from ``text``, plus the numbers of lines and dropped lines, as ``into``."""
    seen, known = recurring(documents, text, min_docs)
    again = F.col("first_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first_id"))
    drops = lookup_join(seen, known.select("tpl", "first_id"), ["tpl"], "inner").filter(again)
    drops = drops.groupBy("_id", "_th").agg(F.collect_list("tpl").alias("_drops"))
    both = drops.unionByName(recurring_runs(documents, text, long_tokens), allowMissingColumns=True).groupBy("_id", "_th")
    both = both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_drops", "_runs", "_whole")))
    both = materialize(both.filter("_drops is not null or _runs is not null"), "drops")
    # What documents lose grows with the documents, so at every size both sides are exchanged.
    rows = keyed(documents, "doc_id", text).alias("a")
    rows = lookup_join(rows, both.alias("b"), F.expr("a._id <=> b._id and a._th = b._th"), bound=0)
    rows = rows.select("_row", "_drops", "_runs", "_whole")
    whole_text = F.col("_row")[text]
    own = F.when(F.col("_drops").isNotNull(), F.transform(F.split(whole_text, "\n"), lambda x: _template(masked(x))))
    rows = rows.select("_row", "_runs", "_whole", _recur(own, F.col("_drops")).alias("_recur"))
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f\v")) == ""
    at = lambda flags, i: F.coalesce(F.get(flags, i), F.lit(False))
    gone = lambda x, i: at("_recur", i) | (at("_runs", i) | F.col("_whole").isNotNull()) & ~blank(x)
    cut = F.col("_recur").isNotNull() | F.col("_runs").isNotNull()
    rows = rows.withColumn("_kept", F.when(cut, F.filter(F.split(whole_text, "\n"), lambda x, i: ~gone(x, i))))
    n_lines = F.coalesce(F.octet_length(whole_text) - F.octet_length(F.replace(whole_text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_dropped = F.when(F.col("_kept").isNotNull(), n_lines - F.size("_kept")).otherwise(0).cast("long")
    kept = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(whole_text)
    names = remaining(documents, into)
    out = [kept.alias(c) if c == text else unpacked([c])[0] for c in names]
    return rows.select(*out, n_lines.alias(into[0]), n_dropped.alias(into[1]))
