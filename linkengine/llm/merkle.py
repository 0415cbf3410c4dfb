"""A Merkle manifest of a data set: a tree per group, and a tree over the groups' roots.

Leaves are ordered within their group; every ``ARITY`` consecutive nodes have a parent, the last parent of a level
has what is left, and levels go on until one node remains. So a group's size says how many children any node has.

Folding is event-driven: a task reads nodes in order and keeps partial parents, each with the digests of its children by
their index. When the last child that the size calls for arrives, the parent is emitted, and is itself a child
that has arrived, up to the root if need be. As a task's nodes are consecutive, it holds a few partial parents for each level at a
time. Those that never complete there are its frontier: only they are shuffled, to the task of a wider block of leaves, where the
same fold goes on. A block spans ``3 ** FIRST_HEIGHT`` leaves, then ``3 ** HEIGHT_STEP`` times as many in every further round.

Proofs go the way back: each round's links (which children a parent had), read from the root down, give every node
the siblings from it to the root. What a round's topmost nodes have above them comes from the next round, so a leaf's
task needs its own links and a few rows for its run.

A group's order is found without bringing it together: rows are dealt by range over (group, order, digest, place in a written table), so
even equal rows spread; runs are counted, and a row's index is the run's start plus its place in the run.

Cases: null fields are written ``-``; the null group comes first; rows without an order key come first in their group.
Repeated rows are leaves of their own, in any order, as they are equal; other ties go by digest. A group of one leaf has that leaf as its root, and
one group's root is the data set's. Very long texts are hashed where they lie and never travel. Empty tables give an empty
result. Other columns are ignored; only the named fields are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, materialize

ARITY = 3
#: Leaves of a run, about; ranges are sampled.
RUN_LEAVES = 100_000
#: Levels that the first shuffled round covers, and every further one adds.
FIRST_HEIGHT, HEIGHT_STEP = 15, 6
#: Rows handed over at once.
OUT_ROWS = 2048
_NODES = "grp string, block long, n long, level int, idx long, digest binary"
_RESTS = "grp string, block long, n long, level int, idx long, above binary, place long, groups long, subroot binary"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)).cast("binary"), 256))


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


class Fold:
    """Partial parents of the nodes seen so far. ``arrive`` takes a node and climbs while parents complete;
    ``links`` keeps, if asked, each completed parent's children under their own places."""

    def __init__(self, links: bool = False):
        self.open: dict[tuple[str, int, int], dict[int, bytes]] = {}
        self.sizes: dict[str, list[int]] = {}
        self.up: dict[tuple[int, int], tuple[bytes, ...]] | None = {} if links else None

    def size(self, grp: str, n: int, level: int) -> int:
        known = self.sizes.get(grp)
        if known is None:
            known = [n]
            while known[-1] > 1:
                known.append(-(-known[-1] // ARITY))
            if len(self.sizes) > 1000:
                self.sizes.clear()
            self.sizes[grp] = known
        return known[level]

    def arrive(self, grp: str, n: int, level: int, idx: int, value: bytes) -> tuple[int, int, bytes] | None:
        """The group's root, if this node completes it."""
        while True:
            size = self.size(grp, n, level)
            if size == 1:
                return level, idx, value
            parent = idx // ARITY
            children = self.open.setdefault((grp, level, parent), {})
            children[idx] = value
            if len(children) < min(ARITY, size - parent * ARITY):
                return None
            del self.open[grp, level, parent]
            in_order = tuple(children[i] for i in sorted(children))
            if self.up is not None:
                self.up[level, parent] = in_order
            value = sha256(b"".join(in_order).hex().encode()).digest()
            level, idx = level + 1, parent

    def frontier(self) -> Iterator[tuple[str, int, int, bytes]]:
        """(group, level, index, digest) of nodes whose parents are not complete."""
        for (grp, level, _), children in self.open.items():
            for idx, value in children.items():
                yield grp, level, idx, value


def refold(value: bytes, siblings: bytes, n: int, idx: int) -> tuple[bytes, int]:
    """The root of a tree of ``n`` leaves from one leaf and its siblings up, and how many bytes of these were used."""
    used = 0
    while n > 1:
        first = idx - idx % ARITY
        left, right = 32 * (idx - first), 32 * (min(first + ARITY, n) - 1 - idx)
        at = used + left
        value = sha256((siblings[used:at] + value + siblings[at : at + right]).hex().encode()).digest()
        used, n, idx = at + right, -(-n // ARITY), idx // ARITY
    return value, used


def _arrays(rows: list[tuple], ddl_types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ddl_types)], names)


def _columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names))


_NODE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_NODE_NAMES = ["grp", "block", "n", "level", "idx", "digest"]
_REST_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
_REST_NAMES = ["grp", "block", "n", "level", "idx", "above", "place", "groups", "subroot"]
#: What a topmost node's row says of its group: place, number of groups, root.
_FACTS = _REST_NAMES[6:]


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by (grp, block, first leaf) to those without a complete parent."""
    fold, at, out = Fold(), None, []

    def closed() -> None:
        out.extend((*at[:1], at[1], at[2], level, idx, value) for _, level, idx, value in fold.frontier())
        fold.open.clear()

    for batch in batches:
        for grp, block, n, level, idx, value in _columns(batch, _NODE_NAMES):
            if at is not None and at[:2] != (grp, block):
                closed()
            at = (grp, block, n)
            root = fold.arrive(grp, n, level, idx, value)
            if root:
                out.append((grp, block, n, *root))
            if len(out) >= OUT_ROWS:
                yield _arrays(out, _NODE_TYPES, _NODE_NAMES)
                out.clear()
    if at is not None:
        closed()
    if out:
        yield _arrays(out, _NODE_TYPES, _NODE_NAMES)


def _proofs(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple, bytes, tuple]]:
    """(node's columns, siblings up to the very root, facts of its group) of every node.

    Rows come sorted by (grp, block, kind): first what is above the block's topmost nodes, then its nodes by their first leaf.
    """
    names = ["grp", "block", "n", "level", "idx", "digest", *extra]
    at, tops, nodes = None, {}, []

    def solved() -> Iterator[tuple[tuple, bytes, tuple]]:
        fold = Fold(links=True)
        for node in nodes:
            fold.arrive(node[0], *node[2:6])
        for node in nodes:
            level, idx, path = node[3], node[4], []
            while (level, idx) not in tops:
                siblings = fold.up[level, idx // ARITY]
                path += [s for i, s in enumerate(siblings) if i != idx % ARITY]
                level, idx = level + 1, idx // ARITY
            above, *facts = tops[level, idx]
            yield node, b"".join(path) + above, tuple(facts)

    for batch in batches:
        for kind, top, node in zip(batch.column("kind").to_pylist(), _columns(batch, ["above", *_FACTS]), _columns(batch, names)):
            if at != node[:2]:
                yield from solved()
                at, tops, nodes = node[:2], {}, []
            if kind == 0:
                tops[node[3], node[4]] = top
            else:
                nodes.append(node)
    yield from solved()


def _rests_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is above each of a round's nodes, for the block of the round before."""
    out = []
    for (grp, _, n, level, idx, _, came), above, facts in _proofs(batches, ["came"]):
        out.append((grp, came, n, level, idx, above, *facts))
        if len(out) >= OUT_ROWS:
            yield _arrays(out, _REST_TYPES, _REST_NAMES)
            out = []
    if out:
        yield _arrays(out, _REST_TYPES, _REST_NAMES)


@dataclass
class Forest:
    """The rounds of a fold (their nodes, in blocks) and the roots (grp, block, n, digest) of all groups."""

    rounds: list[DataFrame]
    roots: DataFrame


def _in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a block in one task, sorted."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(n), "grp", "block").sortWithinPartitions("grp", "block", *order)


def numbered(rows: DataFrame, order: list[str], run_leaves: int = RUN_LEAVES) -> DataFrame:
    """Add block (the run), n, level 0 and idx to rows (grp, digest, columns of ``order``, others)."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "leaves")
    total = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // run_leaves))
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "digest", "at")]
    dealt = materialize(rows.repartitionByRange(parts, *by).withColumn("block", F.spark_partition_id().cast("long")), "runs")
    runs = dealt.groupBy("grp", "block").agg(F.count("*").alias("in_run"))
    upto = Window.partitionBy("grp").orderBy("block")
    # One row for each run and group; a group's runs are at most as many as the ranges.
    runs = runs.withColumns({"start": F.sum("in_run").over(upto) - F.col("in_run"), "n": F.sum("in_run").over(Window.partitionBy("grp"))})
    runs = materialize(runs.drop("in_run"), "starts")
    placed = lookup_join(dealt, runs, ["grp", "block"], "inner")
    place = F.row_number().over(Window.partitionBy("grp", "block").orderBy(*by[1:]))
    placed = placed.withColumns({"idx": F.col("start") + place - 1, "level": F.lit(0)})
    return materialize(placed.drop("start", "at"), "numbered")


def fold_forest(leaves: DataFrame, first_height: int = FIRST_HEIGHT, step: int = HEIGHT_STEP) -> Forest:
    """Fold numbered leaves of any groups to their roots."""

    def folded(nodes: DataFrame) -> DataFrame:
        low = F.col("idx") * F.expr(f"cast(power({ARITY}, level) as long)")
        return materialize(_in_blocks(nodes.select(*_NODE_NAMES, low.alias("low")), "low").drop("low").mapInArrow(_fold_task, _NODES), "frontier")

    most = leaves.agg(F.max("n")).first()[0] or 1
    heights = [first_height] if most > 1 else []
    while heights and ARITY ** heights[-1] < most:
        heights.append(heights[-1] + step)
    rounds, tops = [leaves], folded(leaves)
    for height in heights:
        wide = F.expr(f"idx div cast(power({ARITY}, greatest({height} - level, 0)) as long)")
        rounds.append(tops.withColumnRenamed("block", "came").withColumn("block", wide))
        tops = folded(rounds[-1])
    return Forest(rounds, tops)


def _with_rests(nodes: DataFrame, rests: DataFrame) -> DataFrame:
    """A round's nodes and what is above its topmost ones, by block, for ``_proofs``."""
    both = nodes.withColumn("kind", F.lit(1)).unionByName(rests.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return _in_blocks(both.withColumn("low", F.col("idx") * F.expr(f"cast(power({ARITY}, level) as long)")), "kind", "low").drop("low")


def _rests_of_leaves(forest: Forest, rests: DataFrame) -> DataFrame:
    """From what is above the roots to what is above the topmost nodes of the leaves' round."""
    for nodes in reversed(forest.rounds[1:]):
        rests = materialize(_with_rests(nodes, rests).mapInArrow(_rests_task, _RESTS), "above")
    return rests


def manifest(
    documents: DataFrame, fields: list[Column], group: Column, order: Column, claimed: list[Column] | None = None,
    run_leaves: int = RUN_LEAVES, first_height: int = FIRST_HEIGHT, step: int = HEIGHT_STEP,
) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of every row, digests in lower-case hexadecimal.

    ``key`` is ``order``; ``proof`` holds the siblings from the leaf to the root, one after the other. ``folded_root`` is what
    the proof makes of the ``claimed`` fields (by default the same), and ``verified`` whether that is the root.
    """
    rows = documents.select(group_key(group).alias("grp"), order.alias("key"), digest(fields).alias("digest"), digest(claimed or fields).alias("claimed"))
    leaves = numbered(rows, ["key"], run_leaves)
    forest = fold_forest(leaves, first_height, step)
    # The groups' roots are the leaves of one more tree, in the order of their groups.
    groups = forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.col("block").alias("under"), F.col("level").alias("height"), F.col("n").alias("size"))
    groups = numbered(groups, ["key"], run_leaves)
    top = fold_forest(groups, first_height, step)
    found = top.roots.select("digest").first()  # one row, the root
    root = bytes(found["digest"]) if found else b""
    none = {"above": F.lit(b""), "place": F.lit(0).cast("long"), "groups": F.lit(1).cast("long"), "subroot": F.col("digest")}
    start = top.roots.withColumns(none).drop("digest")
    above = _with_rests(groups.select(*_NODE_NAMES, "key", "under", "height", "size"), _rests_of_leaves(top, start))
    rests = _rests_of_leaves(forest, materialize(above.mapInArrow(_group_task, _RESTS), "above"))
    key = documents.select(order.alias("key")).schema["key"].dataType.simpleString()
    proven = _with_rests(leaves.select(*_NODE_NAMES, "key", "claimed"), rests)
    proven = proven.mapInArrow(_leaf_task, f"key {key}, leaf string, subroot string, proof string, folded_root string")
    verified = F.col("folded_root") == root.hex()
    return proven.select("key", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof", "folded_root", verified.alias("verified"))


def _group_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, what is above its root, as a row of the block that completed it."""
    out = []
    for (_, _, n, _, idx, value, key, under, height, size), above, _ in _proofs(batches, ["key", "under", "height", "size"]):
        out.append((key, under, size, height, 0, above, idx, n, value))
        if len(out) >= OUT_ROWS:
            yield _arrays(out, _REST_TYPES, _REST_NAMES)
            out = []
    if out:
        yield _arrays(out, _REST_TYPES, _REST_NAMES)


def _leaf_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, kind = [], None

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("key").type
            yield batch

    def handed() -> pa.RecordBatch:
        return _arrays(out, [kind, *[pa.string()] * 4], ["key", "leaf", "subroot", "proof", "folded_root"])

    for (_, _, n, _, idx, value, key, claimed), siblings, (place, groups, subroot) in _proofs(typed(), ["key", "claimed"]):
        folded, used = refold(claimed, siblings, n, idx)
        folded, _ = refold(folded, siblings[used:], groups, place)
        out.append((key, value.hex(), subroot.hex(), siblings.hex(), folded.hex()))
        if len(out) >= OUT_ROWS:
            yield handed()
            out.clear()
    if out:
        yield handed()
