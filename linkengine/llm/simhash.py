"""SimHash near-duplicate components.

Fingerprints are the 64-bit majority of the XXH64 values of 3-word shingles. Two
fingerprints link at a Hamming distance of at most two, so they share at least six of
their eight (position, byte) entries. Every distinct fingerprint is posted under its
entries; within a seed list the shared entries of every pair are tallied from the posting
lists, pairs below the guaranteed minimum of six are dropped by that count, and the rest
are verified by their differing bits.

Seeds keep the lists bounded. The positions form four blocks of two; two differing bytes
leave at least two blocks whole, so each pair meets in one of the six choices of two
blocks (four entries, 32 bits). A list of more than ``LIST_MEMBERS`` fingerprints is posted
again under its entries and two further ones, all six choices: a linked pair shares two of
the four further entries, so it meets there. Those lists share six entries, their members
differ in 16 bits only, and so they hold at most 65,536 fingerprints at any corpus size;
the tally is then complete by construction, and long ones are verified by looking up every
change of one or two bits. A list emits a chain through each of its linked classes
instead of all its pairs.

Cases: a null or empty text, or one of white space only, has fingerprint zero, which
links like any other. Texts of one or two words are one shingle. Repeated rows share a
fingerprint and so a component. A null ``doc_id`` never becomes a component id unless
no other id is reachable; then the id is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lookup_join, materialize, row_key, unpacked

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Entries that two linked fingerprints share at least.
MIN_SHARED = 8 - MAX_BITS
#: A seed list beyond this is posted again under two more entries.
LIST_MEMBERS = 256
_BLOCKS = ((0, 1), (2, 3), (4, 5), (6, 7))
#: The positions of the entries that form a seed, first and further ones.
SEEDS = [tuple(sorted(x + y)) for x, y in combinations(_BLOCKS, 2)]
DEEP_SEEDS = sorted({tuple(sorted((*seed, *more))) for seed in SEEDS for more in combinations(sorted(set(range(8)) - set(seed)), 2)})
_BLOCK = 1 << 15
#: So few edges, by count, are joined in one task instead of further rounds.
ONE_TASK_EDGES = 200_000


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of one whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        part = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def with_fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """(row identity, fingerprint) of every document."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return documents.select(*row_key("doc_id", text), of(F.col(text)).alias("fp"))


def _mask(positions: tuple[int, ...]) -> int:
    """The bytes at ``positions`` as a signed 64-bit mask."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def tallied_pairs(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of a seed list that share at least ``MIN_SHARED`` (position, byte) entries.

    The posting list of an entry holds the members with that byte at that position; every
    pair of a posting list gains one count.
    """
    m = len(members)
    entry = members.astype("<u8").view(np.uint8).reshape(m, 8).astype(np.int64) + 256 * np.arange(8)
    entries, column = np.unique(entry.ravel(), return_inverse=True)
    posted = np.zeros((m, len(entries)), dtype=np.float32)
    posted[np.repeat(np.arange(m), 8), column.ravel()] = 1
    tally = posted @ posted.T
    return np.nonzero(np.triu(tally >= MIN_SHARED, 1))


def linked_classes(members: np.ndarray) -> Iterator[np.ndarray]:
    """The classes of two or more among the distinct fingerprints of one seed list under
    links of at most ``MAX_BITS`` differing bits. A list beyond ``LIST_MEMBERS`` must
    share six entries."""
    members = np.unique(members.astype(np.uint64))
    m = len(members)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if m <= LIST_MEMBERS:
            a, b = tallied_pairs(members)
            near = np.bitwise_count(members[a] ^ members[b]) <= MAX_BITS
            yield a[near], b[near]
            return
        free = int(np.bitwise_or.reduce(members ^ members[0]))
        bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
        for flip in [*bits, *(a | b for a, b in combinations(bits, 2))]:
            other = members ^ flip
            at = np.minimum(np.searchsorted(members, other), m - 1)
            a = np.nonzero((members[at] == other) & (members < other))[0]
            yield a, at[a]

    for left, right in links():
        for a, b in zip(left.tolist(), right.tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    roots = np.array([root(x) for x in range(m)])
    order = np.argsort(roots, kind="stable")
    for group in np.split(order, np.nonzero(np.diff(roots[order]))[0] + 1):
        if len(group) > 1:
            yield members[group]


def _chains(deep: bool):
    """Rows (seed, key, fp) arrive sorted by (seed, key) to edges (u, v). A list may span
    batches; if it outgrows ``LIST_MEMBERS`` its members leave as (fp, null) unless ``deep``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size, key, out = 0, None, []

        def close() -> None:
            if size > 1 and (deep or size <= LIST_MEMBERS):
                for group in linked_classes(np.concatenate(held)):
                    g = group.view(np.int64)
                    out.append(np.column_stack((g[:-1], g[1:], np.ones(len(g) - 1, dtype=np.int64))))

        def spill() -> None:
            members = np.concatenate(held).view(np.int64)
            out.append(np.column_stack((members, members, np.zeros(len(members), dtype=np.int64))))
            held[:] = [members[:0]]

        def rows() -> pd.DataFrame:
            table = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
            out.clear()
            return pd.DataFrame({"u": table[:, 0], "v": table[:, 1], "link": table[:, 2] > 0})

        for pdf in batches:
            seed, posting, fp = (pdf[c].to_numpy() for c in ("seed", "key", "fp"))
            if not len(fp):
                continue
            cuts = np.nonzero((seed[1:] != seed[:-1]) | (posting[1:] != posting[:-1]))[0] + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for a, b in zip(bounds, bounds[1:]):
                if key != (seed[a], posting[a]):
                    close()
                    held, size, key = [], 0, (seed[a], posting[a])
                held.append(fp[a:b])
                size += b - a
                if size > LIST_MEMBERS and not deep:
                    spill()
            yield rows()
        close()
        yield rows()

    return run


def _posted(fingerprints: DataFrame, seeds: list[tuple[int, ...]], deep: bool) -> DataFrame:
    """(u, v, link) of the lists that ``fp`` forms under ``seeds``."""
    entries = F.array(*(F.struct(F.lit(i).cast("byte").alias("seed"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(seeds)))
    index = fingerprints.select("fp", F.explode(entries).alias("e")).select("e.seed", "e.key", "fp")
    return index.repartition("seed", "key").sortWithinPartitions("seed", "key").mapInPandas(_chains(deep), "u long, v long, link boolean")


def link_chains(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all links among distinct ``fp``."""
    found = materialize(_posted(fingerprints, SEEDS, False), "lists")
    crowded = materialize(found.filter("not link").select(F.col("u").alias("fp")).distinct(), "crowded")
    deep = _posted(crowded, DEEP_SEEDS, True)
    return found.filter("link").select("u", "v").union(deep.select("u", "v")).distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, parent) of a counted, bounded number of edges; a parent is its class's least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(parent), "parent": [find(x) for x in parent]}, dtype="int64")


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), by contraction.

    Each round every node hooks to the closed neighbour of least seeded hash, follows
    the pointer twice more, and the graph is contracted; nodes halve in expectation.
    Once a count proves at most ``one_task`` edges left, one task joins these. The rounds
    exchange tables through the shared folder, so a lost executor repeats at most one round.
    """
    spark = edges.sparkSession
    current = materialize(edges.filter("u <> v"), "edges")
    roots: DataFrame | None = None
    seed = 0
    while left := current.count():
        last = left <= one_task
        if last:
            hook = materialize(current.coalesce(1).mapInPandas(_joined, "node long, parent long"), "hooks")
        else:
            both = current.union(current.select("v", "u"))
            rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("n"))
            hook = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
            hook = hook.select(F.col("u").alias("node"), F.least(F.col("best"), rank(F.col("u")))["n"].alias("parent"))
            hook = materialize(hook, "hooks")
            for _ in range(2):
                up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
                hook = lookup_join(hook, up, ["parent"]).select("node", F.coalesce("upper", "parent").alias("parent"))
                hook = materialize(hook, "hooks")
        if roots is None:
            roots = hook.select("node", F.col("parent").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), F.col("parent"))
            roots = materialize(lookup_join(roots, step, ["root"]).select("node", F.coalesce("parent", "root").alias("root")), "roots")
        if last:
            break
        for end in ("u", "v"):
            step = hook.select(F.col("node").alias(end), F.col("parent"))
            current = lookup_join(current, step, [end]).withColumn(end, F.coalesce("parent", end)).drop("parent")
        u, v = F.least("u", "v"), F.greatest("u", "v")
        current = materialize(current.select(u.alias("u"), v.alias("v")).filter("u <> v").distinct(), "edges")
        seed += 1
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def labelled(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_id, _th, fp, component_id) of materialized ``rows`` under the edges ``link`` finds among distinct ``fp``."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(link(distinct))
    linked = materialize(lookup_join(roots.withColumnRenamed("node", "fp"), distinct, ["fp"], "inner", 0), "linked")
    by_root = materialize(linked.groupBy("root").agg(F.min("least").alias("component")), "classes")
    of_linked = lookup_join(linked.select("fp", "root"), by_root, ["root"]).select("fp", "component")
    copies = distinct.filter("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component"))
    lookup = materialize(of_linked.union(copies), "components")
    joined = lookup_join(rows, lookup, ["fp"])
    return joined.select("_id", "_th", "fp", F.coalesce("component", "_id").alias("component_id"))


def components(documents: DataFrame, text: str = "text") -> DataFrame:
    """(_id, _th, fp, component_id) per document row."""
    return labelled(materialize(with_fingerprint(documents, text), "fingerprints"), link_chains)


def drop_near_duplicates(documents: DataFrame, text: str = "text", of: Callable[[DataFrame, str], DataFrame] = components) -> DataFrame:
    """Keep the row of least ``doc_id`` of each component, all its columns.

    Rows without an id stay unless linked to a row with one. Where the least id stands
    at several rows of a component, the one with the least text digest stays, once.
    """
    rows = materialize(of(documents, text), "members")
    losers = rows.filter(F.col("component_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("component_id")))
    heads = rows.filter("_id is not null and _id = component_id")
    twice = materialize(heads.groupBy("component_id").agg(F.min("_th").alias("head"), F.count("*").alias("n")).filter("n > 1"), "twice")
    repeated = not twice.isEmpty()
    if repeated:
        extra = lookup_join(heads, twice.drop("n"), ["component_id"], "inner").filter("_th <> head")
        losers = losers.select("_id", "_th").union(extra.select("_id", "_th"))
    losers = materialize(losers.select("_id", "_th").distinct(), "losers")
    kept = lookup_join(keyed(documents, "doc_id", text).alias("a"), losers.alias("b"), F.expr("a._id <=> b._id and a._th = b._th"), "left_anti")
    if repeated:
        ids = twice.select(F.col("component_id").alias("_id"))
        again = lookup_join(kept, ids, ["_id"], "left_semi")
        rest = lookup_join(kept, ids, ["_id"], "left_anti")
        kept = rest.unionByName(again.dropDuplicates(["_id", "_th"]))
    return kept.select(*unpacked(documents.columns))
