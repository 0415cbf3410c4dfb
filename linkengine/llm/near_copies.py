"""Near copies by the overlap of their shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
least 0.8. The steps are those of ``simhash`` on a wider fingerprint: a text is posted under
the (position, byte) entries of its fingerprint, four of which form the key of a seed list;
the shared entries of the pairs of a list are tallied; pairs below a least tally are dropped by
that count; and the rest are verified, here on their whole shingle sets, so nothing below the
similarity is linked.

The fingerprint has 128 bytes. A bit of a majority over all shingles differs with probability
0.15 at a similarity of 0.8, and so three of four bytes would; a byte is therefore taken from one shingle
alone, the least under its position's own order, which makes it agree with a probability of at least the similarity.
The 32 seeds use each position once: a pair of similarity 0.8 shares all four entries of a
seed with probability 0.8^4, so it meets in no list with probability (1 - 0.8^4)^32, 5e-8. It shares
102 of 128 entries on average, and fewer than ``LEAST_SHARED`` with probability below 1e-12.

Texts with equal shingle sets are one node. Every posting list first pairs its members
with its head only. Where the members of a list are not yet of one component, the list is then
compared within tasks: its members meet with their entries and shingle sets, every pair across
components that the tally leaves is counted exactly, and only one edge for each two components that join leaves
the task. A list beyond ``LIST_MEMBERS`` is dealt out in blocks, each two of which meet in a
task of their own, so no task holds more than two blocks. A large group of copies
thus costs one row per member, no pair that could join two components is left out, and no pairs are
written.

Cases are those of ``simhash``: texts without a word share the empty set, texts of fewer
words than a shingle are one shingle, A-Z are folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import lookup_join, materialize, row_key

SHINGLE = 5
SIMILARITY = 0.8
#: Seeds, and the entries of each; no two seeds share a position.
SEEDS, PER_SEED = 32, 4
POSITIONS = SEEDS * PER_SEED
#: Entries that two linked fingerprints share at least.
LEAST_SHARED = 64
_BLOCK = 1 << 12
_SETS = 200
#: A block of a posting list; a task holds two blocks at most.
LIST_MEMBERS = 512
_rng = np.random.default_rng(simhash.SEED)
_FLIP = _rng.integers(0, 1 << 32, (POSITIONS, 1), dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, (POSITIONS, 1), dtype=np.uint32) | np.uint32(1)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED)], dtype=np.uint64)
    n = len(words) - shingle + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        total = _mixed(total + h[i : i + n] * _ODD[i % 64])
    return np.unique(total)


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """The 128 bytes of a shingle set that is not empty, a byte of one shingle at each position."""
    least = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _BLOCK):
        np.minimum(least, ((high[None, at : at + _BLOCK] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return (_mixed(least.astype(np.uint64) * _ODD[0]) >> np.uint64(56)).astype(np.uint8)


def postings(grams: np.ndarray) -> list[int]:
    """The keys of the seed lists of a shingle set: the seed's number above the bytes of its four
    entries, so that all keys together are the whole fingerprint."""
    seeds = np.ascontiguousarray(fingerprint(grams)).view("<u4").astype(np.int64)
    return (seeds + (np.arange(SEEDS, dtype=np.int64) << 32)).tolist()


def _bytes(keys: pa.Array) -> np.ndarray:
    """The fingerprints, a row each, of lists of keys, none of which is empty."""
    flat = keys.flatten().to_numpy(zero_copy_only=False)
    return (flat & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, POSITIONS)


def with_postings(documents: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row identity, digest of the shingle set, index entries) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], dtype=np.uint64)
            keys = pa.array([postings(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests.view(np.int64)), keys], ["_id", "_th", "fp", "keys"])

    rows = documents.select(*row_key("doc_id", text), F.col(text).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _th long, fp long, keys array<long>")


def _shingle_sets(wanted: DataFrame, rows: DataFrame, documents: DataFrame, text: str, shingle: int) -> DataFrame:
    """(fp, grams): the whole shingle sets of the digests ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SETS):
                part = batch.slice(at, _SETS)
                sets = pa.array([shingles(t, shingle).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["fp", "grams"])

    one = lookup_join(rows.select("fp", "_th"), materialize(wanted, "wanted"), ["fp"], "inner").groupBy("fp").agg(F.min("_th").alias("_th"))
    one = materialize(one, "one")
    texts = documents.select(row_key("doc_id", text)[1], F.col(text).alias("text"))
    texts = lookup_join(texts, one, ["_th"], "inner").groupBy("fp").agg(F.first("text").alias("text"))
    return materialize(texts.select("fp", "text").mapInArrow(run, "fp long, grams array<long>"), "sets")


def tallied(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) that share at least ``LEAST_SHARED`` (position, byte) entries; ``prints`` has (fp, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tally = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(tally >= LEAST_SHARED))

    both = lookup_join(pairs, prints.select(F.col("fp").alias("u"), F.col("keys").alias("a")), ["u"], "inner", 0)
    both = lookup_join(both, prints.select(F.col("fp").alias("v"), F.col("keys").alias("b")), ["v"], "inner", 0)
    return materialize(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "tallied")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of digests whose whole shingle sets are similar enough."""
    both = lookup_join(pairs, sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), ["u"], "inner", 0)
    both = lookup_join(both, sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), ["v"], "inner", 0)
    shared = F.size(F.array_intersect("a", "b"))
    return materialize(both.filter(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("u", "v"), "verified")


def joined_components(fps: list[int], roots: list[int], marks: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Linked pairs (u, v) across ``roots``, one for each two components that they join.

    Members of a list have a fingerprint each, ``marks``; a pair is counted exactly if its tally allows.
    """
    parent = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(parent) < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, grams = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = [grams[at : at + n] for at, n in zip(starts.tolist(), sizes.tolist())]
    entries = np.stack(marks)
    mark = np.zeros(int(grams.max()) + 1, dtype=np.int64)
    left, out = len(parent), []
    for i in range(len(fps) - 1):
        likely = np.nonzero((entries[i + 1 :] == entries[i]).sum(axis=1) >= LEAST_SHARED)[0] + i + 1
        if not len(likely):
            continue
        mark[of[i]] = 1
        ends = np.cumsum(sizes[likely])
        shared = np.add.reduceat(mark[np.concatenate([of[j] for j in likely.tolist()])], ends - sizes[likely])
        mark[of[i]] = 0
        near = shared / (sizes[i] + sizes[likely] - shared) >= similarity
        for j in likely[near].tolist():
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((fps[i], fps[j]))
                left -= 1
        if left == 1:
            break
    return out


def _joins(similarity: float):
    """Rows (key, one, other, fp, root, keys, grams), sorted by the first three, to edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])

        def table(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            edges: list[tuple[int, int]] = []
            key, one, other, fp, root = (batch.column(i).to_pylist() for i in range(5))
            marks = _bytes(batch.column(5))
            grams, ends = batch.column(6).flatten().to_numpy(), np.cumsum([len(x) for x in batch.column(6)])
            for i, of in enumerate(zip(key, one, other)):
                if of != group:
                    edges += joined_components(*held, similarity)
                    group, held = of, ([], [], [], [])
                held[0].append(fp[i])
                held[1].append(root[i])
                held[2].append(marks[i])
                held[3].append(grams[ends[i - 1] if i else 0 : ends[i]].copy())
            yield table(edges)
        yield table(joined_components(*held, similarity))

    return run


def links(rows: DataFrame, documents: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (u, v) whose components are those of all links among distinct ``fp``."""
    entries = rows.select("fp", F.explode("keys").alias("key"))
    heads = entries.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head < last")
    heads = materialize(heads.select("key", "head"), "heads")
    lists = materialize(lookup_join(entries, heads, ["key"], "inner").distinct(), "lists")
    starred = lists.filter("head <> fp").select(F.col("head").alias("u"), F.col("fp").alias("v")).distinct()
    starred = materialize(starred, "pairs")
    members = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    # Every member of a list is in a pair. Rows of one digest have one fingerprint.
    prints = lookup_join(rows.select("fp", "keys"), materialize(members(starred), "nodes"), ["fp"], "inner").dropDuplicates(["fp"])
    prints = materialize(prints, "prints")
    starred = tallied(starred, prints)
    nodes = members(starred)
    edges = _verified(starred, _shingle_sets(nodes, rows, documents, text, shingle), similarity)

    roots = materialize(simhash.connected_components(edges), "starred")
    rooted = lookup_join(lists, roots.withColumnRenamed("node", "fp"), ["fp"]).select("key", "fp", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least < most")
    # A list of two is its head and one member, which is decided.
    split = split.filter("n > 2").select("key", F.ceil(F.col("n") / LIST_MEMBERS).cast("int").alias("blocks"))
    open_lists = materialize(lookup_join(rooted, materialize(split, "split"), ["key"], "inner"), "open")
    if open_lists.isEmpty():
        return edges
    sets = _shingle_sets(open_lists.select("fp").distinct(), rows, documents, text, shingle)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = open_lists.withColumn("mine", block).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("other"), "fp", "root")
    dealt = lookup_join(lookup_join(dealt, prints, ["fp"], "inner"), sets, ["fp"], "inner", 0)
    dealt = dealt.select("key", "one", "other", "fp", "root", "keys", "grams")
    dealt = dealt.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other", "fp")
    return edges.union(materialize(dealt.mapInArrow(_joins(similarity), "u long, v long"), "joins"))


def components(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(_id, _th, fp, component_id) per document row."""
    rows = materialize(with_postings(documents, text, shingle), "postings")
    return simhash.labelled(rows.select("_id", "_th", "fp"), lambda _: links(rows, documents, text, shingle, similarity))


def drop_near_copies(documents: DataFrame, text: str = "text") -> DataFrame:
    """Keep the row of least ``doc_id`` of each component, all its columns."""
    return simhash.drop_near_duplicates(documents, text, components)
