"""Packing token sequences by power-of-two decomposition (Pouransari et al.).

A document's tokens are cut into pieces whose lengths are the binary digits of their number: as many
pieces of the longest length as fit, then each smaller power of two at most once. Every piece
is a sequence of its own, so no sequence crosses documents and none is padded; pieces of
equal length form a bucket. Sequences are numbered bucket by bucket, longest first and without
gaps, so a reader takes batches of one length from consecutive numbers.

Tokens are those of a byte-level BPE file of the ``tokenizers`` library, then ``end_id``. Its
pre-tokenizer never lets a token span the places where ``units`` cuts: before a space that precedes
other characters, and around other white space as its last two alternatives take it. So a text is
the sum of its units, each encoded by the library (or, if its characters are plain, its pre-tokens by the library's model) once per worker and kept in a memo of
bounded bytes. A text of plain characters only, line feeds included, is split into its pre-tokens at once, which are fewer different
ones than its units (``word.`` and ``word,`` share theirs). A text is cut at special strings first, as the library does, and taken a bounded chunk at a time.
Encoding whole texts gives the same tokens at several times the work. Files for which this is not so are refused.

A task numbers its own pieces as it writes them; counts per task and length then shift these numbers, so the tokens
themselves are never shuffled. A lost task is run again as a whole before its rows are published.
What sequence a piece becomes depends on how the input was split into tasks; the pieces do not.

Cases: a null or empty text has the end token only, one piece of length 1. Repeated rows are packed one by one. Very long texts are
read chunk by chunk; only a run of one character class longer than a chunk is given to the library whole. Empty tables
give an empty result. Rows without an id keep a null id. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_join, materialize
from .token_counts import _byte_characters, tokenizer_path

CHUNK_CHARS = 1 << 18
#: Characters of the units kept per worker, with 64 for each; the memo starts anew beyond it.
MEMO_CHARS = 64 << 20
#: Bytes of tokens handed over at once.
OUT_BYTES = 4 << 20
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: A unit of printable ASCII characters without apostrophes and of Latin letters, and its pre-tokens.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(f" ?[!-&(-~{_LETTERS}]+\\Z")
_PRE_TOKEN = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+")
#: A text of which ``_SPLIT`` gives the pre-tokens, and they.
_TEXT = re.compile(f"[\n -~{_LETTERS}]*\\Z")
_SPLIT = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]")
#: White space to Python only.
_ODD = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def check_definition(definition: dict) -> None:
    """Refuse files whose tokens could span the cuts of ``units``."""
    pre = definition["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in definition["added_tokens"])
    model = definition["model"]
    if not (plain and added and model["type"] == "BPE" and not model.get("dropout") and not definition.get("normalizer") and not definition.get("post_processor")):
        raise ValueError("only byte-level BPE files without normaliser, prefix space and post-processor are taken")


def _kind(c: str) -> str:
    """L, N or P (other) for characters whose class no Unicode version disputes, else nothing."""
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    if old != new or old == "Cn" or c.isspace() or c == "'":
        return ""
    return new[0] if new[0] in "LN" else "P"


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut a text without special strings where no token can span: before a space between other characters,
    or where the class of characters changes."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size - 1, min(len(text), at + 2 * size))
        cut = found.start() if found else 0
        while not found:
            for cut in range(at + size, len(text)):
                before, after = _kind(text[cut - 1]), _kind(text[cut])
                if before and after and before != after or _SPACE.match(text, cut):
                    break
            else:
                cut = len(text)
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def units(text: str) -> list[str]:
    """Parts of a chunk whose tokens are independent of each other. Characters that only Python takes for
    white space leave the chunk whole."""
    return _UNIT.findall(text) if not _ODD.search(text) else [text]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        check_definition(definition)
        self._library = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in definition["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        (self._feed,) = self._library.encode("\n", add_special_tokens=False).ids
        self._line = re.compile(r" ?\S(?:[^\n]*\S)?\Z")
        self._stand_ins = {b: c for c, b in _byte_characters().items()}
        self._bytes_of = [i.to_bytes(4, "little") for i in range(self._library.get_vocab_size())]
        self._special_ids = {x: np.array(self._library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in special}
        self._memo: dict[str, bytes] = {}
        self._chars = 0

    def _piece(self, piece: str) -> bytes:
        """What the library's model makes of one pre-token."""
        found = self._memo.get(piece)
        if found is None:
            stand_ins = piece.replace(" ", "\u0120").replace("\n", "\u010a") if piece.isascii() else piece.encode().decode("latin-1").translate(self._stand_ins)
            found = self._memo[piece] = b"".join([self._bytes_of[t.id] for t in self._library.model.tokenize(stand_ins)])
            self._chars += len(piece) + 64
        return found

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Units not met before. Plain ones are split into their pre-tokens. Of the others, those without white
        space at their ends or line feeds inside are encoded as the lines of one text: a line feed between other characters is a
        token of its own."""
        out, lines, rest, split, piece = {}, [], [], _PRE_TOKEN.findall, self._piece
        for p in parts:
            if _PLAIN.match(p):
                out[p] = b"".join([piece(x) for x in split(p)])
            else:
                (lines if self._line.match(p) else rest).append(p)
        if rest:
            out |= zip(rest, (np.array(e.ids, dtype="<u4").tobytes() for e in self._library.encode_batch(rest, add_special_tokens=False)))
        if lines:
            (found,) = self._library.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            ends = [*np.nonzero(ids == self._feed)[0].tolist(), len(ids)]
            data, at = ids.tobytes(), 0
            for p, end in zip(lines, ends, strict=True):
                out[p] = data[4 * at : 4 * end]
                at = end + 1
        return out

    def _encode(self, parts: list[str]) -> bytes:
        memo = self._memo
        out = list(map(memo.get, parts))
        if None in out:
            new = list(dict.fromkeys(p for p, x in zip(parts, out) if x is None))
            made = self._new(new)
            out = [made[p] if x is None else x for p, x in zip(parts, out)]
            self._chars += sum(map(len, new)) + 64 * len(new)
            memo.update(made)
            self._bound()
        return b"".join(out)

    def _encode_plain(self, text: str) -> bytes:
        parts = _SPLIT.findall(text)
        out = list(map(self._memo.get, parts))
        if None in out:
            piece = self._piece
            out = [piece(p) if x is None else x for p, x in zip(parts, out)]
            self._bound()
        return b"".join(out)

    def _bound(self) -> None:
        if self._chars > MEMO_CHARS:
            self._memo.clear()
            self._chars = 0

    def ids(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                out.append(self._special_ids[part])
                continue
            for chunk in chunks(part):
                out.append(self._encode_plain(chunk) if _TEXT.match(chunk) else self._encode(units(chunk)))
        return b"".join(out)


def _worker_encoder(path: str) -> Encoder:
    """One encoder per worker process; functions shipped by value have globals of their own in every task, so it
    is kept in a module of the worker."""
    cache = sys.modules.setdefault("linkengine_packing_cache", ModuleType("linkengine_packing_cache"))
    if path not in cache.__dict__:
        setattr(cache, path, Encoder(path))
    return getattr(cache, path)


def decomposition(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; ``longest`` is a power of two."""
    at, size = 0, longest
    while at < n:
        while size > n - at:
            size >>= 1
        yield at, size
        at += size


def _pieces(documents: DataFrame, tokenizer: str, longest: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    path = tokenizer_path(tokenizer)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long, task int, place long").fields])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, taken = _worker_encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[tuple] = []
            held, ids = 0, batch.column("doc_id")

            def handed() -> pa.RecordBatch:
                at, start, length, tokens, n, place = zip(*out)
                arrays = [ids.take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())]
                arrays += [pa.array(n, pa.int64()), pa.array([task] * len(out), pa.int32()), pa.array(place, pa.int64())]
                return pa.RecordBatch.from_arrays(arrays, kind.names)

            for row, value in enumerate(batch.column("text")):
                tokens = encoder.ids(value.as_py() or "") + end
                n = len(tokens) // 4
                for start, length in decomposition(n, longest):
                    place = taken.get(length, 0)
                    taken[length] = place + 1
                    out.append((row, start, length, tokens[4 * start : 4 * (start + length)], n, place))
                    held += 4 * length
                    if held >= OUT_BYTES:
                        yield handed()
                        out, held = [], 0
            if out:
                yield handed()

    return rows.mapInArrow(run, kind)


def pack(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", longest: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ``ids`` are little-endian
    unsigned 32-bit integers."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    pieces = materialize(_pieces(documents, tokenizer, longest, end_id, doc_id, text), "pieces")
    # One row for each task and length; of each length, tasks in order.
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    shifts = materialize(counts.withColumn("shift", before), "shifts")
    sizes = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each power of two
    first, at = {}, 0
    for length in sorted(sizes, reverse=True):
        first[length], at = at, at + sizes[length]
    start = F.create_map(*(F.lit(x).cast("long") for pair in first.items() for x in pair))[F.col("length")] if first else F.lit(0).cast("long")
    joined = lookup_join(pieces, shifts.select("length", "task", "shift"), ["length", "task"], "inner")
    return joined.select("doc_id", "start", "length", "ids", "doc_tokens", (start + F.col("shift") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
