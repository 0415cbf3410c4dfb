"""Token counts of whole texts, huge documents by overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. The tokenizer library
encodes each chunk on its own, with the offsets of its tokens; neighbours are spliced at an
offset in their overlap where a token starts and none is cut in both encodings, and which is
proven stable. If they have no such offset, the overlap is widened and the chunk encoded
again, up to the whole text.

An offset is stable between two characters (``Boundaries``) if what stands on one side of it cannot
change how the other side is encoded:

- The normaliser works on single characters, on white-space runs, or composes (NFC), and the
  character after the offset never composes with one before it.
- The pre-tokenizer's alternatives are runs of one class without look-around, so the split
  after the offset depends on what follows it only, or on a token that spans the offset.
- No special string touches it.
- No token can span it: white space is dropped on one side of it, or no token of the vocabulary
  holds the last byte before it and the first byte after it next to each other. Merges join
  neighbours only, so the two sides then merge independently.

The last rule gives stable offsets inside texts without white space (CJK, base64). The
offsets at the cut ends of a chunk are never used.

A text of one chunk has nothing to splice: it is the sum of its white-space delimited units,
each encoded by the library once per worker and kept in a memo of bounded bytes, since the
same proof holds at white space.

Cases: null counts as empty: 0 bytes and 0 tokens. Repeated rows are counted one by one.
Very long texts are encoded whole, chunk by chunk. Columns other than the text pass through
untouched; added columns replace columns of the same name.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import numbered, remaining

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 256
#: Characters of the units kept per worker, with 64 for each; the memo starts anew beyond it.
MEMO_CHARS = 64 << 20
#: Chunks handed to the library at once.
CHUNK_BATCH = 8
_UNIT = re.compile(r"[^ \t\n\r\f\v]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whitespace_is_stable(definition: dict) -> bool:
    """Whether ASCII white space provably separates what a ``tokenizers`` file encodes."""
    if definition["model"]["type"] != "BPE" or definition.get("post_processor"):
        return False
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in definition["added_tokens"]):
        return False
    norm = definition["normalizer"] or {"type": "Sequence", "normalizers": []}
    for n in norm.get("normalizers", [norm]):
        spaces = n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        if n["type"] not in ("NFC", "NFD", "NFKC", "Lowercase") and not spaces:
            return False
    steps = (definition["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not steps or steps[0]["type"] != "Split" or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        return False
    # Every alternative is a run of characters that are not white space, without look-around.
    pattern = steps[0]["pattern"].get("Regex", "")
    alternatives = pattern.split("|")
    plain = [a for a in alternatives if re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", a)]
    return len(plain) == len(alternatives)


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Boundaries:
    """Which offsets of a text are stable for a byte-level BPE definition."""

    def __init__(self, definition: dict):
        to_byte, suffix = _byte_characters(), definition["model"].get("end_of_word_suffix") or ""
        self._joined: set[tuple[int, int]] = set()
        for token in definition["model"]["vocab"]:
            bytes_ = [to_byte.get(c) for c in (token.removesuffix(suffix) if suffix else token)]
            self._joined.update(zip(bytes_, bytes_[1:]))
        kinds = definition["normalizer"] or {}
        kinds = {n["type"] for n in kinds.get("normalizers", [kinds] if kinds else [])}
        self._composes, self._lowers = "NFC" in kinds, "Lowercase" in kinds
        self._known: dict[tuple[str, str], bool] = {}

    def _plain(self, c: str) -> bool:
        """Whether ``c`` never composes with what precedes it: no mark, no trailing jamo."""
        return unicodedata.category(c)[0] != "M" and not "\u1160" <= c <= "\u11ff" and unicodedata.category(c) != "Cs"

    def _bytes(self, c: str) -> bytes:
        c = unicodedata.normalize("NFC", c) if self._composes else c
        return (c.lower() if self._lowers else c).encode()

    def _stable(self, before: str, after: str) -> bool:
        if not (self._plain(before) and self._plain(after)) or after.isspace():
            return False
        if before in " \t\n\r\f\v":
            return True
        return not before.isspace() and (self._bytes(before)[-1], self._bytes(after)[0]) not in self._joined

    def stable(self, text: str, at: int) -> bool:
        """Whether a token starts at ``at`` whatever stands before it. White space after an
        offset never counts: no token starts there."""
        if not 0 < at < len(text):
            return False
        pair = (text[at - 1], text[at])
        known = self._known.get(pair)
        if known is None:
            if len(self._known) > 1 << 16:
                self._known.clear()
            known = self._known[pair] = self._stable(*pair)
        return known


class LibraryEncoder:
    """The tokenizer library: chunks with offsets, and units with their token counts."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        if not whitespace_is_stable(definition):
            raise ValueError(f"no stable boundaries are proven for {path}")
        self.boundaries = Boundaries(definition)
        self.special = [t["content"] for t in definition["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[str, int] = {}
        self.memo_chars = 0

    def encode(self, chunks: list[str]) -> list[list[tuple[int, int]]]:
        """The offsets of the tokens of each chunk."""
        return [e.offsets for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def counts(self, units: list[str]) -> list[int]:
        """Tokens of each unit; unknown ones are learnt through the library in batches."""
        out = list(map(self.memo.get, units))
        if None in out:
            parts = {u: self._parts(u) for u, n in zip(units, out) if n is None}
            if self.memo_chars > MEMO_CHARS:
                self.memo.clear()
                self.memo_chars = 0
            memo, fresh = self.memo, {u: n for u, n in zip(units, out) if n is not None}
            new = list({p for both in parts.values() for p in both if p not in memo})
            for at in range(0, len(new), 4096):
                block = new[at : at + 4096]
                fresh.update(zip(block, map(len, self.tokenizer.encode_batch_fast(block, add_special_tokens=False))))
            for unit, both in parts.items():
                fresh[unit] = sum(fresh[p] if p in fresh else memo[p] for p in both)
            out = [n if n is not None else fresh[u] for n, u in zip(out, units)]
            self.memo_chars += sum(len(u) + 64 for u in fresh if u not in memo)
            memo.update(fresh)
        return out

    @staticmethod
    def _parts(unit: str) -> tuple[str, ...]:
        """The unit, cut before closing full stops and commas if these follow an ASCII
        letter: a run of letters ends there, and a run of marks goes to the unit's end."""
        stem = unit.rstrip(".,")
        if 0 < len(stem) < len(unit) and stem[-1].isascii() and stem[-1].isalpha():
            return stem, unit[len(stem) :]
        return (unit,)

    def count(self, text: str) -> int:
        return sum(self.counts(_UNIT.findall(text)))


class _Chunk:
    """Text [low, high) and its tokens, in offsets of the whole text."""

    def __init__(self, low: int, high: int, offsets: list[tuple[int, int]]):
        self.low, self.high = low, high
        self.starts = [low + a for a, _ in offsets]
        self.ends = [low + b for _, b in offsets]

    def before(self, at: int) -> int:
        """How many tokens start before ``at``."""
        return bisect_left(self.starts, at)

    def clean(self, at: int) -> bool:
        """Whether a token starts at ``at`` and none is cut by it."""
        i = bisect_left(self.starts, at)
        return i < len(self.starts) and self.starts[i] == at and (i == 0 or self.ends[i - 1] <= at)


def _cut(text: str, left: _Chunk, right: _Chunk, after: int, encoder) -> int | None:
    """The first stable offset beyond ``after`` inside the overlap where both start a token."""
    low, high = max(after, right.low) + 1, min(left.high, right.high)
    for i in range(bisect_left(right.starts, low), len(right.starts)):
        at = right.starts[i]
        if at >= high:
            return None
        if left.clean(at) and right.clean(at) and encoder.boundaries.stable(text, at):
            # Special strings split texts before all else, and a chunk may hold part of one only.
            if not any(s in text[max(0, at - len(s)) : at + len(s)] for s in encoder.special):
                return at
    return None


def count_tokens(text: str, encoder, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one whole text; equal to encoding it at once."""
    size = len(text)
    if size <= chunk_chars:
        return encoder.count(text)
    spans = [(max(0, a - overlap), min(size, a + chunk_chars)) for a in range(0, size, chunk_chars)]

    def chunks() -> Iterator[_Chunk]:
        for i in range(0, len(spans), CHUNK_BATCH):
            part = spans[i : i + CHUNK_BATCH]
            for (a, b), offsets in zip(part, encoder.encode([text[a:b] for a, b in part])):
                yield _Chunk(a, b, offsets)

    def one(a: int, b: int) -> _Chunk:
        return _Chunk(a, b, encoder.encode([text[a:b]])[0])

    total, at, left = 0, 0, None
    for right in chunks():
        if left is None:
            left = right
            continue
        high, wide = right.high, overlap
        while (cut := _cut(text, left, right, at, encoder)) is None and right.low > left.low:
            wide *= 2
            right = one(max(left.low, left.high - wide), high)
        if cut is None:
            # No stable offset in the whole left chunk: both become one.
            left = one(left.low, high)
            continue
        total += left.before(cut) - left.before(at)
        at, left = cut, right
    return total + len(left.starts) - left.before(at)


def _worker_encoder(tokenizer: str) -> LibraryEncoder:
    """One encoder per worker process; functions shipped by value have globals of their
    own in every task, so the memo is kept in a module of the worker."""
    import os
    import sys
    from types import ModuleType

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = sys.modules.setdefault("linkengine_worker_cache", ModuleType("linkengine_worker_cache"))
    if getattr(cache, "encoder_of", None) != tokenizer:
        cache.encoder = LibraryEncoder(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer))
        cache.encoder_of = tokenizer
    return cache.encoder


def with_token_counts(documents: DataFrame, tokenizer: str, text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` to every row; ``tokenizer`` is a file name of the
    public tokenizer folder or a path every executor can open."""
    names = remaining(documents, ["n_bytes", "n_tokens"])
    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            n_tokens = pa.array([count_tokens(t, encoder, chunk_chars, overlap) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n_bytes, n_tokens], [*names, "n_bytes", "n_tokens"])

    return documents.select(*numbered(names)).mapInArrow(run, schema)
