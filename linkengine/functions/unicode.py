"""Unicode white space, stripping and case folding as Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as the inside of a character class.
WS = r"\s\x1c-\x1f\x85\p{Z}"
#: Word characters, as the inside of a character class.
WORD = r"\p{L}\p{N}_"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")


def collapse(s: Column) -> Column:
    """Runs of white space become one space; the ends are stripped."""
    return strip(F.regexp_replace(s, f"[{WS}]+", " "))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Full case folding: one-to-one pairs, and the characters that fold to several."""
    changed = {c: f for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (f := c.casefold()) != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def char_map(pairs: dict[str, str]) -> Column:
    """A map literal from two strings, which keeps plans small; it is folded once."""
    joined = [F.split(F.lit("\n".join(side)), "\n") for side in (pairs, pairs.values())]
    return F.map_from_arrays(*joined)


def casefold(s: Column) -> Column:
    """Full case folding; ASCII rows take the built-in ``lower``."""
    before, after, several = _folds()
    table = char_map(several)
    chars = F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    wide = F.when(s.rlike("[" + "".join(several) + "]"), F.array_join(chars, "")).otherwise(s)
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(wide, before, after))


def truthy(s: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(s, F.lit("")) != ""
