"""Transliteration between Cyrillic and Latin script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settle
from .unicode import char_map

#: Latin spelling of each Cyrillic letter; the two signs have none.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Latin letter groups in the order they are tried.
LATIN_GROUPS = {"shch": "щ", "yo": "ё", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я"}
#: Cyrillic spelling of each single Latin letter.
LATIN_TO_CYRILLIC = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к",
    "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в",
    "w": "в", "x": "кс", "y": "й", "z": "з",
}
#: Confidence of a candidate by direction.
CONFIDENCE = {"cyrillic_to_latin": 0.9, "latin_to_cyrillic": 0.45}

CANDIDATE = "struct<text:string,direction:string,confidence:double,explanation:string>"


def to_latin(s: Column) -> Column:
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    gone = [k for k, v in CYRILLIC_TO_LATIN.items() if not v]
    out = F.translate(F.lower(s), "".join([*single, *gone]), "".join(single.values()))
    for letter, spelling in CYRILLIC_TO_LATIN.items():
        if len(spelling) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelling))
    return out


def to_cyrillic(s: Column) -> Column:
    """Greedy from left to right, groups before single letters."""
    pieces = F.regexp_extract_all(F.lower(s), F.lit(f"(?s)({'|'.join(LATIN_GROUPS)}|.)"), F.lit(1))
    table = char_map({**LATIN_GROUPS, **LATIN_TO_CYRILLIC})
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def with_transliterations(df: DataFrame, text: str = "normalized_input", language: str = "language") -> DataFrame:
    """Add ``transliteration_candidates`` and ``transliteration_explanation``."""
    s, lang = F.col(text), F.col(language)

    def candidate(of: Column, direction: str, why: str) -> Column:
        fields = [of.alias("text"), F.lit(direction).alias("direction"), F.lit(CONFIDENCE[direction]).alias("confidence")]
        return F.struct(*fields, F.lit(why).alias("explanation"))

    spellings = {"_latin": F.when(lang.isin("ru", "mixed"), to_latin(s)), "_cyrillic": F.when(lang.isin("en", "mixed"), to_cyrillic(s))}
    df = settle(df, spellings)
    latin = F.when(F.col("_latin") != s, candidate(F.col("_latin"), "cyrillic_to_latin", "Latin spelling of the Cyrillic letters"))
    other = (F.col("_cyrillic") != s) & ~F.col("_cyrillic").eqNullSafe(F.col("_latin"))
    cyrillic = F.when(other, candidate(F.col("_cyrillic"), "latin_to_cyrillic", "approximate Cyrillic spelling of the Latin letters"))
    df = settle(df, {"transliteration_candidates": F.array_compact(F.array(latin, cyrillic)).cast(f"array<{CANDIDATE}>")})
    n = F.size("transliteration_candidates")
    why = F.when(n == 0, "no other spelling for this language").otherwise(F.format_string("%d spelling(s) by rule", n))
    return df.withColumn("transliteration_explanation", why).drop("_latin", "_cyrillic")
