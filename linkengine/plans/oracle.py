"""SQL of the driver's queries, written from the operators' definitions."""

from __future__ import annotations

from ..functions.text import BRACKET_NOISE, METADATA_STARTS, NOISE_PHRASES
from ..functions.translit import CYRILLIC_TO_LATIN, LATIN_GROUPS, LATIN_TO_CYRILLIC

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def sub(s: str, pattern: str, by: str = "", all_: bool = True) -> str:
    return f"regexp_replace({s}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}'{', ' + chr(39) + 'g' + chr(39) if all_ else ''})"


def strip(s: str) -> str:
    return sub(s, f"^[{WS}]+|[{WS}]+$")


def collapse(s: str) -> str:
    return strip(sub(s, f"[{WS}]+", " "))


def round4(x: str) -> str:
    return f"CAST(printf('%.4f', {x}) AS DOUBLE)"


STEPS = [
    ("trimmed_outer_whitespace", strip),
    ("removed_control_characters", lambda s: sub(s, r"[\x00-\x1f\x7f]", " ")),
    ("normalized_dash_characters", lambda s: f"translate({s}, '—–−', '---')"),
    ("removed_list_index_prefix", lambda s: sub(s, rf"^[{WS}]*(?:\p{{Nd}}{{1,4}}[{WS}]*[).\]:-][{WS}]*|[#*][{WS}]+|[•-][{WS}]+)", "", False)),
    ("lowercased_text", lambda s: f"lower({s})"),
    ("removed_special_characters", lambda s: sub(s, rf"[^\p{{L}}\p{{N}}_{WS}\-:|()\[\]&'.,+/]", " ")),
    ("collapsed_whitespace", collapse),
]


def normalized(rows: str, raw: str = "raw_input", keep: str = "*") -> str:
    """A query adding n0..n7, the stages of normalisation."""
    out = f"SELECT {keep}, coalesce({raw}, '') AS n0 FROM {rows}"
    for i, (_, step) in enumerate(STEPS):
        out = f"SELECT *, {step(f'n{i}')} AS n{i + 1} FROM ({out})"
    return out


def clean_field(s: str) -> str:
    return collapse(f"trim({s}, ' ' || chr(9) || '\"''')")


def clean_title(s: str) -> str:
    tag = (
        rf"(?i)[{WS}]*[(\[][{WS}]*(?:official[{WS}]+(?:video|audio)|lyrics?|lyric[{WS}]+video|remaster(?:ed)?|live|"
        rf"music[{WS}]+video|клип|текст)[{WS}]*[)\]][{WS}]*$"
    )
    return clean_field(sub(s, tag, "", False))


def parsed(rows: str, order: str = "artist_title", text: str = "n7") -> str:
    """A query adding artist, title, pattern and confidence to rows with ``text``."""
    sep = rf"(?:[{WS}]+[-|][{WS}]+|:[{WS}]+)"
    rnd, sqr = rf"^(.+?)[{WS}]*\(([^()]+)\)[{WS}]*$", rf"^(.+?)[{WS}]*\[([^\[\]]+)\][{WS}]*$"
    meta = " OR ".join(f"starts_with(b_low, '{m}')" for m in METADATA_STARTS)
    first, second = ("lf", "rt") if order == "artist_title" else ("rt", "lf")
    conf = "0.9" if order == "artist_title" else "0.78"
    head = f"regexp_extract({text}, '{sep}')"
    return f"""
SELECT *, CASE WHEN {text} = '' THEN 'unknown' WHEN has_sep THEN '{order}' WHEN has_b AND is_rnd THEN 'title_artist_parenthesis'
               WHEN has_b THEN 'title_artist_brackets' ELSE 'unknown' END AS pattern,
       CASE WHEN {text} = '' THEN NULL WHEN has_sep THEN s_artist WHEN has_b THEN b_artist END AS artist,
       CASE WHEN {text} = '' THEN NULL WHEN has_sep THEN s_title WHEN has_b THEN {clean_title("b_title")} ELSE {clean_title(text)} END AS title,
       CAST(CASE WHEN {text} = '' THEN 0.0 WHEN has_sep THEN {conf} WHEN has_b THEN 0.82 ELSE 0.25 END AS DOUBLE) AS confidence
FROM (
  SELECT *, sp > 0 AND s_artist <> '' AND s_title <> '' AS has_sep,
         (is_rnd OR is_sqr) AND b_title <> '' AND b_artist <> '' AND NOT ({meta}) AS has_b
  FROM (
    SELECT *, {first} AS s_artist, {clean_title(clean_title(second))} AS s_title, {strip("lower(b_artist)")} AS b_low
    FROM (
      SELECT *, {clean_field(f"CASE WHEN sp > 0 THEN substr({text}, 1, sp - 1) ELSE '' END")} AS lf,
             {clean_field(f"CASE WHEN sp > 0 THEN substr({text}, sp + length(sep)) ELSE '' END")} AS rt,
             {clean_field(f"CASE WHEN is_rnd THEN regexp_extract({text}, '{rnd}', 1) WHEN is_sqr THEN regexp_extract({text}, '{sqr}', 1) ELSE '' END")} AS b_title,
             {clean_field(f"CASE WHEN is_rnd THEN regexp_extract({text}, '{rnd}', 2) WHEN is_sqr THEN regexp_extract({text}, '{sqr}', 2) ELSE '' END")} AS b_artist
      FROM (
        SELECT *, {head} AS sep, CASE WHEN {head} = '' THEN 0 ELSE strpos({text}, {head}) END AS sp,
               regexp_matches({text}, '{rnd}') AS is_rnd, NOT regexp_matches({text}, '{rnd}') AND regexp_matches({text}, '{sqr}') AS is_sqr
        FROM ({rows})
      )
    )
  )
)"""


def language(rows: str, text: str) -> str:
    """A query adding the language columns."""
    return f"""
SELECT *, {round4("CASE WHEN cyr + lat > 0 THEN cyr / (cyr + lat) ELSE 0.0 END")} AS cyrillic_ratio,
       {round4("CASE WHEN cyr + lat > 0 THEN lat / (cyr + lat) ELSE 0.0 END")} AS latin_ratio,
       CASE WHEN cyr + lat = 0 THEN 'unknown' WHEN least(cyr, lat) / (cyr + lat) >= 0.2 THEN 'mixed' WHEN cyr >= lat THEN 'ru' ELSE 'en' END AS language,
       CASE WHEN cyr + lat = 0 THEN 0.0 WHEN least(cyr, lat) / (cyr + lat) >= 0.2 THEN {round4("0.5::DOUBLE + least(cyr, lat) / (cyr + lat)")}
            ELSE {round4("greatest(cyr, lat) / (cyr + lat)")} END AS language_confidence
FROM (SELECT *, CAST(len(regexp_extract_all({text}, '(?i)[а-яё]')) AS DOUBLE) AS cyr, CAST(len(regexp_extract_all({text}, '(?i)[a-z]')) AS DOUBLE) AS lat FROM ({rows}))"""


def to_latin(s: str) -> str:
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    gone = [k for k, v in CYRILLIC_TO_LATIN.items() if not v]
    out = f"translate(lower({s}), '{''.join(single)}{''.join(gone)}', '{''.join(single.values())}')"
    for k, v in CYRILLIC_TO_LATIN.items():
        if len(v) > 1:
            out = f"replace({out}, '{k}', '{v}')"
    return out


def to_cyrillic(s: str) -> str:
    table = ", ".join(f"'{k}': '{v}'" for k, v in {**LATIN_GROUPS, **LATIN_TO_CYRILLIC}.items())
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({s}), '(?s)(?:{'|'.join(LATIN_GROUPS)}|.)'), "
        f"lambda t: coalesce(MAP {{{table}}}[t], t)), '')"
    )


def match_normalize(s: str) -> str:
    phrases = "|".join(p.replace(" ", f"[{WS}]+") for p in NOISE_PHRASES)
    out = sub(strip(f"lower({s})"), "[_|/]+", " ")
    out = sub(out, rf"(?i)\([^)]*(?:{BRACKET_NOISE})[^)]*\)|\[[^\]]*(?:{BRACKET_NOISE})[^\]]*\]", " ")
    return collapse(sub(out, rf"(?i)\b(?:{phrases})\b", " "))


def display(artist: str, title: str) -> str:
    return f"CASE WHEN {strip(f'coalesce({artist}, {chr(39) * 2})')} = '' THEN {title} ELSE {artist} || ' - ' || {title} END"


def jaro(a: str, b: str) -> str:
    """Jaro of two ASCII texts by a fold with struct state."""
    reach = f"greatest(greatest(length({a}), length({b})) // 2 - 1, 0)"
    fold = f"""list_reduce(
      list_prepend({{'r': {b}, 'm': '', 'i': 0}}, list_transform(range(1, length({a}) + 1), lambda i: {{'r': '', 'm': '', 'i': CAST(i AS INTEGER)}})),
      lambda s, x: CASE WHEN strpos(substr(s.r, greatest(x.i - {reach}, 1)::BIGINT, greatest(least(x.i + {reach}, length({b})) - greatest(x.i - {reach}, 1) + 1, 0)::BIGINT), substr({a}, x.i, 1)) > 0
        THEN {{'r': substr(s.r, 1, greatest(x.i - {reach}, 1) - 2 + strpos(substr(s.r, greatest(x.i - {reach}, 1)::BIGINT, greatest(least(x.i + {reach}, length({b})) - greatest(x.i - {reach}, 1) + 1, 0)::BIGINT), substr({a}, x.i, 1)))
               || chr(1) || substr(s.r, greatest(x.i - {reach}, 1) + strpos(substr(s.r, greatest(x.i - {reach}, 1)::BIGINT, greatest(least(x.i + {reach}, length({b})) - greatest(x.i - {reach}, 1) + 1, 0)::BIGINT), substr({a}, x.i, 1))),
              'm': s.m || substr({a}, x.i, 1), 'i': x.i}}
        ELSE {{'r': s.r, 'm': s.m, 'i': x.i}} END)"""
    return fold


def scored(pairs: str, scorer: str) -> str:
    """A query adding score and distance to ``pairs`` of texts a and b."""
    # The engine's distance counts bytes: letters beyond ASCII become free single bytes.
    byte = lambda x: f"translate({x}, 'абвгдежзийклмнопрстуфхцчшщъыьэюяё—', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ~!$%^*<>')"
    distance = f"levenshtein({byte('a')}, {byte('b')})"
    lev = f"SELECT *, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE {round4(f'1.0::DOUBLE - {distance} / CAST(greatest(length(a), length(b)) AS DOUBLE)')} END AS ls, {distance} AS ld FROM ({pairs})"
    folded = f"SELECT *, {jaro('a', 'b')} AS f FROM ({lev})"
    taken = "list_filter(range(1, length(b) + 1), lambda j: substr(f.r, j, 1) = chr(1))"
    m = "CAST(length(f.m) AS DOUBLE)"
    half = f"SELECT *, len(list_filter(range(1, length(f.m) + 1), lambda j: substr(f.m, j, 1) <> substr(b, {taken}[j], 1))) / 2.0::DOUBLE AS t FROM ({folded})"
    j = f"SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' OR f.m = '' THEN 0.0 ELSE ({m} / length(a) + {m} / length(b) + ({m} - t) / {m}) / 3.0::DOUBLE END AS j FROM ({half})"
    prefix = "CASE " + " ".join(f"WHEN length(a) >= {n} AND length(b) >= {n} AND substr(a, 1, {n}) = substr(b, 1, {n}) THEN {n}" for n in (4, 3, 2, 1)) + " ELSE 0 END"
    jw = f"SELECT *, j + {prefix} * 0.1::DOUBLE * (1.0::DOUBLE - j) AS jw FROM ({j})"
    if scorer == "levenshtein":
        return f"SELECT *, ls AS score, CAST(ld AS INTEGER) AS distance FROM ({lev})"
    if scorer == "jaro_winkler":
        return f"SELECT *, {round4('jw')} AS score, CAST(round_even((1.0::DOUBLE - jw) * 10000, 0) AS INTEGER) AS distance FROM ({jw})"
    mix = f"SELECT *, {round4(f'0.35::DOUBLE * ls + 0.65::DOUBLE * {round4(chr(106) + chr(119))}')} AS score FROM ({jw})"
    return f"SELECT *, CAST(round_even((1.0::DOUBLE - score) * 10000, 0) AS INTEGER) AS distance FROM ({mix})"
