"""The driver's queries over its tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language, patterns, similarity, text, translit
from ..functions.settle import settle
from ..functions.similarity import SCORERS
from ..functions.staging import lookup_join, materialize, shared_dir
from ..operators import evaluation, lists, matching, parsing, stats, tables, topk_join, validation, variants
from ..sources import export, lines, rest, search_source
from ..sources import list_files as list_files_sink
from . import link
from . import oracle as Q

#: Fixed lines that exercise every rule, in both scripts.
SAMPLE_LINES = [
    "  07) BLUE HARBOR — Night   Train (live) [текст]", "Night Train (Blue Harbor)", "Night Train [Blue Harbor]",
    "Night Train (feat. Someone)", "ледокол: белый шум", "Ledokol | Белый шум", "* one bare title", "01. ", " ", "",
    "• Виктор  Цой - Звезда", "tshch - jx", "Щи да каша: подъезд", "12 - Only (Lyrics) (Live)", "- Trailing (x) [y]",
]

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(spark: SparkSession) -> DataFrame:
    return lines.from_list(spark, SAMPLE_LINES)


def _sample_sql() -> str:
    rows = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(SAMPLE_LINES))
    return f"(SELECT CAST(a AS BIGINT) AS line_id, b AS raw_input FROM (VALUES {rows}) v(a, b))"


#: Every part as a line, in one of six shapes.
_SHAPES = [
    ("upper(p_brand) || ' - ' || p_name", "artist_title"),
    ("p_name || ' (' || p_brand || ')'", "title_artist_parenthesis"),
    ("p_name || ' [' || p_brand || ']'", "title_artist_brackets"),
    ("(p_partkey % 100) || '. ' || p_brand || ': ' || p_name || ' (live)'", "artist_title"),
    ("'#  ' || p_name", "unknown"),
    ("'  ' || p_brand || ' — ' || p_name || ' (Official Video) [lyrics] '", "artist_title"),
]
_LINE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, (s, _) in enumerate(_SHAPES)) + " END"
_PART_SQL = f"(SELECT p_partkey AS line_id, {_LINE} AS raw_input FROM part)"


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.expr(_LINE).alias("raw_input"), "p_brand", "p_name")


def catalogs(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Two sources: part names with their least brand, and nations without an artist."""
    part = _t(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("key"), F.min("p_brand").alias("p_brand"))
    shop = lines.catalog_from(part, F.concat(F.lit("part:"), F.col("key").cast("string")), F.col("p_brand"), F.col("p_name"), F.col("key"))
    nation = _t(spark, sf_dir, "nation")
    place = lines.catalog_from(nation, F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), F.lit(None).cast("string"), F.col("n_name"), F.col("n_nationkey").cast("long"))
    return [("shop", shop), ("place", place)]


_CATALOG_SQL = """
  SELECT 'shop' AS source, 'part:' || min(p_partkey) AS track_id, min(p_brand) AS artist, p_name AS title, 0 AS provider_ord, min(p_partkey) AS cand_ord
  FROM part GROUP BY p_name
  UNION ALL
  SELECT 'place', 'nation:' || n_nationkey, NULL, n_name, 1, CAST(n_nationkey AS BIGINT) FROM nation
"""
_CANDIDATES_SQL = f"(SELECT *, {Q.match_normalize('display_text')} AS b FROM (SELECT *, {Q.display('artist', 'title')} AS display_text FROM ({_CATALOG_SQL})))"


# Normalisation, language, transliteration


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.split_text(_t(spark, sf_dir, "documents"))
    return text.with_normalized(rows).select("doc_id", F.col("line_id").cast("int").alias("line_id"), "normalized_input")


_NORMALIZE_LINES = f"""
SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, n7 AS normalized_input FROM (
{Q.normalized(f"(SELECT doc_id, line_id, {Q.strip('line')} AS raw_input FROM (SELECT doc_id, unnest(range(len(ls))) AS line_id, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))")}
) WHERE raw_input <> ''"""


def _normalized_steps(rows: DataFrame) -> DataFrame:
    return text.with_normalized(rows).select("line_id", "normalized_input", F.array_join("normalization_steps", ",").alias("steps"))


def _steps_sql(rows: str) -> str:
    log = ", ".join(f"CASE WHEN n{i} <> n{i + 1} THEN '{name}' END" for i, (name, _) in enumerate(Q.STEPS))
    return f"SELECT line_id, n7 AS normalized_input, concat_ws(',', {log}) AS steps FROM ({Q.normalized(rows)})"


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.with_language(_t(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", "language", "language_confidence", "cyrillic_ratio", "latin_ratio")


def sample_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.with_language(text.with_normalized(_sample(spark)))
    return rows.select("line_id", "language", "language_confidence", "cyrillic_ratio", "latin_ratio")


def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.col("p_name").alias("s"))
    rows = names.union(_sample(spark))
    return rows.select("line_id", translit.to_latin(F.col("s")).alias("latin"), translit.to_cyrillic(F.col("s")).alias("cyrillic"))


# Patterns


def _parse(rows: DataFrame, order: str = "artist_title") -> DataFrame:
    parsed = parsing.parse(rows, order)
    return parsed.select("line_id", "normalized_input", "artist", "title", "pattern", "confidence")


def _parse_sql(rows: str, order: str = "artist_title") -> str:
    return f"SELECT line_id, n7 AS normalized_input, artist, title, pattern, confidence FROM ({Q.parsed(Q.normalized(rows), order)})"


def _detect_sql() -> str:
    # The detector's own normalisation: dashes, outer white space, index prefix, quotes; case stays.
    steps = dict(Q.STEPS)
    n = steps["removed_list_index_prefix"](Q.strip(steps["normalized_dash_characters"]("raw_input")))
    rows = f"(SELECT line_id, {Q.clean_field(n)} AS nd FROM {_PART_SQL})"
    return f"SELECT line_id, nd AS normalized_input, artist, title, pattern, confidence FROM ({Q.parsed(rows, text='nd')})"


def parse_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.split_text(_t(spark, sf_dir, "documents"))
    parsed = patterns.with_pattern(text.with_normalized(rows)).filter("normalized_input <> ''")
    return parsed.groupBy("pattern").agg(F.count("*").alias("n_lines"), F.count("artist").alias("n_artists"))


_PATTERN_COUNTS = f"""
SELECT pattern, count(*) AS n_lines, count(artist) AS n_artists FROM (
{Q.parsed(Q.normalized(f"(SELECT doc_id, {Q.strip('line')} AS raw_input FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"))}
) WHERE raw_input <> '' AND n7 <> '' GROUP BY pattern"""


def match_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    artist = F.when(F.col("line_id") % 7 != 0, F.col("p_brand"))
    shown = text.display_text(artist, F.col("raw_input"))
    return part_lines(spark, sf_dir).select("line_id", shown.alias("display_text"), text.match_normalize(shown).alias("normalized"))


_MATCH_NORMALIZED = f"""
SELECT line_id, d AS display_text, {Q.match_normalize("d")} AS normalized FROM (
  SELECT p_partkey AS line_id, {Q.display("CASE WHEN p_partkey % 7 <> 0 THEN p_brand END", f"({_LINE})")} AS d FROM part)"""


# Matching


def _part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_lines(spark, sf_dir).select("line_id", F.col("raw_input").alias("query"))


def _topk(scorer: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = matching.rank(_part_queries(spark, sf_dir), matching.union_catalogs(catalogs(spark, sf_dir)), scorer, 3)
        return ranked.select("line_id", "rank", "source", "track_id", "score", "distance")

    return run


def _ranked_sql(scorer: str, partition: str, k: int, queries: str = f"(SELECT line_id, raw_input AS query FROM {_PART_SQL})") -> str:
    return f"""
WITH q AS (SELECT *, {Q.match_normalize("query")} AS a FROM {queries}), c AS (SELECT * FROM {_CANDIDATES_SQL}),
s AS ({Q.scored("SELECT x.a, y.b FROM (SELECT DISTINCT a FROM q) x, (SELECT DISTINCT b FROM c) y", scorer)}),
r AS (
  SELECT q.*, c.* EXCLUDE (b), s.score, s.distance, s.b,
         CAST(row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, distance, display_text DESC, provider_ord, cand_ord) AS INTEGER) AS rank
  FROM q JOIN s USING (a) JOIN c USING (b)
  QUALIFY rank <= {k}
)"""


def similar_fields(rows: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """``rows`` whose two texts, as the scorers compare them, have a Jaro-Winkler ``score`` of at least ``least``.

    Distinct pairs of texts are normalised and scored once, each expression behind a barrier, since the optimizer otherwise
    writes it out at each of its uses.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.select(left, right).distinct().repartition(parts, left, right)
    pairs = settle(pairs, {"_a": text.match_normalize(F.col(left)), "_b": text.match_normalize(F.col(right))})
    pairs = settle(pairs, {"score": similarity.jaro_winkler_score(F.col("_a"), F.col("_b"))})
    near = materialize(pairs.filter(F.col("score") >= least).select(left, right, "score"), "near")
    return lookup_join(rows, near, [left, right], "inner")


def jaro_winkler_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose line is similar to their own name, by an expression in a filter."""
    rows = part_lines(spark, sf_dir).select("line_id", "raw_input", "p_name")
    return similar_fields(rows, "raw_input", "p_name", 0.7).select("line_id", "score")


def _jaro_filter_sql() -> str:
    pairs = f"SELECT p_partkey AS line_id, {Q.match_normalize(f'({_LINE})')} AS a, {Q.match_normalize('p_name')} AS b FROM part"
    scored = Q.scored(f"SELECT DISTINCT a, b FROM ({pairs})", "jaro_winkler")
    return f"SELECT line_id, score FROM ({pairs}) JOIN ({scored}) USING (a, b) WHERE score >= 0.7"


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every brand and name without its last letter, by the indexed join, and how many share its score."""
    full = F.lower(F.concat_ws(" ", "p_brand", "p_name"))
    names = _t(spark, sf_dir, "part").select(full.alias("b"), F.expr("substring(lower(concat_ws(' ', p_brand, p_name)), 1, length(concat_ws(' ', p_brand, p_name)) - 1)").alias("a"))
    found = topk_join.top_texts(names, names.select(F.lit("").alias("grp"), "b"), "levenshtein", 1)
    best = found.groupBy("a").agg(F.max("score").alias("score"))
    return found.join(best, ["a", "score"]).groupBy("a", "score").agg(F.min("b").alias("b"), F.count("*").alias("n_best"))


_NEAREST = f"""
WITH t AS (SELECT DISTINCT lower(p_brand || ' ' || p_name) AS b FROM part),
q AS (SELECT DISTINCT substring(b, 1, length(b) - 1) AS a FROM t),
s AS ({Q.scored("SELECT a, b FROM q, t", "levenshtein")})
SELECT a, score, min(b) AS b, count(*) AS n_best FROM (SELECT *, max(score) OVER (PARTITION BY a) AS top FROM s) WHERE score = top GROUP BY a, score"""


def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.search(_part_queries(spark, sf_dir), catalogs(spark, sf_dir), 2)
    return found.select("line_id", "source", "rank", "track_id", "score", "distance")


def search_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _sample(spark).select("line_id", F.col("raw_input").alias("query"))
    found = matching.search(queries, catalogs(spark, sf_dir)[:1], 5)
    return matching.source_reports(queries, found, ["shop", "place"], {"place": "rate_limited"}).withColumn("candidate_count", F.col("candidate_count").cast("int"))


_REPORTS = f"""
SELECT line_id, source, CASE source WHEN 'shop' THEN 'success' ELSE 'failed' END AS status,
       CAST(CASE source WHEN 'shop' THEN (SELECT least(count(DISTINCT p_name), 5) FROM part) ELSE 0 END AS INTEGER) AS candidate_count,
       CASE source WHEN 'place' THEN 'rate_limited' END AS error_code
FROM {_sample_sql()}, (VALUES ('shop'), ('place')) v(source) WHERE {Q.strip("raw_input")} <> ''"""


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sample(spark).union(part_lines(spark, sf_dir).select("line_id", "raw_input"))
    made = variants.with_variants(parsing.parse(rows)).select("line_id", "raw_input", F.posexplode("query_variants").alias("ord", "v"))
    return made.select("line_id", "raw_input", "ord", F.col("v.text").alias("text"), F.col("v.source").alias("source"), F.col("v.confidence").alias("confidence"))


def _variants_sql(rows: str) -> str:
    """(line_id, raw_input, ord, text, source, confidence) of rows (line_id, raw_input)."""
    keys = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in variants.ALIASES.items())
    conf = Q.round4("confidence")
    every = f"""
      CASE WHEN coalesce(artist, '') <> '' AND coalesce(title, '') <> '' THEN {{'t': artist || ' - ' || title, 's': 'parsed_fields', 'c': {conf}}}
           WHEN coalesce(title, '') <> '' THEN {{'t': title, 's': 'parsed_title', 'c': {conf}}} END,
      CASE WHEN c1 IS NOT NULL THEN {{'t': c1 || ' - ' || title, 's': 'artist_alias', 'c': 0.95::DOUBLE}} END,
      CASE WHEN c1 IS NOT NULL THEN {{'t': c2 || ' - ' || title, 's': 'artist_alias', 'c': 0.95::DOUBLE}} END,
      CASE WHEN c1 IS NOT NULL THEN {{'t': {Q.to_latin("c1 || ' - ' || title")}, 's': 'artist_alias', 'c': 0.95::DOUBLE}} END,
      CASE WHEN c1 IS NOT NULL THEN {{'t': {Q.to_latin("c2 || ' - ' || title")}, 's': 'artist_alias', 'c': 0.95::DOUBLE}} END,
      CASE WHEN n7 <> '' THEN {{'t': n7, 's': 'normalized_input', 'c': {Q.round4("greatest(confidence * 0.8::DOUBLE, 0.1::DOUBLE)")}}} END,
      CASE WHEN language IN ('ru', 'mixed') AND {Q.to_latin("n7")} <> n7 THEN {{'t': {Q.to_latin("n7")}, 's': 'transliteration:cyrillic_to_latin', 'c': 0.9::DOUBLE}} END,
      CASE WHEN language IN ('en', 'mixed') AND {Q.to_cyrillic("n7")} <> n7 THEN {{'t': {Q.to_cyrillic("n7")}, 's': 'transliteration:latin_to_cyrillic', 'c': 0.45::DOUBLE}} END"""
    folded = "list_transform(vs, lambda v: lower(v.t))"
    return f"""
SELECT line_id, raw_input, CAST(unnest(range(len(kept))) AS INTEGER) AS ord, unnest(kept).t AS text, unnest(kept).s AS source, unnest(kept).c AS confidence
FROM (SELECT *, list_filter(vs, lambda v, i: list_position({folded}, lower(v.t)) = i) AS kept
FROM (SELECT line_id, raw_input, list_transform(list_filter([{every}], lambda v: v IS NOT NULL AND {Q.collapse("v.t")} <> ''), lambda v: {{'t': {Q.collapse("v.t")}, 's': v.s, 'c': v.c}}) AS vs
FROM ({Q.language(Q.parsed(Q.normalized(rows)), "n7")}) LEFT JOIN (VALUES {keys}) al(k, c1, c2) ON k = {Q.collapse("lower(artist)")}))"""


def parse_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_lines(spark, sf_dir).select("line_id", "raw_input")
    items, matches = link.parse_and_match(rows, catalogs(spark, sf_dir), 3)
    flags = items.select("line_id", "best_score", "is_uncertain")
    ranked = matches.select("line_id", "rank", "source", "track_id", "score", "distance", "query_variant_source", "query_variant_confidence")
    return flags.join(ranked.hint("merge"), "line_id", "left")


def uncertain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_lines(spark, sf_dir).select("line_id", "raw_input")
    return link.count_uncertain(rows, catalogs(spark, sf_dir), 3)


def _linked_sql(tail: str) -> str:
    """CTEs of the whole plan over the parts' lines, with ``m`` the ranked matches."""
    search = "CASE WHEN coalesce(artist, '') <> '' AND coalesce(title, '') <> '' THEN artist || ' - ' || title WHEN coalesce(title, '') <> '' THEN title ELSE n7 END"
    queries = f"(SELECT line_id, {search} AS query FROM ({Q.parsed(Q.normalized(_PART_SQL))}))"
    better = "score DESC, confidence DESC, distance"
    return f"""{_ranked_sql("hybrid", "line_id, source", 3, queries)},
v AS (SELECT *, {Q.match_normalize("text")} AS va FROM ({_variants_sql(_PART_SQL)})),
p AS (SELECT v.line_id, v.ord, v.source AS vs, v.confidence, v.va, r.source, r.track_id, r.display_text, r.b, r.rank AS fr, r.provider_ord, r.cand_ord FROM v JOIN r USING (line_id)),
ps AS (SELECT a AS va, b, score, distance FROM ({Q.scored("SELECT DISTINCT va AS a, b FROM p", "hybrid")})),
best AS (
  SELECT * FROM p JOIN ps USING (va, b)
  QUALIFY row_number() OVER (PARTITION BY line_id, source, track_id ORDER BY {better}, ord, fr) = 1
), m AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY line_id ORDER BY {better}, display_text DESC, ord, provider_ord, cand_ord) AS INTEGER) AS rank FROM best QUALIFY rank <= 3
), i AS (
  SELECT l.line_id, coalesce(m.score, 0.0) AS best_score, coalesce(m.score, 0.0) < 0.8 AS is_uncertain
  FROM {_PART_SQL} l LEFT JOIN m ON m.line_id = l.line_id AND m.rank = 1
)
{tail}"""


# Evaluation


def _labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.col("line_id") % 6
    pattern = F.element_at(F.array(*(F.lit(p) for _, p in _SHAPES)), (shape + 1).cast("int"))
    return part_lines(spark, sf_dir).select(
        "line_id", "raw_input", F.when(shape != 4, F.col("p_brand")).alias("expected_artist"), F.col("p_name").alias("expected_title"), pattern.alias("expected_pattern")
    )


def eval_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate_parser(_labelled_lines(spark, sf_dir))


def _eval_parser_sql() -> str:
    patterns_sql = ", ".join(f"'{p}'" for _, p in _SHAPES)
    same = lambda a, b: f"{Q.collapse(f'lower({a})')} IS NOT DISTINCT FROM {Q.collapse(f'lower({b})')}"
    ratio = lambda x: Q.round4(f"sum(CAST({x} AS INTEGER)) / CAST(count(*) AS DOUBLE)")
    return f"""
SELECT count(*) AS total, {ratio("am")} AS artist_accuracy, {ratio("tm")} AS title_accuracy, {ratio("pm")} AS pattern_accuracy, {ratio("am AND tm AND pm")} AS exact_accuracy
FROM (SELECT {same("artist", "CASE WHEN line_id % 6 <> 4 THEN p_brand END")} AS am, {same("title", "p_name")} AS tm, pattern = [{patterns_sql}][line_id % 6 + 1] AS pm
      FROM ({Q.parsed(Q.normalized(_PART_SQL))}) JOIN part ON p_partkey = line_id)"""


def _labelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    ids = part.groupBy("p_name").agg(F.concat(F.lit("part:"), F.min("p_partkey").cast("string")).alias("expected_track_id"))
    return part_lines(spark, sf_dir).join(F.broadcast(ids), "p_name").select("line_id", F.col("raw_input").alias("query"), "expected_track_id")


def compare_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare_matchers(_labelled_queries(spark, sf_dir), catalogs(spark, sf_dir), 3)


def _compare_sql() -> str:
    ctes = _ranked_sql("hybrid", "line_id, source", 3)
    parts = []
    for name in sorted(SCORERS):
        ctes += f""",
t_{name} AS (
  SELECT r.line_id, r.track_id, z.score,
         row_number() OVER (PARTITION BY r.line_id ORDER BY z.score DESC, z.distance, r.display_text DESC, r.provider_ord, r.rank) AS k
  FROM r JOIN ({Q.scored("SELECT DISTINCT a, b FROM r", name)}) z USING (a, b) QUALIFY k <= 3
), c_{name} AS (
  SELECT line_id, max(CASE WHEN k = 1 THEN track_id END) AS t1, list(track_id) AS tk, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2
  FROM t_{name} GROUP BY line_id
)"""
        ratio = lambda x: Q.round4(f"sum(CAST({x} AS INTEGER)) / CAST(count(*) AS DOUBLE)")
        parts.append(f"""
SELECT count(*) AS total, {ratio("t1 = e")} AS top_1_accuracy, {ratio("list_contains(tk, e)")} AS top_k_accuracy,
       CAST(count(*) FILTER (WHERE s2 IS NOT NULL AND {Q.round4("s1 - s2")} <= 0.05) AS BIGINT) AS ambiguous_count, '{name}' AS algorithm
FROM c_{name} JOIN part ON p_partkey = line_id JOIN (SELECT p_name, 'part:' || min(p_partkey) AS e FROM part GROUP BY p_name) USING (p_name)""")
    return ctes + " UNION ALL ".join(parts)


def matcher_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = evaluation.matcher_cases(_labelled_queries(spark, sf_dir), catalogs(spark, sf_dir), "levenshtein", 3)
    return cases.drop("query")


def _cases_sql() -> str:
    return f"""{_ranked_sql("hybrid", "line_id, source", 3)},
top AS (
  SELECT r.line_id, r.track_id, z.score, row_number() OVER (PARTITION BY r.line_id ORDER BY z.score DESC, z.distance, r.display_text DESC, r.provider_ord, r.rank) AS k
  FROM r JOIN ({Q.scored("SELECT DISTINCT a, b FROM r", "levenshtein")}) z USING (a, b) QUALIFY k <= 3
), cases AS (
  SELECT line_id, max(CASE WHEN k = 1 THEN track_id END) AS t1, list(track_id) AS tk, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2 FROM top GROUP BY line_id
)
SELECT line_id, e AS expected_track_id, t1 = e AS top_1_matched, list_contains(tk, e) AS top_k_matched, s1 AS top_1_score, coalesce(s2, 0.0) AS runner_up_score,
       {Q.round4("s1 - coalesce(s2, 0.0)")} AS score_margin, s2 IS NOT NULL AND {Q.round4("s1 - coalesce(s2, 0.0)")} <= 0.05 AS is_ambiguous
FROM cases JOIN part ON p_partkey = line_id JOIN (SELECT p_name, 'part:' || min(p_partkey) AS e FROM part GROUP BY p_name) USING (p_name)"""


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary_text(eval_parser(spark, sf_dir))


def _eval_summary_sql() -> str:
    names = ["artist_accuracy", "title_accuracy", "pattern_accuracy", "exact_accuracy"]
    parts = " || chr(10) || ".join(f"'{n}=' || printf('%.4f', {n})" for n in names)
    return f"SELECT 'total=' || total || chr(10) || {parts} AS summary FROM ({_eval_parser_sql()})"


# Lists


_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as list items: position by all their columns, score 1 - discount."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER)
    rows = _t(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(order) - 1)
    score = F.when(F.col("l_linenumber") != 7, F.lit(1.0) - F.col("l_discount"))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("position")).alias("item_id"), F.col("l_orderkey").alias("playlist_id"), "position",
        F.format_string("line %d, \"%s\"", "l_linenumber", "l_returnflag").alias("raw_input"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).alias("parsed_artist"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("parsed_title"), F.col("l_tax").alias("parser_confidence"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("match_track_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("https://example.org/"), F.col("l_partkey").cast("string"))).alias("match_external_url"),
        score.alias("match_score"), F.col("l_returnflag").alias("match_algorithm"), F.col("l_linestatus").alias("source"),
        (F.coalesce(score, F.lit(0.0)) < 0.95).alias("is_uncertain"), F.lit('{"parsed_track":{"title":"x"}}').alias("metadata_json"),
    )


_ITEMS_SQL = f"""(SELECT l_orderkey || '-' || position AS item_id, l_orderkey AS playlist_id, position,
  'line ' || l_linenumber || ', "' || l_returnflag || '"' AS raw_input,
  CASE WHEN l_linenumber % 3 <> 0 THEN 'Supplier ' || l_suppkey END AS parsed_artist, 'Part ' || l_partkey AS parsed_title, l_tax AS parser_confidence,
  'p' || l_partkey AS match_track_id, CASE WHEN l_linenumber % 2 = 0 THEN 'https://example.org/' || l_partkey END AS match_external_url,
  match_score, l_returnflag AS match_algorithm, l_linestatus AS source, coalesce(match_score, 0.0) < 0.95 AS is_uncertain, '{{"parsed_track":{{"title":"x"}}}}' AS metadata_json
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ITEM_ORDER)}) - 1 AS INTEGER) AS position,
             CASE WHEN l_linenumber <> 7 THEN 1.0::DOUBLE - l_discount END AS match_score FROM lineitem))"""


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at")
    )


def list_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.totals(order_items(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("avg_match_score", "avg_parser_confidence")})


_TOTALS = f"""
SELECT playlist_id, count(*) AS total_items, count(*) FILTER (WHERE is_uncertain) AS uncertain_items, count(*) FILTER (WHERE NOT is_uncertain) AS confirmed_items,
       round(avg(match_score), 9) AS avg_match_score, round(avg(parser_confidence), 9) AS avg_parser_confidence
FROM {_ITEMS_SQL} GROUP BY playlist_id"""


def _counts(column: str) -> Query:
    return lambda spark, sf_dir: stats.counts_by(order_items(spark, sf_dir), column)


def uncertain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.uncertain_positions(order_items(spark, sf_dir))
    return rows.select("playlist_id", F.array_join(F.col("uncertain_positions").cast("array<string>"), ",").alias("positions"))


_POSITIONS = f"SELECT playlist_id, coalesce(string_agg(CASE WHEN is_uncertain THEN CAST(position AS VARCHAR) END, ',' ORDER BY position), '') AS positions FROM {_ITEMS_SQL} GROUP BY playlist_id"


def list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps as ``key=n`` and positions as numbers, in order, so that SQL can return the same."""
    rows = stats.list_stats(order_items(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    averages = [F.round(c, 9).alias(c) for c in ("avg_match_score", "avg_parser_confidence")]
    positions = F.array_join(F.col("uncertain_positions").cast("array<string>"), ",").alias("uncertain_positions")
    return rows.select("playlist_id", "total_items", "uncertain_items", "confirmed_items", *averages, positions, *(flat(c).alias(c) for c in ("source_counts", "algorithm_counts")))


def _stats_sql() -> str:
    counts = lambda c: f"SELECT playlist_id, string_agg({c} || '=' || n, ',' ORDER BY {c}) AS t FROM (SELECT playlist_id, {c}, count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY playlist_id"
    return f"""
WITH items AS MATERIALIZED {_ITEMS_SQL}
SELECT playlist_id, count(*) AS total_items, count(*) FILTER (WHERE is_uncertain) AS uncertain_items, count(*) FILTER (WHERE NOT is_uncertain) AS confirmed_items, round(avg(match_score), 9) AS avg_match_score, round(avg(parser_confidence), 9) AS avg_parser_confidence,
       coalesce(string_agg(CASE WHEN is_uncertain THEN CAST(position AS VARCHAR) END, ',' ORDER BY position), '') AS uncertain_positions,
       any_value(s.t) AS source_counts, any_value(a.t) AS algorithm_counts
FROM items LEFT JOIN ({counts("source")}) s USING (playlist_id) LEFT JOIN ({counts("match_algorithm")}) a USING (playlist_id) GROUP BY playlist_id"""


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their items as tables bucketed by list."""
    own = uuid.uuid4().hex
    made = tables.save_by_list(order_lists(spark, sf_dir), f"lists_{own}", 8, path=f"{shared_dir(spark)}/lists-{own}")
    return made, tables.save_by_list(order_items(spark, sf_dir), f"items_{own}", 8, ("playlist_id", "position"), f"{shared_dir(spark)}/items-{own}")


def bucketed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the lists that are left when those of open orders are deleted, over bucketed tables."""
    made, items = _bucketed(spark, sf_dir)
    gone = made.join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("playlist_id"), "o_orderstatus"), "playlist_id").filter("o_orderstatus = 'O'")
    kept, items = lists.delete_lists(made, items, gone)
    return lists.summaries(kept, items).select("playlist_id", "session_id", "name", "total_items", "uncertain_count")


def new_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for every customer, named by the segment, by blanks or not at all; what breaks a limit is left out."""
    n = F.col("c_custkey") % 5
    name = F.when(n == 0, F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit("  "))).when(n == 1, " \n").when(n == 2, F.repeat("c_mktsegment", 60)).when(n == 3, "")
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("playlist_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise("").alias("session_id"), name.alias("name"))
    return validation.checked(lists.new_lists(asked)).select("playlist_id", "session_id", "name")


_NEW_LISTS = """
SELECT * FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS playlist_id, c_name AS session_id,
         CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 2 THEN repeat(c_mktsegment, 60) ELSE 'Untitled Playlist' END AS name
  FROM customer WHERE c_custkey % 7 <> 0
) WHERE length(name) <= 255"""


def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asked for under its own list and, in vain, under the next one."""
    items = order_items(spark, sf_dir).select("item_id", "playlist_id", "match_track_id")
    wanted = items.select("item_id", "playlist_id").union(items.select("item_id", F.col("playlist_id") + 1))
    return lists.lookup_items(items, wanted)


_LOOKUP = f"""
SELECT w.item_id, w.playlist_id, i.match_track_id, i.item_id IS NOT NULL AS found
FROM (SELECT item_id, playlist_id FROM {_ITEMS_SQL} UNION SELECT item_id, playlist_id + 1 FROM {_ITEMS_SQL}) w
LEFT JOIN {_ITEMS_SQL} i ON i.item_id = w.item_id AND i.playlist_id = w.playlist_id"""


def list_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lists.summaries(order_lists(spark, sf_dir), order_items(spark, sf_dir))
    return rows.select("playlist_id", "session_id", "name", "total_items", "uncertain_count")


_SUMMARIES = f"""
SELECT o_orderkey AS playlist_id, CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS name, coalesce(n, 0) AS total_items, coalesce(u, 0) AS uncertain_count
FROM orders LEFT JOIN (SELECT playlist_id, count(*) AS n, count(*) FILTER (WHERE is_uncertain) AS u FROM {_ITEMS_SQL} GROUP BY playlist_id) ON playlist_id = o_orderkey"""


def build_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' lines, linked and built into seven lists, with some of the metadata."""
    rows = part_lines(spark, sf_dir).select("line_id", "raw_input")
    items, _ = link.parse_and_match(rows, catalogs(spark, sf_dir), 3)
    built = lists.build_items(items.withColumn("playlist_id", F.concat(F.lit("list-"), (F.col("line_id") % 7).cast("string"))))
    meta = lambda path: F.get_json_object("metadata_json", f"$.{path}")
    columns = ["item_id", "playlist_id", "position", "raw_input", "parsed_artist", "parsed_title", "parser_confidence", "match_track_id", "match_score", "source", "is_uncertain"]
    return built.select(*columns, meta("parsed_track.pattern").alias("meta_pattern"), meta("parsed_track.normalized_input").alias("meta_normalized"), meta("query_variants[0].source").alias("meta_variant"))


def _build_sql() -> str:
    return _linked_sql(f"""
SELECT 'list-' || line_id % 7 || '-' || line_id AS item_id, 'list-' || line_id % 7 AS playlist_id,
       CAST(row_number() OVER (PARTITION BY line_id % 7 ORDER BY line_id) - 1 AS INTEGER) AS position, n.raw_input, n.artist AS parsed_artist, n.title AS parsed_title,
       n.confidence AS parser_confidence, m.track_id AS match_track_id, m.score AS match_score, m.source, i.is_uncertain, n.pattern AS meta_pattern, n.n7 AS meta_normalized, v0.source AS meta_variant
FROM ({Q.parsed(Q.normalized(_PART_SQL))}) n JOIN i USING (line_id) LEFT JOIN (SELECT * FROM m WHERE rank = 1) m USING (line_id)
LEFT JOIN (SELECT line_id, min_by(source, ord) AS source FROM v GROUP BY line_id) v0 USING (line_id)""")


def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second item has a video address; its file is named by its place among these."""
    address = F.when(F.col("position") % 2 == 0, F.concat(F.lit("https://youtu.be/"), F.col("item_id")))
    return export.download_names(order_items(spark, sf_dir).withColumn("match_external_url", address))


_DOWNLOAD_NAMES = f"""
SELECT playlist_id, CAST(position // 2 + 1 AS INTEGER) AS ordinal, item_id, printf('%02d', position // 2 + 1) || ' - ' || coalesce(parsed_artist || ' - ', '') || parsed_title AS filename
FROM {_ITEMS_SQL} WHERE position % 2 = 0"""


def lists_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), "playlist_id")
    sizes = order_items(spark, sf_dir).groupBy("playlist_id").agg(F.count("*").alias("n_items"))
    rows = order_lists(spark, sf_dir).join(sizes, "playlist_id", "left")
    return rows.select("session_id", F.row_number().over(order).alias("place"), "playlist_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


_BY_SESSION = """
SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place,
       o_orderkey AS playlist_id, coalesce(n, 0) AS n_items
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def _export(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return export.export_lists(order_lists(spark, sf_dir), order_items(spark, sf_dir), fmt)

    return run


def _export_sql(fmt: str) -> str:
    number = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE CAST({c} AS VARCHAR) END"
    if fmt == "csv":
        head = "'" + ",".join(export.CSV_COLUMNS) + "'"
        row = f"""position || ',"' || replace(raw_input, '"', '""') || '",' || coalesce(parsed_artist, '') || ',' || parsed_title || ',' || {number("parser_confidence")} || ',' || match_track_id
          || ',' || coalesce(match_external_url, '') || ',' || {number("match_score")} || ',' || match_algorithm || ',' || source || ',' || CASE WHEN is_uncertain THEN 'True' ELSE 'False' END"""
    else:
        head = "'#EXTM3U'"
        title = "CASE WHEN parsed_artist IS NOT NULL THEN parsed_artist || ' - ' || parsed_title ELSE parsed_title END"
        row = f"'#EXTINF:-1,' || {title} || chr(10) || coalesce(match_external_url, match_track_id)"
    return f"""
SELECT o_orderkey AS playlist_id, 'playlist-' || o_orderkey || '.{fmt}' AS filename, '{fmt}' AS format, '{export.MEDIA_TYPES[fmt]}' AS media_type,
       {head} || chr(10) || coalesce(body || chr(10), '') AS content, coalesce(n, 0) AS total_items
FROM orders LEFT JOIN (SELECT playlist_id, count(*) AS n, string_agg({row}, chr(10) ORDER BY position) AS body FROM {_ITEMS_SQL} GROUP BY playlist_id) ON playlist_id = o_orderkey"""


# Changes


def session_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.sessions_from_events(_t(spark, sf_dir, "events"))


def rename_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of finished orders take the order's status as their name; earlier and repeated changes do not count."""
    done = _t(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    names = done.select(F.col("o_orderkey").alias("playlist_id"), F.when(F.col("o_orderstatus") == "F", F.lit("finished")).alias("name"), F.lit(2).alias("changed_at"))
    earlier = done.select(F.col("o_orderkey").alias("playlist_id"), F.lit("zz earlier").alias("name"), F.lit(1).alias("changed_at"))
    return lists.rename_lists(order_lists(spark, sf_dir), earlier.union(names).union(names)).select("playlist_id", "session_id", "name")


def delete_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of open orders go with their items; what items are left per list."""
    gone = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("playlist_id"))
    kept, items = lists.delete_lists(order_lists(spark, sf_dir), order_items(spark, sf_dir), gone)
    n = items.groupBy("playlist_id").agg(F.count("*").alias("n_items"))
    return kept.join(n, "playlist_id", "left").select("playlist_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def delete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list loses its uncertain items; the other positions stay as they are."""
    items = order_items(spark, sf_dir)
    return lists.delete_items(items, items.filter("is_uncertain")).select("item_id", "playlist_id", "position")


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain items are reviewed by hand, some without a track id or score; earlier and repeated reviews do not count."""
    items = order_items(spark, sf_dir)
    reviews = items.filter("is_uncertain").select(
        "item_id", "playlist_id", F.when(F.col("position") % 2 == 0, F.concat(F.lit("m"), F.col("item_id"))).otherwise("").alias("match_track_id"),
        F.lit(None).cast("string").alias("match_external_url"), F.when(F.col("position") % 3 == 0, 0.5).alias("match_score"),
        F.lit(None).cast("string").alias("match_algorithm"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("is_uncertain"), F.lit(2).alias("changed_at"),
    )
    earlier = reviews.withColumns({"changed_at": F.lit(1), "match_track_id": F.lit("zz earlier"), "match_score": F.lit(0.99)})
    done = lists.apply_reviews(items, earlier.unionByName(reviews).unionByName(reviews))
    score = F.get_json_object("metadata_json", "$.manual_review.match_score").cast("double")
    return done.select("item_id", "match_track_id", "match_external_url", "match_score", "match_algorithm", "source", "is_uncertain", F.get_json_object("metadata_json", "$.parsed_track.title").alias("meta_title"), score.alias("meta_score"), F.get_json_object("metadata_json", "$").rlike('"match_external_url":null').alias("meta_keeps_nulls"))


_REVIEWED = f"""
SELECT item_id, CASE WHEN u AND position % 2 = 0 THEN 'm' || item_id ELSE match_track_id END AS match_track_id, CASE WHEN NOT u THEN match_external_url END AS match_external_url,
       CASE WHEN NOT u THEN match_score WHEN position % 3 = 0 THEN 0.5 ELSE 0.99 END AS match_score, CASE WHEN u THEN 'manual' ELSE match_algorithm END AS match_algorithm,
       CASE WHEN u THEN 'manual' ELSE source END AS source, false AS is_uncertain, 'x' AS meta_title, CAST(CASE WHEN u THEN CASE WHEN position % 3 = 0 THEN 0.5 ELSE 0.99 END END AS DOUBLE) AS meta_score, u AS meta_keeps_nulls
FROM (SELECT *, is_uncertain AS u FROM {_ITEMS_SQL})"""


# Connectors


def source_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as track search responses, one per brand and supplier of names."""
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("artists"))
    payloads = _t(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("tracks"))).alias("payload"))
    return rest.tracks_from_json(payloads).select("p_partkey", "track_id", "artist", "title")


def source_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as video search responses; the odd ones are channels and drop out."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "youtube#video").otherwise("youtube#channel")
    item = F.struct(F.struct(kind.alias("kind"), F.col("p_partkey").cast("string").alias("videoId")).alias("id"), F.struct(F.concat(F.col("p_brand"), F.lit(" &amp; "), F.col("p_name")).alias("title")).alias("snippet"))
    payloads = _t(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return rest.videos_from_json(payloads).select("p_partkey", "track_id", "artist", "title", "external_url")


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as saved answers of the track service, read back by the search source, every other brand by pushed filters."""
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("artists"))
    brand = _t(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("query")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    saved = brand.select("query", F.to_json(F.struct(F.struct("items").alias("tracks"))).alias("payload"))
    path = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    saved.write.parquet(path)
    search_source.register(spark)
    wanted = [f"brand#{a}{b}" for a in range(1, 6) for b in (1, 3, 5)]
    answers = spark.read.format(search_source.NAME).option("answers", path).load().filter(F.col("query").isin(wanted) & F.col("error_code").isNull())
    return rest.tracks_from_json(answers.drop("error_code")).select("query", "track_id", "artist", "title")


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty lists of parts as files, written by the sink and read back."""
    part = _t(spark, sf_dir, "part")
    key = (F.col("p_partkey") % 50).alias("playlist_id")
    names = {"match_track_id": F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "parsed_artist": F.col("p_brand"), "parsed_title": F.col("p_name"), "raw_input": F.col("p_type")}
    none = {c: F.lit(None).cast("string") for c in ("match_external_url", "match_algorithm", "source")}
    items = part.select(key, F.col("p_partkey").alias("position"), *(v.alias(k) for k, v in (names | none).items()), F.lit(1.0).alias("parser_confidence"), F.lit(None).cast("double").alias("match_score"), F.lit(True).alias("is_uncertain"))
    made = part.select(key).distinct().select("playlist_id", F.lit("s").alias("session_id"), F.lit("n").alias("name"), F.lit(None).cast("timestamp").alias("created_at"))
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    list_files_sink.register(spark)
    export.export_lists(made, items, "m3u").write.format(list_files_sink.NAME).mode("append").save(path)
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("content"))
    return files


_LIST_FILES = """
SELECT 'playlist-' || p_partkey % 50 || '.m3u' AS filename,
       '#EXTM3U' || chr(10) || string_agg('#EXTINF:-1,' || p_brand || ' - ' || p_name || chr(10) || 'p' || p_partkey, chr(10) ORDER BY p_partkey) || chr(10) AS content
FROM part GROUP BY p_partkey % 50"""


def download_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "pages").select("page_id", export.downloadable(F.col("url")).alias("downloadable"), export.safe_filename(F.col("url")).alias("filename"))
    return names


def queries() -> dict[str, Query]:
    return {
        "normalize_lines": normalize_lines,
        "normalize_steps": lambda s, d: _normalized_steps(part_lines(s, d)),
        "normalize_sample": lambda s, d: _normalized_steps(_sample(s)),
        "detect_language": detect_language,
        "sample_language": sample_language,
        "transliterate": transliterate,
        "parse_lines": lambda s, d: _parse(part_lines(s, d)),
        "parse_sample": lambda s, d: _parse(_sample(s)),
        "parse_title_artist_order": lambda s, d: _parse(part_lines(s, d), "title_artist"),
        "parse_pattern_counts": parse_pattern_counts,
        "match_normalize": match_normalized,
        "levenshtein_topk": _topk("levenshtein"),
        "jaro_winkler_topk": _topk("jaro_winkler"),
        "hybrid_topk": _topk("hybrid"),
        "jaro_winkler_filter": jaro_winkler_filter,
        "nearest_names": nearest_names,
        "search_sources": search_sources,
        "search_reports": search_reports,
        "query_variants": query_variants,
        "parse_and_match": parse_and_match,
        "uncertain_summary": uncertain_summary,
        "eval_parser": eval_parser,
        "compare_matchers": compare_matchers,
        "list_totals": list_totals,
        "list_source_counts": _counts("source"),
        "list_algorithm_counts": _counts("match_algorithm"),
        "uncertain_positions": uncertain_positions,
        "list_stats": list_stats,
        "list_summaries": list_summaries,
        "bucketed_totals": bucketed_totals,
        "new_lists": new_lists,
        "item_lookup": item_lookup,
        "build_list": build_list,
        "download_names": download_names,
        "matcher_cases": matcher_cases,
        "eval_summary": eval_summary,
        "detect_lines": lambda s, d: parsing.detect(part_lines(s, d)).select("line_id", "normalized_input", "artist", "title", "pattern", "confidence"),
        "lists_by_session": lists_by_session,
        "export_csv": _export("csv"),
        "export_m3u": _export("m3u"),
        "export_json": _export("json"),
        "session_touch": session_touch,
        "rename_lists": rename_lists,
        "delete_lists": delete_lists,
        "delete_items": delete_items,
        "review_items": review_items,
        "source_tracks": source_tracks,
        "source_videos": source_videos,
        "saved_searches": saved_searches,
        "list_files": list_files,
        "download_filter": download_filter,
    }


def oracle_sql() -> dict[str, str]:
    language_columns = "language, language_confidence, cyrillic_ratio, latin_ratio"
    ranked = lambda scorer: _ranked_sql(scorer, "line_id", 3) + " SELECT line_id, rank, source, track_id, score, distance FROM r"
    both = f"(SELECT * FROM {_sample_sql()} UNION ALL SELECT * FROM {_PART_SQL})"
    return {
        "normalize_lines": _NORMALIZE_LINES,
        "normalize_steps": _steps_sql(_PART_SQL),
        "normalize_sample": _steps_sql(_sample_sql()),
        "detect_language": f"SELECT doc_id, {language_columns} FROM ({Q.language('SELECT * FROM documents', 'text')})",
        "sample_language": f"SELECT line_id, {language_columns} FROM ({Q.language(Q.normalized(_sample_sql()), 'n7')})",
        "transliterate": f"SELECT line_id, {Q.to_latin('s')} AS latin, {Q.to_cyrillic('s')} AS cyrillic FROM (SELECT p_partkey AS line_id, p_name AS s FROM part UNION ALL SELECT * FROM {_sample_sql()})",
        "parse_lines": _parse_sql(_PART_SQL),
        "parse_sample": _parse_sql(_sample_sql()),
        "parse_title_artist_order": _parse_sql(_PART_SQL, "title_artist"),
        "parse_pattern_counts": _PATTERN_COUNTS,
        "match_normalize": _MATCH_NORMALIZED,
        "levenshtein_topk": ranked("levenshtein"),
        "jaro_winkler_topk": ranked("jaro_winkler"),
        "hybrid_topk": ranked("hybrid"),
        "jaro_winkler_filter": _jaro_filter_sql(),
        "nearest_names": _NEAREST,
        "search_sources": _ranked_sql("hybrid", "line_id, source", 2) + " SELECT line_id, source, rank, track_id, score, distance FROM r",
        "search_reports": _REPORTS,
        "query_variants": _variants_sql(both),
        "parse_and_match": _linked_sql(
            "SELECT i.line_id, best_score, is_uncertain, m.rank, m.source, m.track_id, m.score, m.distance, vs AS query_variant_source, confidence AS query_variant_confidence FROM i LEFT JOIN m USING (line_id)"
        ),
        "uncertain_summary": _linked_sql("SELECT count(*) AS total, count(*) FILTER (WHERE is_uncertain) AS uncertain_count FROM i"),
        "eval_parser": _eval_parser_sql(),
        "compare_matchers": _compare_sql(),
        "list_totals": _TOTALS,
        "list_source_counts": f"SELECT playlist_id, source, count(*) AS n FROM {_ITEMS_SQL} GROUP BY ALL",
        "list_algorithm_counts": f"SELECT playlist_id, match_algorithm, count(*) AS n FROM {_ITEMS_SQL} GROUP BY ALL",
        "uncertain_positions": _POSITIONS,
        "lists_by_session": _BY_SESSION,
        "list_stats": _stats_sql(),
        "list_summaries": _SUMMARIES,
        "bucketed_totals": _SUMMARIES + " WHERE o_orderstatus <> 'O'",
        "new_lists": _NEW_LISTS,
        "item_lookup": _LOOKUP,
        "build_list": _build_sql(),
        "download_names": _DOWNLOAD_NAMES,
        "matcher_cases": _cases_sql(),
        "eval_summary": _eval_summary_sql(),
        "detect_lines": _detect_sql(),
        "export_csv": _export_sql("csv"),
        "export_m3u": _export_sql("m3u"),
        "session_touch": "SELECT CAST(user_id AS VARCHAR) AS session_id, min(ts) AS created_at, max(ts) AS last_seen_at, count(*) AS n_touches FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
        "rename_lists": "SELECT o_orderkey AS playlist_id, CAST(o_custkey AS VARCHAR) AS session_id, CASE o_orderstatus WHEN 'O' THEN o_orderpriority WHEN 'F' THEN 'finished' END AS name FROM orders",
        "delete_lists": "SELECT o_orderkey AS playlist_id, coalesce(n, 0) AS n_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'",
        "delete_items": f"SELECT item_id, playlist_id, position FROM {_ITEMS_SQL} WHERE NOT is_uncertain",
        "review_items": _REVIEWED,
        "source_tracks": "SELECT p_partkey, 'spotify:' || p_partkey AS track_id, p_brand || ', ' || p_type AS artist, p_name AS title FROM part",
        "source_videos": "SELECT p_partkey, 'youtube:' || p_partkey AS track_id, CAST(NULL AS VARCHAR) AS artist, p_brand || ' & ' || p_name AS title, 'https://www.youtube.com/watch?v=' || p_partkey AS external_url FROM part WHERE p_partkey % 2 = 0",
        "saved_searches": "SELECT lower(p_brand) AS query, 'spotify:' || p_partkey AS track_id, p_brand AS artist, p_name AS title FROM part WHERE regexp_matches(p_brand, '^Brand#[1-5][135]$')",
        "list_files": _LIST_FILES,
        "download_filter": r"SELECT page_id, coalesce(contains(url, 'youtube.com') OR contains(url, 'youtu.be'), false) AS downloadable, trim(regexp_replace(url, '[^\p{L}\p{N} \-_()]', '', 'g')) AS filename FROM pages",
    }
