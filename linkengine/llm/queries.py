"""The dealt operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exponion, licenses, line_dedup, merkle, mixing, packing, simhash, token_counts, topk, toxicity, url_reputation, warc_zip, winnowing
from .common import read_table


def held_out() -> Column:
    """Whether a document's label is kept from training."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").filter(~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, training_labels(spark, sf_dir))
    scored = toxicity.score_documents(documents, model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_passages").alias("n_passages"),
    )


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.withColumn("bad_rate_lower", F.round("bad_rate_lower", 6))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, a folder of a hundred, the document."""
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = read_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(files)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(documents, TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc_zip.write_packages(read_table(spark, sf_dir, "pages"))
    records = warc_zip.read_packages(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = simhash.components(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return members.select(F.col("_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), ip AS (
  SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM ip
), lengths AS (
  SELECT DISTINCT m FROM win
), dp AS (
  SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lengths WHERE len(w) >= m
), hits AS (
  SELECT rid, p, m, item_id FROM (SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM dp) JOIN win USING (m, g)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hits) GROUP BY rid
), listed AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha1(F.col("text").cast("binary")).alias("kept_sha1"))


def domain() -> Column:
    """The mixture's domain of a document: a group of sources by their number."""
    number = F.regexp_extract("source", "^src([0-9]+)$", 1).cast("int")
    of = F.element_at(F.array(F.lit("books"), F.lit("code"), F.lit("web")), F.pmod(number, F.lit(3)) + 1)
    return F.when(F.col("source").rlike("^src[0-9]+$"), of).otherwise("other")


def mix_levels() -> dict[str, Column]:
    return {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = [{"books": 30, "code": 20, "web": 45, "other": 5}, {"en": 60, "de": 15, "fr": 15, "es": 10}, {}]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mixing.mix(documents, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = exponion.cluster(read_table(spark, sf_dir, "embeddings"))
    return exponion.with_inertia(members, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, by a checksum of its id, is claimed to have no line ends."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    claimed = [*fields[:-1], F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))]
    proven = merkle.manifest(read_table(spark, sf_dir, "documents"), fields, F.col("source"), F.col("doc_id"), claimed)
    proof = F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256")
    return proven.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

OP2_SQL = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest,
         regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>', ' ', 'g'),
           '(?s)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^ \t\r\n\f\x0B]+') AS words FROM pages
), p AS (
  SELECT page_id, CASE WHEN len(words) < 50 OR len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) < 0.8 * len(words) THEN 1 ELSE 0 END AS y,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, host = 'net' OR ends_with(host, '.net') AS net, host = 'example.net' OR ends_with(host, '.example.net') AS example_net,
         host = 'example.com' OR ends_with(host, '.example.com') AS example_com, host = 'org' OR ends_with(host, '.org') AS org FROM p
), d AS (
  SELECT page_id, host, path,
         CASE WHEN example_net AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN example_com AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule, y
  FROM r
), h AS (
  SELECT host, count(y) AS n, coalesce(sum(y), 0) AS k, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM d GROUP BY host
), l AS (
  SELECT *, string_split(name, '.') AS s, regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') AS ip,
         len(s) > 2 AND regexp_matches(s[-1], '^[a-z]{2}$') AND s[-2] IN (<GENERIC>) AS long FROM h
), hosts AS (
  SELECT host, n, k, CASE WHEN ip THEN name WHEN long THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix,
         CASE WHEN ip THEN name WHEN long THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[greatest(len(s) - 1, 1):], '.') END AS domain FROM l
), top AS (
  SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS above, sum(k) AS tk, sum(n) AS tn FROM hosts
), <SUFFIX>, <DOMAIN>, <HOST>, apart AS (
  SELECT d.*, top.tk - y AS k0, top.tn - 1 AS n0, u.pk - y AS k1, u.pn - 1 AS n1, u.ps AS s1, v.pk - y AS k2, v.pn - 1 AS n2, v.ps AS s2,
         w.pk - y AS k3, w.pn - 1 AS n3, w.ps AS s3
  FROM d JOIN p_host w USING (host) JOIN p_domain v USING (suffix, domain) JOIN p_suffix u USING (suffix), top
), m0 AS (
  SELECT *, (k0 + 1) / (n0 + 2) AS r0 FROM apart
), m1 AS (
  SELECT *, s1 * r0 + k1 AS a1, s1 * (1 - r0) + (n1 - k1) AS b1, a1 / (a1 + b1) AS r1 FROM m0
), m2 AS (
  SELECT *, s2 * r1 + k2 AS a2, s2 * (1 - r1) + (n2 - k2) AS b2, a2 / (a2 + b2) AS r2 FROM m1
), m3 AS (
  SELECT *, s3 * r2 + k3 AS a, s3 * (1 - r2) + (n3 - k3) AS b FROM m2
)
SELECT page_id, host, path, rule, CAST(y AS INTEGER) AS bad_page,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0), 6) AS bad_rate_lower
FROM m3
"""


def _shrunk(level: str, keys: str, above: str) -> str:
    """SQL of one level of the beta-binomial chain, as CTEs ending in ``p_<level>``."""
    return f"""
g_{level} AS (
  SELECT {keys}, sum(n) AS n, sum(k) AS k, first(above) AS above FROM hosts {above} GROUP BY {keys}
), s_{level} AS (
  SELECT coalesce(sum(CASE WHEN n > 1 THEN n * pow(k / n - above, 2) - above * (1 - above) END)
                  / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * above * (1 - above) END), 0), 0.0) AS excess, sum(CASE WHEN n > 1 THEN n END) AS used FROM g_{level}
), t_{level} AS (
  SELECT CASE WHEN used > 0 THEN least(greatest(1 / least(greatest(excess, 1e-6::DOUBLE), 0.999999::DOUBLE) - 1, 1.0), 1000.0) ELSE 1.0 END AS s FROM s_{level}
), p_{level} AS (
  SELECT {keys}, n AS pn, k AS pk, s AS ps, s * above + k AS a, s * (1 - above) + n - k AS b, a / (a + b) AS above FROM g_{level}, t_{level}
)"""


def _op2_sql() -> str:
    parts = {
        "GENERIC": ", ".join(f"'{x}'" for x in url_reputation.GENERIC),
        "SUFFIX": _shrunk("suffix", "suffix", "CROSS JOIN top"),
        "DOMAIN": _shrunk("domain", "suffix, domain", "JOIN p_suffix USING (suffix)"),
        "HOST": _shrunk("host", "suffix, domain, host", "JOIN p_domain USING (suffix, domain)"),
    }
    sql = OP2_SQL
    for name, text in parts.items():
        sql = sql.replace(f"<{name}>", text.strip())
    return sql


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _fill(level: str, keys: str, parent: str, weight: str, above: str) -> str:
    """SQL of one level of the water filling, as CTEs ending in ``a_<level>``."""
    join = f"JOIN {above} USING ({parent})" if parent else ""
    budget = "_b" if parent else "(SELECT CAST(CAST(floor(sum(tokens) * 0.6) AS BIGINT) AS DOUBLE) FROM leaves)"
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
n_{level} AS (
  SELECT {keys}, cap, w, {budget} AS b, CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END AS filled
  FROM (SELECT {keys}, sum(tokens * 2.0::DOUBLE) AS cap, {weight} AS w FROM leaves GROUP BY {keys}) {join}
), s_{level} AS (
  SELECT *, w > 0 AND filled * sum(w) OVER ({part} ORDER BY filled, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= b - coalesce(sum(cap) OVER ({part} ORDER BY filled, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sated
  FROM n_{level}
), t_{level} AS (
  SELECT *, sum(CASE WHEN sated THEN cap ELSE 0 END) OVER ({part}) AS spent, sum(CASE WHEN sated THEN 0 ELSE w END) OVER ({part}) AS open_w
  FROM s_{level}
), a_{level} AS (
  SELECT {keys}, CASE WHEN sated THEN cap WHEN open_w > 0 THEN least((b - spent) / open_w * w, cap) ELSE 0 END AS _b FROM t_{level}
)"""


def _mixing_sql() -> str:
    weight = lambda c, of: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}.0::DOUBLE" for k, v in of.items()) + " ELSE 1.0::DOUBLE END" if of else "1.0::DOUBLE"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CASE WHEN regexp_matches(source, '^src[0-9]+$')
              THEN ['books', 'code', 'web'][CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) % 3 + 1] ELSE 'other' END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL
), {_fill("domain", "domain", "", weight("domain", MIX_WEIGHTS[0]), "")},
{_fill("lang", "domain, lang", "domain", weight("lang", MIX_WEIGHTS[1]), "a_domain")},
{_fill("source", "domain, lang, source", "domain, lang", "1.0::DOUBLE", "a_lang")},
plan AS (
  SELECT domain, lang, source, tokens, CAST(floor(round(_b, 3)) AS BIGINT) AS budget FROM leaves JOIN a_source USING (domain, lang, source)
), epochs AS (
  SELECT *, CAST(CASE WHEN tokens > 0 THEN least(budget // tokens, 2) WHEN budget > 0 THEN 1 ELSE 0 END AS INTEGER) AS epochs FROM plan
), o AS (
  SELECT *, CASE WHEN epochs < 2 THEN budget - epochs * tokens ELSE 0 END AS rest,
         md5('17:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM d JOIN epochs USING (domain, lang, source)
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM o
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM c WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""


def _exponion_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds: every vector against every centroid. A vector's least distance and, among equals, number are one integer."""
    ctes = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, x) - 1 AS j, x FROM v QUALIFY j < {k}
)"""]
    nearest = lambda c: f"SELECT rid, min(CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * {k} + c.j) AS m FROM v, {c} c GROUP BY rid"
    for r in range(rounds):
        ctes.append(f"""
a{r} AS MATERIALIZED ({nearest(f"c{r}")}), s{r} AS (
  SELECT m % {k} AS j, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, 65) t(p) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT j, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS x FROM s{r} GROUP BY j) u USING (j)
)""")
    return ",".join(ctes) + f""",
f AS ({nearest(f"c{rounds}")}), d AS (SELECT rid, m % {k} AS j, m // {k} AS distance FROM f)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM d JOIN v USING (rid) JOIN c{rounds} c USING (j)"""


def _tree_sql(name: str, leaves: str, paths: str, levels: int) -> str:
    """CTEs of trees of three: ``<name>_l<k>`` the nodes (g, i, h, n) of each level, ``<name>_p<k>`` the paths (id, g, i, proof, folded) up to it."""
    ctes = [f"""{name}_l0 AS MATERIALIZED ({leaves}), {name}_p0 AS MATERIALIZED ({paths})"""]
    for k in range(levels):
        ctes.append(f"""
{name}_l{k + 1} AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT g, CASE WHEN n > 1 THEN i // 3 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY l.i)) ELSE any_value(h) END AS h
    FROM {name}_l{k} l GROUP BY g, CASE WHEN n > 1 THEN l.i // 3 ELSE l.i END)
), {name}_p{k + 1} AS MATERIALIZED (
  SELECT p.id, g, any_value(p.i) // 3 AS i, any_value(p.proof) || coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i <> p.i), '') AS proof,
         sha256(string_agg(CASE WHEN l.i = p.i THEN p.folded ELSE l.h END, '' ORDER BY l.i)) AS folded
  FROM {name}_p{k} p JOIN {name}_l{k} l USING (g) WHERE l.n > 1 AND l.i // 3 = p.i // 3 GROUP BY p.id, g
  UNION ALL SELECT p.* FROM {name}_p{k} p JOIN {name}_l{k} l USING (g) WHERE l.n = 1
)""")
    return ",".join(ctes)


def _merkle_sql(levels: int = 12) -> str:
    """Trees of up to 3^levels leaves and groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step}))"
    return f"""
WITH t AS (SELECT *, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({head} || {field("text")}) AS h, sha256({head} || {field("claimed")}) AS claimed FROM t
), o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), {_tree_sql("a", "SELECT g, i, h, n FROM o", "SELECT id, g, i, '' AS proof, claimed AS folded FROM o", levels)},
{_tree_sql("b", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM a_l{levels}",
           f"SELECT id, '' AS g, r.i, proof, folded FROM a_p{levels} JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM a_l{levels}) r USING (g)", levels)}
SELECT doc_id, o.h AS leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = r.h AS verified
FROM o JOIN a_l{levels} s USING (g) JOIN b_p{levels} p USING (id), b_l{levels} r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_url_reputation": op2_url_reputation,
        "op3_licenses": op3_licenses,
        "op4_token_counts": op4_token_counts,
        "op5_warc_zip": op5_warc_zip,
        "op6_winnowing": op6_winnowing,
        "op7_topk": op7_topk,
        "op8_simhash": op8_simhash,
        "op9_line_dedup": op9_line_dedup,
        "op10_mixing": op10_mixing,
        "op11_exponion": op11_exponion,
        "op12_packing": op12_packing,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_reputation": _op2_sql(),
        "op5_warc_zip": OP5_SQL,
        "op6_winnowing": OP6_SQL,
        "op7_topk": OP7_SQL,
        "op10_mixing": _mixing_sql(),
        "op11_exponion": _exponion_sql(),
        "op13_merkle": _merkle_sql(),
    }
