"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that its predecessor kept and is written as Parquet before the
next one reads it; what it wrote on the way is removed then. The last stage adds
``domain``, ``n_tokens`` and ``copies``, the epochs each document is taken for.

Cases, as the operators define them: a null text passes the first two stages as it is and
counts as empty from then on; empty texts are one group of near copies, so one stays. Rows
without an id stay unless they are a copy of a row with one. Repeated rows leave as
one. Ties go to the least id. Very long texts are read whole. Empty tables give
empty results. Other columns of ``documents`` pass all stages but the last, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from linkengine.llm import line_dedup, mixing, near_copies, queries, toxicity, winnowing
from linkengine.llm.common import mark, materialize, quoted, read_table, release, unused
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents scored at or above this are rejected.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, queries.training_labels(spark, sf_dir))
    score = unused("toxicity", docs)
    scored = toxicity.score_documents(docs, model, into=(score, unused("toxic_passages", docs)))
    return scored.filter(F.col(score) < TOXIC_FROM).select(*quoted(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = unused("n_dropped", docs)
    kept = line_dedup.drop_recurring_lines(docs, into=(unused("n_lines", docs), dropped))
    n_chars = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)
    return chosen.select("doc_id", "text", "lang", "source", "n_chars", "domain", "n_tokens", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: SQL cannot express the scores, fingerprints and templates of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read_table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=1)
    return docs
