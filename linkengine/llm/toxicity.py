"""Toxicity by maximum-scoring segments.

Token log-odds with a Dirichlet prior are learnt from labelled documents; a linear
scan (Ruzzo and Tompa) finds all maximal-scoring passages of a text; passage scores
become E-values under the extreme-value law of segment scores (Karlin and Altschul),
and a one-variable logistic map turns the significant evidence into a probability. A
passage is significant when its E-value is below ``max_e``.

Cases: a null or empty text has no passage and gets the calibrated base score.
Repeated rows are scored one by one. Null labels are ignored; where one document has
several labels the largest counts. Without labels of both classes no token carries
evidence, and every score is the smoothed share of toxic labels (0.0 without labels).
Columns other than ``doc_id`` and ``text`` are neither read nor needed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, numbered, remaining

#: Bound on labelled documents used to fit; a larger labelled set is hash-sampled.
MAX_LABELLED = 20_000
#: A passage is significant below this expected number of chance passages.
MAX_E = 1.0
_WORD = re.compile(r"[^\W_]+")
_HASH_SPACE = 1 << 20


@dataclass
class ToxicityModel:
    """Fitted parameters; the token scores are of words in the labelled sample, which bounds them."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = -0.05
    lam: float = 1.0
    log_k: float = 0.0
    intercept: float = -20.0
    slope: float = 1.0
    max_e: float = MAX_E

    def base(self, n_tokens: int) -> float:
        """The normalised score from which a passage in ``n_tokens`` tokens is significant."""
        return self.log_k + math.log(max(n_tokens, 1)) - math.log(self.max_e)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.intercept + self.slope * evidence, -60, 60)))


def maximal_segments(positions: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, as (first token, last token, score).

    ``positions`` and ``values`` name the tokens with their own score; every token
    between them scores ``drift`` (negative). Every candidate remembers the nearest one
    before it with a lesser sum at its start; what lies between is never looked at again,
    so the pass is linear in the number of positions.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # sum before the candidate
    high: list[float] = []  # sum up to its end
    lesser: list[int] = []  # nearest candidate before it of a lesser ``low``
    total, previous = 0.0, -1
    for at, value in zip(positions, values):
        total += (at - previous - 1) * drift
        previous = at
        before, total = total, total + value
        if value <= 0:
            continue
        start, j = at, len(low) - 1
        while j >= 0 and low[j] >= before:
            j = lesser[j]
        while j >= 0 and high[j] < total:
            start, before, k = first[j], low[j], lesser[j]
            del first[j:], last[j:], low[j:], high[j:], lesser[j:]
            j = k
        first.append(start)
        last.append(at)
        low.append(before)
        high.append(total)
        lesser.append(j)
    return [(a, b, d - c) for a, b, c, d in zip(first, last, low, high)]


def scan(text: str | None, model: ToxicityModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Token count and maximal segments of one whole text."""
    words = _WORD.findall(text.lower()) if text else []
    get = model.scores.get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    return len(words), maximal_segments([i for i, _ in hits], [s for _, s in hits], model.drift)


def evidence(n_tokens: int, segments: list[tuple[int, int, float]], model: ToxicityModel) -> float:
    """Summed normalised scores of the significant segments."""
    base = model.base(n_tokens)
    return min(60.0, sum(max(0.0, model.lam * s - base) for _, _, s in segments))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: set[tuple[str, int, int]] = set()
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = _WORD.findall(text.lower()) if text else []
            padded = ["", *words, ""]
            around = pd.util.hash_array(np.array([f"{a} {b}" for a, b in zip(padded, padded[2:])], dtype=object)) if words else []
            rows.update(zip(words, np.asarray(around).astype(np.int64).tolist(), [int(toxic)] * len(words)))
        yield pd.DataFrame(list(rows), columns=["token", "around", "toxic"])


def _segment_stats(model: ToxicityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                n, segments = scan(text, model)
                out.append((int(toxic), n, [float(s) for _, _, s in segments]))
            yield pd.DataFrame(out, columns=["toxic", "n", "segments"])

    return run


def _solve_lambda(scores: np.ndarray, probabilities: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    f = lambda x: float(np.sum(probabilities * np.exp(np.minimum(x * scores, 700)))) - 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Regularised logistic map of one variable (Newton)."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([np.sum(y - p) - 0.02 * a, np.sum((y - p) * x) - 0.02 * b])
        hess = np.array([[w.sum() + 0.02, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.02]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_z: float = 3.0, max_e: float = MAX_E) -> ToxicityModel:
    """Learn from the rows of ``labels`` (doc_id, toxic), a hash sample of at most about ``max_labelled``.

    A token occurrence counts once per class and distinct pair of neighbours, so copies of
    one document do not multiply its words. All tokens of the sample that reach ``min_z``
    get a score. Every fifth labelled document (by a hash of
    its id) is kept from the token counts and used to calibrate.
    """
    spark = documents.sparkSession
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    n_all, n_toxic = sum(counts.values()), counts.get(1, 0)
    base = (n_toxic + 0.5) / (n_all + 1) if n_all else 0.0
    constant = ToxicityModel(intercept=math.log(base / (1 - base)) if base else -60.0, slope=0.0, max_e=max_e)
    if n_toxic in (0, n_all):
        return constant
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPACE))
    sample = labels.filter(slot < int(_HASH_SPACE * min(1.0, max_labelled / n_all)) + 1)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)))
    # The sample is bounded by ``max_labelled``, its texts are not: they stay distributed.
    sample = materialize(sample, "labelled")
    rows = materialize(lookup_join(documents.select("doc_id", "text"), sample, ["doc_id"], "inner"), "labelled-texts")

    seen = rows.filter("fold <> 0").select("text", "toxic").mapInPandas(_contexts, "token string, around long, toxic int")
    seen = seen.groupBy("token", "around").agg(F.max("toxic").alias("y1"), F.max(1 - F.col("toxic")).alias("y0"))
    per_token = seen.groupBy("token").agg(F.sum("y1").cast("long").alias("y1"), F.sum(F.col("y1") + F.col("y0")).cast("long").alias("y"))
    per_token = materialize(per_token, "terms")
    total = per_token.agg(F.sum("y1"), F.sum("y"), F.count("*")).first()
    n1, n, vocabulary = total[0] or 0, total[1] or 0, total[2]
    n0 = n - n1
    if not n1 or not n0:
        return constant
    # Prior: the pooled distribution plus half a count for each token.
    strength = 100.0
    a = F.lit(strength) * F.col("y") / n + 0.5
    a_all = strength + 0.5 * vocabulary
    y1, y0 = F.col("y1") + a, F.col("y") - F.col("y1") + a
    odds = F.log(y1 / (n1 + a_all - y1)) - F.log(y0 / (n0 + a_all - y0))
    scored = per_token.select("token", "y", "y1", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    # As many as the bounded sample has significant words.
    terms = scored.filter(F.abs("z") >= min_z).collect()
    scores = {r["token"]: float(max(-3.0, min(12.0, r["odds"]))) for r in terms if r["odds"] > 0 or r["z"] <= -2 * min_z}
    if not any(s > 0 for s in scores.values()):
        return constant
    model = ToxicityModel(scores=scores, max_e=max_e)
    background = [((r["y"] - r["y1"] + 0.5) / (n0 + a_all), scores[r["token"]]) for r in terms if r["token"] in scores]
    p = np.array([x for x, _ in background])
    s = np.array([x for _, x in background])
    rest = max(1e-9, 1 - p.sum())
    while (p * s).sum() + rest * model.drift >= 0 and model.drift > -8:
        model.drift *= 2
    model.lam = _solve_lambda(np.append(s, model.drift), np.append(p, rest))

    held = rows.filter("fold = 0").select("text", "toxic").mapInPandas(_segment_stats(model), "toxic int, n long, segments array<double>")
    held = materialize(held, "held-out")
    floor = min(x for x in scores.values() if x > 0)
    by_chance = F.coalesce(F.sum(F.size(F.filter("segments", lambda x: x >= floor))), F.lit(0))
    above, n_tokens = held.filter("toxic = 0").agg(by_chance, F.coalesce(F.sum("n"), F.lit(0))).first()
    model.log_k = math.log((above + 0.5) / (n_tokens + 1)) + model.lam * floor
    # One number per held-out document of the bounded sample.
    level = F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) + model.base(1)
    total_score = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(s * model.lam - level, F.lit(0.0)))
    found = held.select("toxic", F.least(total_score, F.lit(60.0)).alias("x")).collect()
    if len({r["toxic"] for r in found}) < 2:
        model.intercept, model.slope = math.log(base / (1 - base)), 1.0
        return model
    model.intercept, model.slope = _fit_logistic(np.array([r["x"] for r in found]), np.array([float(r["toxic"]) for r in found]))
    return model


def score_documents(documents: DataFrame, model: ToxicityModel, text: str = "text", into: tuple[str, str] = ("toxicity", "toxic_passages")) -> DataFrame:
    """Add the score and the toxic passages (first token, last token, E-value) to every row, as ``into``."""
    from pyspark.sql import types as T

    spark = documents.sparkSession
    # As plain values: a broadcast is unpickled by reference, and executors need not have the package.
    shared = spark.sparkContext.broadcast(dict(vars(model)))
    names = remaining(documents, into)
    passages = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("e_value", T.DoubleType())]))
    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField(into[0], T.DoubleType()), T.StructField(into[1], passages)])

    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(**shared.value)
        for batch in batches:
            facts, spans = [], []
            for value in batch.column(at).to_pylist():
                n, segments = scan(value, m)
                base = m.base(n)
                facts.append(evidence(n, segments, m))
                spans.append([{"first": a, "last": b, "e_value": m.max_e * math.exp(min(700.0, base - m.lam * s))} for a, b, s in segments if m.lam * s > base])
            scores = pa.array(m.probability(np.array(facts, dtype=float)), pa.float64())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, pa.array(spans, kind)], [*names, *into])

    return documents.select(*numbered(names)).mapInArrow(run, schema)
