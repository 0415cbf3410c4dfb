"""Every name that an operator uses inside, as an extra column of its input."""

import corpus_pipeline
import pytest
from linkengine.llm import line_dedup, mixing, near_copies, simhash, token_counts, toxicity, winnowing
from pyspark.sql import functions as F

NAMES = [
    "_id", "_th", "_row", "_uid", "_drops", "_runs", "_whole", "_kept", "_recur", "_n", "_cut", "tpl", "leaf", "mask", "n", "run", "first", "last",
    "fp", "u", "v", "keys", "key", "grams", "head", "component_id", "link", "seed", "w", "p", "gram", "at", "items", "spans", "n_hit", "context",
    "toxicity", "toxic_passages", "n_lines", "n_dropped", "a.b", "c`d", "tokens", "rest", "epochs", "bound", "incl", "budget", "h", "_c", "_f", "cap", "fold", "toxic", "around", "y", "segments", "x",
]
SHARED = "the very same words stand in this long enough line of two documents and more"


def docs(spark):
    rows = [(i, f"{SHARED}\nown words of {'abcdefgh'[i]} only {'abcdefgh'[i] * 3} here\nand a third {'abcdefgh'[i]}") for i in range(6)]
    rows += [(6, rows[5][1]), (7, None)]
    data = [(i, t, "en", "src1", len(t or ""), *(f"{n}{i}" for n in NAMES)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES))


def check(out, *replaced):
    rows, kept = out.collect(), [n for n in NAMES if n not in replaced]
    assert set(NAMES) <= set(out.columns)
    for r in rows:
        assert [r[n] for n in kept] == [f"{n}{r['doc_id']}" for n in kept]
    return {r["doc_id"]: r for r in rows}


def test_line_dedup(spark):
    got = check(line_dedup.drop_recurring_lines(docs(spark)), "n_lines", "n_dropped")
    assert len(got) == 8 and got[0]["text"].startswith(SHARED) and not got[1]["text"].startswith(SHARED) and got[7]["text"] is None


def test_simhash(spark):
    assert sorted(check(simhash.drop_near_duplicates(docs(spark)))) == [0, 1, 2, 3, 4, 5, 7]


def test_near_copies(spark):
    assert sorted(check(near_copies.drop_near_copies(docs(spark)))) == [0, 1, 2, 3, 4, 5, 7]


def test_winnowing(spark):
    bench = spark.createDataFrame([("i", "x", "own words of c only ccc here and a third c")], "item_id string, n string, text string")
    assert sorted(check(winnowing.drop_contaminated(docs(spark), bench))) == [0, 1, 3, 4, 5, 6, 7]


def test_mixing(spark):
    out = mixing.mix(docs(spark), {"lang": F.col("lang"), "source": F.col("source")}, [{}, {}], 5.0, 2, 1)
    got = check(out)
    assert len(got) == 8 and all(r["copies"] == 2 for i, r in got.items() if i != 7)


def test_toxicity(spark):
    model = toxicity.fit(docs(spark), docs(spark).selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert len(check(toxicity.score_documents(docs(spark), model), "toxicity", "toxic_passages")) == 8
    assert len(check(toxicity.score_documents(docs(spark), model, into=("score", "passages")))) == 8


def test_token_counts(spark):
    got = check(token_counts.with_token_counts(docs(spark), "word_bpe_49k.json"))
    assert got[7]["n_tokens"] == 0 < got[0]["n_tokens"] and got[0]["n_bytes"] == len(got[0]["text"])


def test_added_columns_replace_names_of_any_case(spark):
    df = docs(spark).withColumnsRenamed({"toxicity": "Toxicity", "n_lines": "N_LINES"})
    model = toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert "Toxicity" not in toxicity.score_documents(df, model).columns
    out = line_dedup.drop_recurring_lines(df)
    assert "N_LINES" not in out.columns and {r["n_lines"] for r in out.select("n_lines").collect()} == {0, 3}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "mixing"])
def test_stages_return_the_columns_of_documents(spark, tmp_path, name):
    df = docs(spark)
    df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "own words of c only ccc here and a third c")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    assert out.columns == df.columns
    check(out)


def test_mixing_stage_with_extra_columns(spark):
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs(spark), "")
    assert len(out.collect()) and "a.b" not in out.columns
