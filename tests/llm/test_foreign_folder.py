"""Operators with Python workers run where executors cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from linkengine.llm import exponion, merkle, packing, toxicity
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
try:
    spark.range(1).repartition(2).mapInPandas(lambda x: (__import__("linkengine") and b for b in x), "id long").collect()
    sys.exit("the workers can import the package, so this proves nothing")
except Exception as e:
    assert "No module named 'linkengine'" in str(e), e
docs = spark.createDataFrame([(i, f"good words {{i}}" if i % 2 else f"awful nasty words {{i}}", "s") for i in range(40)], "doc_id long, text string, source string")
model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic"))
assert toxicity.score_documents(docs, model).count() == len(toxicity.score_documents(docs, model).select("toxicity").collect()) == 40
assert len(packing.pack(docs).collect()) >= 40
vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
assert len(exponion.cluster(vectors, dims=2)[0].collect()) == 30
assert all(r["verified"] for r in merkle.manifest(docs, [F.col("text")], F.col("source"), F.col("doc_id")).collect())
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    (tmp_path / "elsewhere").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = SCRIPT.format(repo=repo, shared=f"file://{tmp_path}/shared")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
