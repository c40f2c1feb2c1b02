"""Every registered query of the package, beside its SQL where there is one, and the pipeline."""

import os

import pytest

import corpus_pipeline
from compare import compare, connect
from tablescout.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_sql(spark, key):
    message, _ = compare(spark, key, queries.QUERIES[key], queries.ORACLES[key], SF, connect(SF))
    assert message == ""


def test_stages_keep_columns_and_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(out.doc_id) <= ids and len(set(out.doc_id)) > 0.7 * len(ids)
    assert out.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_keep_the_values_of_columns_with_any_name(spark):
    names = ["dk", "spans", "_at", "at", "score", "loss", "own", "rejected", "row", "start", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.select("doc_id", *names).collect()
        assert len(rows) > 50 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A run of its own whose Python workers cannot import the package."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import corpus_pipeline
from tablescout.llm import queries
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate())
docs = spark.read.parquet("{SF}/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    assert stage(spark, docs, "{SF}").count() > 0, name
for name in ("op5_toxicity", "op11_alignment", "op12_periodic_runs", "op13_token_files"):
    assert queries.QUERIES[name](spark, "{SF}").count() > 0, name
print("all done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all done" in done.stdout, done.stderr[-3000:]
