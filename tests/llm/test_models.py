import os

import pytest
from pyspark.sql import functions as F

from tablescout.llm.language_id import identify, recognised
from tablescout.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@needs
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = identify(docs.filter(held).withColumn("letters", F.lit(1)), docs.filter(~held))
    n, right, rejected = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.98 * n and rejected <= 0.01 * n
    noise = spark.createDataFrame([(1, "Ωζψ ξθ ϕϖ ЖЩЪ ЫЭЮ 漢字仮名交 じり文")], "doc_id long, text string")
    assert identify(noise, docs).first().rejected


def test_language_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in identify(odd, odd).collect()}
    assert {got[i].lang_pred for i in (3, 4, 5, 6)} == {"und"} and got[3].score == 0 and got[3].rejected
    assert got[None].lang_pred == "de" and got[1].lang_pred == "en" and 0 <= got[1].score <= 1
    assert identify(odd, none).filter("lang_pred <> 'und'").count() == 0
    assert identify(none, odd).count() == 0
    kept = recognised(odd, odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (1, 2)").count() == 3


@needs
def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = score_toxicity(rows.filter(held), rows.filter(~held).select("doc_id", "text", "toxic")).toPandas()
    called = got.score >= 0.7
    assert (got.toxic[called] == 1).mean() >= 0.8 and called[got.toxic == 1].mean() >= 0.6
    first = got[called].iloc[0]
    assert all(0 <= s["start"] < s["end"] <= len(first.text) for s in first.spans)


def test_toxicity_of_odd_rows(spark, odd, none):
    taught = spark.createDataFrame(
        [(i, "such a vile word here" if i % 2 else "a calm word here", i % 2) for i in range(40)] + [(99, None, 1), (98, "x", None)],
        "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(odd.withColumn("spans", F.lit(1)), taught).collect()}
    assert len(got) == 10 and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4]
    assert score_toxicity(odd, taught.filter("toxic = 0")).filter("score <> 0").count() == 0
    assert score_toxicity(odd, taught.limit(0)).count() == 11
    assert score_toxicity(none, taught).count() == 0
