"""What the driver must not carry: sides that are small as files and large as rows."""

import re

from pyspark.sql import functions as F

from tablescout.operators import discovery as di
from tablescout.operators.skew import salted_join
from tablescout.session import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_sends_nothing_through_the_driver(spark):
    rows = [(f"w{i % 7}", i) for i in range(200)] + [(None, 1)]
    big = cut(spark.createDataFrame(rows, "token string, n int"), "big")
    small = cut(spark.createDataFrame([(f"w{i}",) for i in range(5)] + [(None,)], "token string"), "small")
    often = small.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    for how, side in (("inner", often), ("left", often), ("left_semi", small)):
        got = salted_join(big, side, ["token"], F.col("n"), how)
        assert not re.search("Broadcast", plan(got)), how
        kept = sum(1 for t, _ in rows if t is not None and int(t[1:]) < 5)
        assert got.count() == (len(rows) if how == "left" else kept)


def test_search_and_scores_send_nothing_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(di, "cut", lambda df, label: (plans.append(plan(df)), cut(df, label))[1])
    catalog = cut(spark.range(100).selectExpr(
        "id AS entry_id", "0 AS catalog_pos", "id AS entry_pos", "concat('tok', id % 9, ' year') AS text", "concat('tok', id % 9) AS title",
        "'d' AS description", "array('k') AS keywords", "array('year') AS field_names", "'s' AS source_name", "'d' AS dataset_id",
        "'l' AS landing_page", "array('u') AS download_urls"), "catalog")
    asked = cut(spark.range(10).selectExpr("id AS seed_id", "id AS query_id", "concat('tok', id, ' year') AS query"), "asked")
    fields = cut(spark.range(10).selectExpr(
        "id AS seed_id", "array('year') AS join_fields", "array('tok1') AS salient_columns", "2020 AS year_min", "2022 AS year_max"), "fields")
    found = di.catalog_search(asked, catalog).drop("score")
    scored = di.finalize(found, catalog.drop("text", "catalog_pos", "entry_pos"), fields)
    assert not re.search("Broadcast", "".join([*plans, plan(scored)]))
    assert scored.count() == found.count() > 10 and {tuple(r.matched_join_fields) for r in scored.collect()} == {("year",)}


def test_tokens_and_years_are_looked_for_once_per_text(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(di, "cut", lambda df, label: (plans.append(plan(df)), cut(df, label))[1])
    catalog = cut(spark.range(20).selectExpr(
        "id AS entry_id", "0 AS catalog_pos", "id AS entry_pos", "if(id = 19, '-', concat('tok', id % 5, ' year')) AS text", "concat('tok', id % 5, ' 2021 1999') AS title",
        "'d' AS description", "array('k') AS keywords", "array('f') AS field_names", "'s' AS source_name", "'d' AS dataset_id",
        "'l' AS landing_page", "array('u') AS download_urls"), "catalog")
    asked = cut(spark.range(6).selectExpr("id AS seed_id", "id AS query_id", "if(id = 5, '', concat('tok', id % 2)) AS query"), "asked")
    fields = cut(spark.range(6).selectExpr("id AS seed_id", "array('f') AS join_fields", "array('tok1') AS salient_columns", "2020 AS year_min", "2022 AS year_max"), "fields")
    found = di.catalog_search(asked, catalog).drop("score")
    assert not any(re.search(r"Filter [^\n]*regexp_replace", p) for p in plans), plans  # asked of equal queries one by one
    scored = di.finalize(found, catalog.drop("text", "catalog_pos", "entry_pos"), fields)
    above = plan(scored)
    assert "LeftSemi" in above and re.search(r"regexp_extract_all", above)
    years = [line for line in above.split("\n") if "regexp_extract_all" in line]
    assert all("join_fields" not in line for line in years), years  # beside the entry, not beside a seed's fields
    rows = scored.collect()
    assert {r.seed_id for r in rows} == {0, 1, 2, 3, 4} and {tuple(r.years_found) for r in rows} == {(1999, 2021)} and all(r.has_year_overlap for r in rows)
