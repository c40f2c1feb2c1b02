"""Queries are made beside their signature: what is shuffled are signatures, and none goes through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from tablescout.operators import querygen as qg
from tablescout.session import cut
from tablescout.sources import sinks

SIG = "seed_id bigint, columns array<string>, concepts array<string>, identifiers array<string>, samples map<string,array<string>>"


@pytest.fixture(scope="module")
def sig(spark):
    rows = [(1, ["year", "region"], ["economic"], ["iso_code"], {"region": ["Asia", "asia "]}),
            (1, ["year"], ["economic", None], ["iso_code", "sku"], {"country_name": ["Chad"]}),  # a seed told twice
            (2, None, None, None, None), (None, ["year"], ["time_series", "no such"], [], {})]
    return cut(spark.createDataFrame(rows, SIG), "signatures")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_query_per_text_and_ids(sig):
    strategies = [qg.direct_platform, qg.concept_source, qg.joinability, qg.entity_sample, qg.synonym, qg.augmentation]
    raw = [r for f in strategies for r in f(sig).collect()]
    best = {}
    for r in sorted(raw, key=lambda r: (r["branch"], r["pos"])):
        best.setdefault((r["seed_id"], r["query"] and r["query"].strip().lower()), r)
    got = qg.generate(sig).collect()
    assert len(raw) > len(best) == len(got)
    assert {(r["seed_id"], r["query"] and r["query"].strip().lower()) for r in got} == set(best)
    for seed in {r["seed_id"] for r in got}:
        mine = sorted((r for r in got if r["seed_id"] == seed), key=lambda r: r["id"])
        assert [r["id"] for r in mine] == list(range(1, len(mine) + 1))
        keys = [(r["priority"], r["branch"], r["pos"]) for r in mine]
        assert keys == sorted(keys)


def test_only_signatures_are_shuffled(spark, sig):
    level = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "seed_id bigint, relaxation_level int")
    for df in (qg.generate(sig), qg.fallback(sig, cut(level, "levels")), qg.heads(qg.generate(sig))):
        text = plan(df)
        assert "Broadcast" not in text
        above = text[:text.index("Generate")]  # what is done with the queries
        assert "Exchange" not in above, text


def test_sides_of_feedback_are_not_broadcast(spark):
    tried = cut(spark.range(20).select(F.col("id").alias("seed_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("target_connector")), "tried")
    found = cut(tried.filter("seed_id > 3").selectExpr(
        "seed_id", "target_connector AS connector", "array('x') AS matched_join_fields", "0.5D AS relevance_score"), "found")
    rows = qg.feedback(tried, found)
    assert "Broadcast" not in plan(rows)
    assert rows.filter("size(failed_connectors) = 2").count() == 4


def test_query_documents_are_compressed(spark, sig, tmp_path):
    queries = qg.generate(sig)
    sinks.write_queries(queries, str(tmp_path / "q"))
    files = [p.name for p in (tmp_path / "q").glob("part-*")]
    assert files and all(re.search(r"\.json\.gz$", f) for f in files)
    assert spark.read.json(str(tmp_path / "q")).count() == queries.count()


def test_lists_are_taken_from_blocks_a_worker_remembers(sig):
    held = qg._Held(["query"])
    own = [[(0, qg._direct, 0, "economic", (2020, 2022)), (1, qg._concept_source, 0, "economic", (2020, 2022))]]
    for _ in range(50):
        held.add(own)
    lists = held.handed_on()
    assert len(lists) == 50 and len(set(map(str, lists.to_pylist()))) == 1
    assert len(held.items) == len(lists[0]) == 27  # written out once for 50 seeds
    assert "ArrowEvalPython" in plan(qg.generate(sig)) and "lambda" not in plan(qg.generate(sig))


def test_first_by_branch_is_kept_and_order_is_by_priority(spark):
    # The augmentation of branch 4 comes after the synonym of branch 5, and still is the one that is kept.
    rows = [(1, ["region"], ["no such"], ["A_b ", " a b"], {"region": ["x"], "country_name": [None, "Chad", None, "Mali"]}), (2, [], ["", None, None], [None], None)]
    got = qg.generate(cut(spark.createDataFrame(rows, SIG), "signatures")).orderBy("seed_id", "id").collect()
    one = [r for r in got if r.seed_id == 1]
    assert [r["query"] for r in one if r.strategy == "joinability_entity_sample"] == [
        "countries Chad cross-country dataset CKAN 2020 2022", "countries Chad cross-country dataset Schema.org dataset 2020 2022"]
    assert [(r.id, r.priority) for r in one] == sorted((r.id, r.priority) for r in one) and len(one) == 3 + 24 * 2 + 2 + 18
    two = [r for r in got if r.seed_id == 2]
    assert [r["query"] for r in two][:4] == ["CKAN  country year dataset", "Schema.org dataset  by country 2020 2022", "DCAT catalog  country panel data", None]
    assert [list(r.pos) for r in two][:4] == [[0, 0], [0, 1], [0, 2], [1, 0]] and len(two) == 4 + 24
    assert two[4]["query"] == "by country by year CKAN 2020 2022" and two[4].identifier is None


def test_heads_beside_signatures_are_those_of_rows(sig):
    queries = qg.generate(sig)
    for by in ("strategy", "concept", "target_connector", "priority"):
        beside, rows = qg.heads(queries, by, 2), qg.heads(queries.filter("true"), by, 2)
        assert beside.columns == rows.columns and beside.schema["id"].dataType == rows.schema["id"].dataType
        assert sorted(map(str, beside.collect())) == sorted(map(str, rows.collect()))


def test_query_documents_are_packed_at_the_fastest_level(sig, tmp_path):
    queries = qg.generate(sig)
    queries.write.json(str(tmp_path / "usual"), compression="gzip")
    sinks.write_queries(queries, str(tmp_path / "q"))
    size = {d: sum(p.stat().st_size for p in (tmp_path / d).glob("part-*")) for d in ("usual", "q")}
    assert size["q"] > size["usual"]


def test_summary_counts_lists_taken_from_blocks(spark, sig):
    level = cut(spark.createDataFrame([(1, 2), (2, 2), (None, 1)], "seed_id bigint, relaxation_level int"), "levels")
    queries = qg.generate(sig).unionByName(qg.fallback(sig, level))
    got = qg.summary(queries)
    text = plan(got)
    assert "ArrowEvalPython" in text and "lambda" not in text  # lists are not made value by value
    counts = {}
    for r in queries.collect():
        for d in ("strategy", "target_connector", "concept", "fallback_tier"):
            if r[d] is not None:
                counts[r.seed_id, d, str(r[d])] = counts.get((r.seed_id, d, str(r[d])), 0) + 1
    assert {(r.seed_id, r.dimension, r.key): r.n for r in got.collect()} == counts
    # Tier 2 asks extended sources with one text each, of which the first stays.
    assert counts[1, "strategy", "fallback_tier2_extended_sources"] == 8 and (None, "fallback_tier", "2") not in counts
