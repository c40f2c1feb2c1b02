import random

from pyspark.sql import functions as F

from tablescout.operators import discovery as di


def test_search_equals_brute_force(spark):
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    weights = [30] * 5 + [1] * 55  # five tokens occur almost everywhere

    def text(n):
        return " ".join(rnd.choices(words, weights, k=n))
    entries = [(i, i % 3, i // 3, text(rnd.randint(1, 25))) for i in range(400)]
    queries = [(i, text(rnd.randint(1, 12))) for i in range(40)] + [(90, "zz"), (91, "word0"), (92, "word0")]
    catalog = spark.createDataFrame(entries, "entry_id bigint, catalog_pos int, entry_pos int, text string")
    asked = spark.createDataFrame(queries, "query_id int, query string")
    got = {}
    for r in di.catalog_search(asked, catalog, 5).collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["entry_id"], r["score"]))
    for qid, q in queries:
        toks = {t for t in q.split() if len(t) > 2}
        scored = [(-round(len(toks & set(t.split())) / len(toks) + 1e-12, 4), c, p, e)
                  for e, c, p, t in entries if toks & set(t.split())] if toks else []
        want = [(i + 1, e, -s) for i, (s, _, _, e) in enumerate(sorted(scored)[:5])]
        assert sorted(got.get(qid, [])) == want, (qid, q)


def test_no_cross_join_in_the_search(spark):
    catalog = spark.range(100).selectExpr("id AS entry_id", "0 AS catalog_pos", "id AS entry_pos", "concat('tok', id % 9) AS text")
    asked = spark.range(10).selectExpr("id AS query_id", "concat('tok', id) AS query")
    plan = di.catalog_search(asked, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_year_range_and_fields(spark):
    row = spark.range(1).select(
        di.matched_fields(di.field_tokens(F.array(F.lit("country_code"), F.lit("id"), F.lit("gdp"))),
                          F.lit("the country codes of 1990")).alias("m")).first()
    assert row["m"] == ["country_code", "id"]
