import pytest

from tablescout.operators import evaluate as ev
from tablescout.operators import integrate as it
from tablescout.operators import matching as ma
from tablescout.operators import ranking as rk


@pytest.fixture(scope="module")
def seed(spark):
    return spark.createDataFrame(
        [(1, "Brazil", 2020), (2, "Germany", 2020), (3, None, 2021), (4, "Brazil", 2021), (5, "France", None)],
        "id int, country string, year int")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_fuzzy_join_provenance_and_null_keys(spark, seed):
    cand = spark.createDataFrame([("Brasil", 1.0), ("germany ", 2.0), (None, 3.0), ("Peru", 4.0)], "Country string, gdp double")
    plan = it.JoinPlan("d", [("Country", "country")], ["gdp"], "http://x")
    out = it.join_candidate(seed, cand, plan)
    assert rows(out, "id", "gdp", "gdp__source") == [
        (1, 1.0, "http://x"), (2, 2.0, "http://x"), (3, 3.0, "http://x"), (4, 1.0, "http://x"), (5, None, None)]
    plan.null_keys = "skip"
    assert rows(it.join_candidate(seed, cand, plan), "id", "gdp")[2] == (3, None)


def test_fan_out_keeps_every_match(spark, seed):
    cand = spark.createDataFrame([("2020", "a"), ("2020.0", "b"), ("n/a", "c"), ("2021", "d")], "year string, v string")
    out = it.join_candidate(seed, cand, it.JoinPlan("d", [("year", "year")], ["v"], "p"))
    assert rows(out, "id", "v") == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "d"), (4, "d"), (5, "c")]


def test_augment_and_completeness(spark, seed):
    a = spark.createDataFrame([(2020, 1)], "year int, x int")
    b = spark.createDataFrame([(1, None), (2, 7)], "id int, y int")
    out = it.augment(seed, {"a": a, "b": b}, [
        it.JoinPlan("a", [("year", "year")], ["x"], "pa"), it.JoinPlan("b", [("id", "id")], ["y"], "pb")], cut_every=1)
    assert out.count() == 5
    assert it.coverage(seed.columns, out.columns) == {"added": ["x", "y"], "provenance": ["x__source", "y__source"]}
    shares = {r["column"]: r["completeness"] for r in it.completeness(out, ["x", "y", "country"]).collect()}
    assert shares == {"x": 0.4, "y": 0.2, "country": 0.8}


def test_no_candidate_is_told_to_be_broadcast(spark, seed):
    cand = spark.createDataFrame([(1, 2)], "id int, x int")
    plan = it.join_candidate(seed, cand, it.JoinPlan("d", [("id", "id")], ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_metrics_on_short_and_perfect_lists(spark):
    data = [("p", i, i <= 2, 1.0 - i / 10) for i in range(1, 6)] + [("n", 1, False, 0.1)]
    judged = spark.createDataFrame(data, "seed_id string, rank int, rel boolean, overall_score double")
    ap = {r["seed_id"]: r["average_precision"] for r in ev.average_precision(judged).collect()}
    assert ap == {"p": 1.0, "n": 0.0}
    prec = {(r["seed_id"], r["k"]): r["precision"] for r in ev.precision_at_k(judged).collect()}
    assert prec["p", 5] == 0.4 and prec["p", 20] == 0.4
    ndcg = {(r["seed_id"], r["k"]): r["ndcg"] for r in ev.ndcg_at_k(judged).collect()}
    assert ndcg["p", 10] == 1.0 and ndcg["n", 5] == 0.0
    assert ev.retrieval_metrics(judged).count() == 2


def test_ranking_filter_treats_missing_as_kept(spark):
    df = spark.createDataFrame([("s", 1, None, 0.9, 0.9), ("s", 2, 1, 0.9, 0.8), ("s", 3, 3, 0.9, 0.9), ("s", 4, 2, None, 0.9)],
                               "seed_id string, i int, priority int, relevance_score double, metadata_completeness_score double")
    assert [r["i"] for r in rk.keep(df).orderBy("i").collect()] == [1, 3, 4]


def test_first_owner_equals_applying_candidates_in_turn(spark):
    """Random names with ``__source`` endings, against the rule applied candidate by candidate."""
    import random

    r = random.Random(4)
    norm = lambda c: " ".join(c.lower().replace("_", " ").split())
    rows = []
    for seed in range(40):
        for rank in range(1, r.randint(2, 7)):
            rows += [(f"s{seed}", f"d{rank}", rank, c, i, norm(c)) for i, c in enumerate(
                r.choice(["a", "A", "b", "x y"]) + "".join(r.choice(["__source", " Source", ""]) for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 4)))]
    rows = [x for x in rows if x[5]]
    want = set()
    for seed in {x[0] for x in rows}:
        owned = set()
        for rank in sorted({x[2] for x in rows if x[0] == seed}):
            free = [x for x in rows if x[0] == seed and x[2] == rank and x[5] not in owned]
            want |= {x[:5] for x in free}
            owned |= {n for x in free for n in (x[5], norm(x[3] + "__source"))}
    df = spark.createDataFrame(rows, "seed_id string, dataset_id string, rank int, col string, cand_pos int, norm string")
    got = {(x["seed_id"], x["dataset_id"], x["rank"], x["col"], x["cand_pos"]) for x in ma.first_owner(df).collect()}
    assert got == want and len(want) < len(rows)


def test_composite_keys_equal_counting_every_pair(spark):
    import random
    from itertools import combinations

    from tablescout.operators import profile as pr

    r = random.Random(1)
    rows = [(i // 30, i % 30, i if i % 7 else None, r.randrange(5), f"{i * 7919 % 3000}", float(r.randrange(40))) for i in range(3000)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f double")
    want = []
    for i, (x, y) in enumerate(combinations(range(6), 2)):
        seen = [(t[x], t[y]) for t in rows if t[x] is not None and t[y] is not None]
        if len(seen) == len(set(seen)):
            want.append((i, names[x], names[y]))
    assert [tuple(t) for t in pr.composite_keys(df, names).collect()] == want[:5] and len(want) > 5


def test_sketches_are_near_the_exact_values(spark):
    from tablescout.operators import profile as pr

    df = spark.range(40_000).selectExpr("id", "id % 977 AS k", "cast(pmod(id * 7919, 40000) AS double) / 7 AS x", "concat('t', id % 12345) AS t")
    parts = pr.sketches(df.filter("id % 2 = 0")).unionByName(pr.sketches(df.filter("id % 2 = 1")))
    got = {r["col_pos"]: r for r in pr.estimates(pr.merged(parts)).collect()}
    for at, n in enumerate((40_000, 977, 40_000, 12_345)):
        assert abs(got[at]["unique_estimate"] - n) <= 0.04 * n
    for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(got[2][q] * 7 / 40_000 - p) <= 0.01
    assert got[3]["median"] is None and got[2]["outlier_share"] == 0


def test_keys_join_in_the_form_they_are_checked_in(spark):
    seed = spark.createDataFrame([("2020", True, 1), ("2021", False, 2)], "code string, flag boolean, id int")
    cand = spark.createDataFrame([("2020.0", True, "x"), ("2021", False, "y")], "k string, f boolean, v string")
    plan = it.JoinPlan("d", [("k", "code"), ("f", "flag")], ["v"], "http://p")
    assert [(r["id"], r["v"]) for r in it.join_candidate(seed, cand, plan).orderBy("id").collect()] == [(1, "x"), (2, "y")]


def test_lines_are_joined_once_for_all_steps(spark, monkeypatch, tmp_path):
    from tablescout.plans import integration_queries as iq
    spark.createDataFrame([(k, k % 3, "O", "1-URGENT") for k in range(40)],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n, 7 * k + n, "A") for k in range(40) for n in range(1, 5)],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    times = []
    made = iq._cand_cols
    monkeypatch.setattr(iq, "_cand_cols", lambda s, sf: times.append(1) or made(s, sf))
    assert iq._statuses(spark, str(tmp_path)).count() == 40
    assert len(times) == 1
