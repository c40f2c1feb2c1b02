import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablescout.functions import similarity as sm
from tablescout.functions import text as tx


def ratio(a, b):
    return sm.ratio(set(a.split()), set(b.split()))


@pytest.mark.parametrize("a,b,score", [
    ("iso code", "country code", 66.67), ("country", "country code", 100),
    ("germany", "germny", 92.31), ("year", "date", 25), ("", "a", 0), ("cust id", "c name", 30.77)])
def test_known_scores(a, b, score):
    assert ratio(a, b) == pytest.approx(score, abs=0.01)
    assert ratio(b, a) == pytest.approx(score, abs=0.01)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def test_common_length_equals_table():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd é") for _ in range(rnd.randint(0, 90))) for _ in "xx")
        assert sm.common_length(a, b) == longest(a, b)


def test_expression_equals_worker_function(spark):
    rnd = random.Random(2)
    words = ["gdp", "usd", "total", "country", "code", "iso", "rate", "pct", "année"]
    names = [" ".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(25)]
    pairs = list(itertools.product(names, names))
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", tx.token_set_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(ratio(r["a"], r["b"]), abs=1e-6)
        assert 0 <= r["s"] <= 100


def test_values_and_numbers(spark):
    rows = [(" A  b\t c ", "2020.0"), (None, "2020"), ("x", "2.50"), ("y", "n2")]
    got = spark.createDataFrame(rows, "v string, n string").select(
        tx.norm_value(F.col("v")).alias("v"), tx.number_text(F.col("n")).alias("n")).collect()
    assert [r["v"] for r in got] == ["a b c", "", "x", "y"]
    assert [r["n"] for r in got] == ["2020", "2020", "2.5", "n2"]


def test_years_and_tokens(spark):
    row = spark.createDataFrame([("In 1999, 2150, 2100-2101 and x2000; GDP per-capita é",)], "t string").select(
        tx.extract_years(F.col("t")).alias("y"), tx.slug_tokens(F.col("t")).alias("s")).first()
    assert row["y"] == [1999, 2100]
    assert row["s"] == ["1999", "2150", "2100", "2101", "and", "x2000", "gdp", "per", "capita"]


def test_codes_are_no_numbers(spark):
    rows = [(x,) for x in ("10D", "1e1", "5f", "007", "10", "10.0", "-0.50", "1.0E10")]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(tx.number_text(F.col("v"))).collect()]
    assert got == ["10D", "1e1", "5f", "007", "10", "10", "-0.5", "10000000000"]


def test_ratio_is_one_step_in_a_worker(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [("gdp usd", None), ("", None), (None, None), ("gdp\x1cusd", "usd gdp"), (long, long + " x"), (long, long.replace("7", "8"))]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("s", tx.token_set_ratio(F.col("a"), F.col("b")))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()  # no table of letters in an expression
    s = [r["s"] for r in got.collect()]
    assert s[:5] == [None, 0.0, None, 100.0, 100.0]
    assert s[5] == pytest.approx(ratio(long, long.replace("7", "8")), abs=1e-6)
