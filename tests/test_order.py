import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators import order


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # One group holds two thirds of the rows and one score most of those.
    return [("hot" if i % 3 else f"g{i % 7}", 0.5 if i % 2 else round(rnd.random(), 2), i) for i in range(3000)]


def test_positions(spark, rows):
    df = spark.createDataFrame(rows, "g string, s double, i int")
    got = {r["i"]: r["p"] for r in order.with_position(df, ["g"], [F.desc("s"), F.asc("i")], "p").collect()}
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in want] == list(range(1, len(want) + 1))


def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "g string, s double, i int")
    out = order.with_running_sums(df, ["g"], [F.asc("i")], {"n": (F.col("i") % 5).cast("bigint")})
    got = {r["i"]: r["n"] for r in out.collect()}
    total = {}
    for g, _, i in rows:
        total[g] = total.get(g, 0) + i % 5
        assert got[i] == total[g]


def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, s double, i int")
    freq = df.groupBy("g", "s").agg(F.count("*").alias("n"))
    got = {(r["g"], r["p"]): r["q"] for r in order.exact_quantiles(freq, "g", "s", "n", [0.25, 0.5, 0.75]).collect()}
    for g in {r[0] for r in rows}:
        vals = [r[1] for r in rows if r[0] == g]
        for p in (0.25, 0.5, 0.75):
            assert got[g, p] == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_same_result_under_other_partition_counts(spark, rows):
    df = spark.createDataFrame(rows, "g string, s double, i int")
    results = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(order.with_position(df, ["g"], [F.desc("s"), F.asc("i")], "p").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
