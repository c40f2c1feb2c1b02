import random

import pytest

from tablescout.functions.similarity import ratio
from tablescout.operators import entities as en
from tablescout.operators import matching as ma


def best(value, seeds, threshold):
    found = None
    for pos, s in seeds:
        score = 100.0 if s == value else round(ratio(set(value.split()), set(s.split())), 6)
        if score >= threshold and (found is None or score > found[1]):
            found = (s, score)
    exact = next((s for _, s in seeds if s == value), None)
    return (exact, 100.0) if exact else found


@pytest.mark.parametrize("threshold,tile", [(60, 2048), (85, 7), (40, 16)])
def test_resolution_equals_brute_force(spark, monkeypatch, threshold, tile):
    monkeypatch.setattr(en, "TILE_SEEDS", tile)
    monkeypatch.setattr(en, "TILE_CANDS", tile)
    rnd = random.Random(threshold)
    words = ["inc", "the", "republic", "of", "south", "korea", "brasil", "brazil", "germany", "germny", "ab", "x",
             "international", "x" * 70]

    def name():
        toks = rnd.choices(words, [9, 6] + [2] * 11 + [0.3], k=rnd.randint(1, 5))
        return " ".join(toks)
    seeds = list(enumerate(dict.fromkeys(name() for _ in range(120))))
    cands = list(dict.fromkeys([name() for _ in range(120)] + ["", "zzz", "korea south", "brasl"]))
    got = {r["norm"]: (r["seed_norm"], r["score"]) for r in en.resolve(
        spark.createDataFrame([("d", s, p) for p, s in seeds], "domain string, norm string, pos bigint"),
        spark.createDataFrame([("d", c) for c in cands], "domain string, norm string"), threshold).collect()}
    for c in cands:
        want = best(c, seeds, threshold) if c else None
        assert (got.get(c) is None) == (want is None), c
        if want:
            assert got[c][0] == want[0] and got[c][1] == pytest.approx(want[1], abs=1e-5), c


def test_claims_and_ties(spark):
    seed = spark.createDataFrame([("s", ["country_code", "currency_code", "year"])], "seed_id string, columns array<string>")
    cand = spark.createDataFrame([("s", "d", c, i) for i, c in enumerate(["ISO Code", "Country-Code", "Year", "year.", "other"])],
                                 "seed_id string, dataset_id string, col string, cand_pos int")
    got = {r["col"]: (r["seed_col"], round(r["score"], 2)) for r in ma.match_columns(seed, cand).collect()}
    # The first to claim a seed column keeps it, and a loser gets no second choice.
    assert got == {"ISO Code": ("country_code", 66.67), "Year": ("year", 100.0)}


def test_first_owner_and_source_names(spark):
    rows = [("s", "a", 1, "x", 0), ("s", "a", 1, "X", 1), ("s", "b", 2, "x", 0), ("s", "b", 2, "x source", 1),
            ("s", "b", 2, "y", 2), ("s", "c", 3, "Y", 0), ("s", "c", 3, "z", 1)]
    df = spark.createDataFrame(rows, "seed_id string, dataset_id string, rank int, col string, cand_pos int")
    df = df.withColumn("norm", ma.norm_col(df.col))
    got = {(r["dataset_id"], r["col"]) for r in ma.first_owner(df).collect()}
    assert got == {("a", "x"), ("a", "X"), ("b", "y"), ("c", "z")}


def test_overlap_of_numbers_written_differently(spark):
    pairs = spark.createDataFrame([("s", "d", "c", "k")], "seed_id string, dataset_id string, col string, seed_col string")
    seed = spark.createDataFrame([("s", "k", v) for v in ("2020", "2021", None)], "seed_id string, seed_col string, value string")
    cand = spark.createDataFrame([("d", "c", v) for v in ("2020.0", "2020", "1999", None)], "dataset_id string, col string, value string")
    assert ma.value_overlap(pairs, seed, cand).first()["overlap"] == pytest.approx(0.6667)
