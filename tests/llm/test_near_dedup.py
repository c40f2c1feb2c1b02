import collections
import random
import re

from tablescout.llm.components import components
from tablescout.llm.near_dedup import near_duplicates, one_per_group


def brute(rows, k, per_cent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def copies(seed, groups, size, changes):
    """Groups of near copies whose similarities lie on both sides of the bound."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"x{r.randrange(10_000)}" for _ in range(r.randint(20, 90))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, changes)):
                w[r.randrange(len(w))] = f"y{r.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = copies(1, 6, 40, 8) + [(10_000, "Same  Words"), (10_001, "same words"), (10_002, ""), (10_003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, per_cent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in near_duplicates(df, k, per_cent).collect()}
        assert got == brute(rows, k, per_cent)


def test_odd_rows(spark, odd, none):
    got = collections.Counter(tuple(r) for r in near_duplicates(odd, 3, 85).collect())
    assert sum(got.values()) == odd.count()
    by = {r[0]: r for r in got}
    assert by[2][2] == 1 and not by[2][3] and got[by[2]] == 2
    assert by[3][1:] == (0, 3, True) and by[4][1:] == (0, 4, True)
    assert by[None][2] is None and by[None][3] and by[8][1] == 1
    assert near_duplicates(none).count() == 0
    kept = one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "None"])


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (5, "u v w x y z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in one_per_group(df).collect()) == [1, 5]


def test_components_with_many_chunks(spark, monkeypatch):
    import tablescout.llm.components as c

    monkeypatch.setattr(c, "CHUNK", 20)
    chain = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {j: 100 for j in range(100, 140)}
