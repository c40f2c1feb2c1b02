import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablescout.llm import queries
from tablescout.llm.grammar import build
from tablescout.llm.periodic_runs import periodic_runs, runs_of


def brute(w, least=24, times=3):
    """Runs by comparing the sequence with itself at every distance."""
    out, seen, n = [], set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequence(r):
    a = r.choice([1, 2, 2, 3, 5, 50])
    w = [r.randrange(a) for _ in range(r.choice([0, 1, 5, 30, 100, 300]))]
    for _ in range(r.randint(0, 4)):
        p = [r.randrange(a) for _ in range(r.randint(1, r.choice([3, 12, 60])))]
        w += (p * r.randint(2, 9))[:r.randint(1, 400)] + [r.randrange(a) for _ in range(r.randint(0, 10))]
        if r.random() < 0.3:
            w = w * 2 + w[:r.randint(0, 5)]
    if r.random() < 0.1:
        x, y = [0], [0, 1]
        for _ in range(9):
            x, y = y, y + x
        w += y
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (1, 3), (3, 3), (10, 3), (24, 4), (60, 3), (24, 7)])
def test_runs_equal_comparing_at_every_distance(least, times):
    r = random.Random(least * times)
    found = 0
    for _ in range(60):
        docs = [sequence(r) for _ in range(r.randint(0, 6))]
        offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        begin, end, period = runs_of(np.array([x for d in docs for x in d], np.int64), offs, least, times)
        row = np.searchsorted(offs, begin, "right") - 1
        for i, d in enumerate(docs):
            got = [(int(a - offs[i]), int(b - a), int(q)) for a, b, q, k in zip(begin, end, period, row) if k == i]
            assert got == brute(d, least, times)
            found += len(got)
    assert found > 100


def test_every_place_between_words_is_one_rules_boundary_in_each_derivation():
    r = random.Random(5)
    docs = [sequence(r) for _ in range(20)]
    words = np.array([x for d in docs for x in d])
    offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    g = build(words, offs)
    inner = g.place + (g.middle - g.begin)[g.rule]
    assert sorted(inner.tolist()) == sorted(set(range(1, len(words))) - set(offs.tolist()))
    for rule, place in zip(g.rule.tolist(), g.place.tolist()):  # a rule is one stretch of words wherever it stands
        a, b = g.begin[rule], g.end[rule]
        assert (words[a:b] == words[place:place + b - a]).all()


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    from fractions import Fraction

    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_query(spark, odd, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in sequence(r)[:400])) for i in range(60)] + [(i, f" a\tb c {i}\r\n" * r.randint(0, 30)) for i in range(60, 90)]
    rows += [(x.doc_id, x.text) for x in odd.collect() if x.doc_id != 7]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(contract(*x)) for x in rows)


def test_odd_rows(spark, odd, none):
    assert periodic_runs(odd).count() == odd.count() and periodic_runs(none).count() == 0
    long = periodic_runs(odd.filter("doc_id = 7")).first()
    assert long.n_words == 60_000 and long.runs == []
    with pytest.raises(ValueError):
        periodic_runs(odd, times=2)
