import random

import numpy as np

from tablescout.llm import decontamination as dc
from tablescout.llm.substring_dedup import deduplicated, passages


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_planted_passages(spark):
    r = random.Random(4)
    texts = {i: words(r, r.randint(60, 300)) for i in range(80)}
    clean = set(range(60, 80))
    planted = []
    for n in range(12):
        passage, members = words(r, r.randint(51, 90)), [5 * n, 5 * n + 1, 5 * n + 2][: r.choice((2, 3))]
        for m in members:
            w = texts[m].split(" ")
            at = r.randrange(len(w))
            texts[m] = " ".join(w[:at] + [passage] + w[at:])
        planted.append((passage, members))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = passages(df).toPandas()
    assert not clean & set(got.doc_id)
    for passage, members in planted:
        for m in members:
            own = got[got.doc_id == m]
            assert any(passage in texts[m][a:b] for a, b in zip(own.start, own.end))
            assert bool(own.removed.iloc[0]) == (m != members[0]) and own.kept_id.iloc[0] == members[0]
    left = {x.doc_id: x.text for x in deduplicated(df).collect()}
    assert all(sum(passage in left[m] for m in members) == 1 for passage, members in planted)
    assert all(left[i] == texts[i] for i in clean)


def test_odd_rows_keep_their_passages(spark, odd, none):
    assert passages(odd).filter("doc_id <> 7 OR doc_id IS NULL").count() == 0
    assert passages(none).count() == 0 and deduplicated(none).columns == none.columns
    long = odd.filter("doc_id = 7")
    two = odd.union(long.selectExpr("12 AS doc_id", *long.columns[1:]))
    got = {r.doc_id: r for r in deduplicated(two).collect()}
    assert 12 not in got and got[7].text.startswith("w0 w1 ") and got[3].text is None and got[7].n == 3


def test_benchmark_with_edits(spark, odd, none):
    r = random.Random(5)
    items = [(i, words(r, r.randint(15, 40)).capitalize()) for i in range(20)] + [(50, None), (51, ""), (52, "Tiny")]
    rows, want = [], set()
    for i, text in items[:20]:
        size = len(text)
        for edits in (0, int(size * dc.BUDGET)):
            w = list(text)
            for at in sorted(r.sample(range(1, size - 1), edits), reverse=True):
                w[at] = "#" if r.random() < 0.5 else ""
            rows.append((len(rows), words(r, 30) + "\n " + "".join(w).upper() + "  " + words(r, 30)))
            want.add((len(rows) - 1, i))
        w = list(text)
        for at in range(0, size, 6):
            w[at] = "#"
        rows.append((len(rows), words(r, 20) + "".join(w)))
    rows.append((len(rows), " TINY "))
    want.add((len(rows) - 1, 52))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dc.contaminated(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    text = dict(rows)
    for x in got:
        if x.edits == 0 and x.item_id < 50:
            assert " ".join(text[x.doc_id][x.start:x.end].lower().split()) == dict(items)[x.item_id].lower()
    assert dc.contaminated(odd, bench).count() == 0 and dc.contaminated(none, bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
    left = dc.decontaminated(odd.union(odd.limit(1).selectExpr("77 AS doc_id", f"'{rows[0][1]}' AS text", *odd.columns[2:])), bench)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_alignment_counts_edits():
    item, text = (np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64) for s in ("abcdefghijkl", "xxabcdzefghikl yy"))
    assert dc.align(item, text, 4) == (2, 14)


def test_passages_beside_a_shorter_copy(spark):
    """Two documents share a passage of which a third, the paragraphs' first holder, has a part."""
    r = random.Random(7)
    rows = []
    for n in range(30):
        w = words(r, 64).split(" ")
        part = w[:45] if n % 2 else w[10:56]
        for i, own in enumerate((w, w, part, part)):
            rows.append((10 * n + i, " ".join([words(r, 40), *own, words(r, 40)])))
    text = dict(rows)
    got = passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for n in range(30):
        passage = " ".join(text[10 * n].split(" ")[40:104])
        for i in (0, 1):
            own = [x for x in got if x.doc_id == 10 * n + i]
            assert len(own) == 1 and passage in text[10 * n + i][own[0].start:own[0].end] and own[0].n_words < 70
            assert own[0].removed == (i == 1)


def test_short_lines_do_not_take_the_words_between_them(spark):
    """Two common lines under 50 words, side by side in one document and far apart in another."""
    r = random.Random(8)
    rows = []
    for n in range(30):
        a, b = words(r, 44), words(r, 44)
        rows.append((10 * n, " ".join([words(r, 40), *((a, words(r, 60), b) if n % 2 else (b, words(r, 60), a)), words(r, 40)])))
        rows.append((10 * n + 1, " ".join([words(r, 40), a, words(r, 5), b, words(r, 40)])))
    edited = words(r, 130).split(" ")
    for i in (900, 901):
        rows.append((i, " ".join([words(r, 30), *edited[:65], f"edit{i}", *edited[66:], words(r, 30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages(df).collect()
    assert not [x for x in got if x.doc_id < 900]
    assert sorted((x.doc_id, x.removed, 130 <= x.n_words < 134) for x in got) == [(900, False, True), (901, True, True)]


def test_words_beside_passages_are_asked_for_once(spark, monkeypatch):
    """Near copies meet many partners; the words beside their passages are read once a block all the same."""
    from tablescout.llm import substring_dedup as sd

    made, whole = {}, sd.cut

    def counted(df, label):
        out = whole(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(sd, "cut", counted)
    r = random.Random(9)
    base, rows = words(r, 200).split(" "), []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(200), 4):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    got = passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.doc_id for x in got}) > 250
    blocks = sum(len(t.split(" ")) // sd.STEP + 1 for _, t in rows)
    assert len(made["around"]) == 2 and max(made["around"]) <= blocks
