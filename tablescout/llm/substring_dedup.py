"""Passages that repeat across documents: smallest hashes, exact Jaccard, components.

A paragraph is a run of ``LENGTH`` words that starts at an anchor, a word whose hash is the
smallest among ``STEP`` neighbours. Anchors depend on the words alone, so a passage of
LENGTH + STEP - 1 words or more holds the same paragraph in every document, wherever it
stands in a line. Paragraphs of equal words are one class; classes that share one of their
smallest shingle hashes are joined to one of them, compared on their whole shingle sets, and
clustered; classes that this leaves apart are joined on their rarest shingles. Agreeing
neighbours grow to whole passages. Where the passage of a place stops near its paragraph, all places of the paragraph
are met again on every run of ``MIN_WORDS`` words that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.components import components
from tablescout.llm.near_dedup import _open_pairs, parity
from tablescout.llm.texts import BASE, Words, free_names, list_column, mix, pieces, signed, utf8
from tablescout.session import cut

LENGTH, STEP = 26, 24
SHINGLE, PER_CENT = 5, 80
KEYS = 3  # sets of 21 or 22 shingles at 0.8 share all but two, so one of the three smallest; smaller sets are missed with a chance of 3 in 1,000
MIN_WORDS = 50
ISLAND = ["dk", "cdk", "lane", "part", "piece"]
DRIFT = 5  # words by which the places of neighbours may move against their partner's
SIDE = 12  # words beside a paragraph that documents share, on one side, if they share MIN_WORDS


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        jump = min(have, width - have)
        out = pick(out[:-jump], out[jump:]) if len(out) > jump else out[:0]
        have += jump
    return out


def anchors(words: Words) -> np.ndarray:
    """Words at which a paragraph starts that ends in the same row."""
    h = mix(words.hash ^ np.uint64(BASE))
    n = len(h)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    low = _sliding(h, STEP, np.minimum)
    edge = np.zeros(STEP - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), STEP, np.maximum) if len(low) else np.zeros(n, np.uint64)
    at = high[:n] == h
    at[1:] &= h[1:] != h[:-1]  # one anchor in a run of one word
    at[n - LENGTH + 1:] = False
    at[:n - LENGTH + 1] &= words.doc[:n - LENGTH + 1] == words.doc[LENGTH - 1:]
    return np.flatnonzero(at)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``dk``, which tells documents apart; equal rows are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(*utf8(part.column("text")))
            at = anchors(words)
            # all shingles, also across rows: paragraphs use those inside one row only
            n = len(words.hash)
            m = max(0, n - SHINGLE + 1)
            value = np.full(m, SHINGLE, np.uint64)
            for t in range(SHINGLE):
                value = value * np.uint64(BASE) + words.hash[t:t + m]
            value = mix(value)
            k = LENGTH - SHINGLE + 1
            low = np.sort(value[at[:, None] + np.arange(k)], axis=1) if len(at) else np.zeros((0, k), np.uint64)
            twice = low[:, 1:] == low[:, :-1]
            if twice.any():
                low[:, 1:][twice] = np.iinfo(np.uint64).max
                low.sort(axis=1)
            # like paragraphs start at the same word; without it neighbours of one text collide
            keys = [mix(words.hash[at] * np.uint64(BASE) + low[:, b]) for b in range(KEYS)]
            same = np.zeros(len(at), np.uint64)
            for t in range(LENGTH):
                same = same * np.uint64(BASE) + words.hash[at + t]
            doc = words.doc[at]
            # all words of the runs of MIN_WORDS that hold the paragraph, and how many stand before it
            begin, end = np.maximum(at - MIN_WORDS + LENGTH, words.first[doc]), np.minimum(at + MIN_WORDS, words.first[doc + 1])
            around = (at - begin + 1).astype(np.uint64)
            for t in range(2 * MIN_WORDS - LENGTH):
                spot = begin + t
                around = np.where(spot < end, around * np.uint64(BASE) + words.hash[np.minimum(spot, max(0, n - 1))], around)
            yield pa.RecordBatch.from_arrays(
                [part.column("dk").take(pa.array(doc, pa.int64())), part.column("doc_id").take(pa.array(doc, pa.int64())),
                 pa.array((at - words.first[doc]).astype(np.int32)), pa.array(np.diff(words.first)[doc].astype(np.int32)),
                 pa.array(signed(mix(same))), pa.array(signed(mix(around))), *(pa.array(signed(k)) for k in keys)],
                names=["dk", "doc_id", "pos", "size", "same", "around", *(f"h{b}" for b in range(KEYS))])


def _characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(*utf8(part.column("text")))
            asked = part.column("asked")
            doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            pos = asked.flatten().to_numpy()
            n = len(words.hash)
            m = max(0, n - SHINGLE + 1)
            value = np.full(m, SHINGLE, np.uint64)
            for t in range(SHINGLE):
                value = value * np.uint64(BASE) + words.hash[t:t + m]
            value = mix(value) >> np.uint64(32)
            first = words.first[doc] + pos
            sets = [np.unique(value[a:a + LENGTH - SHINGLE + 1]) for a in first]
            marks = parity([mix(x) for x in sets])
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("dk").take(pa.array(doc, pa.int64())), pa.array(pos),
                 list_column(pa.array(flat), np.array([len(x) for x in sets], np.int64)),
                 list_column(pa.array(marks.ravel()), np.full(len(sets), marks.shape[1]))], names=["dk", "pos", "s", "marks"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of asked spans, each its first word and the one behind its last in one number."""
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(*utf8(part.column("text")))
            asked = part.column("asked")
            doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            code = asked.flatten().to_numpy()
            m = max(0, len(words.hash) - SHINGLE + 1)
            value = np.full(m, SHINGLE, np.uint64)
            for t in range(SHINGLE):
                value = value * np.uint64(BASE) + words.hash[t:t + m]
            value = mix(value)
            first, last = words.first[doc] + (code >> 32), words.first[doc] + (code & 0xFFFFFFFF)
            sets = [np.unique(value[a:b - SHINGLE + 1]) for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays(
                [part.column("dk").take(pa.array(doc, pa.int64())), pa.array(code),
                 list_column(pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)), np.array([len(x) for x in sets], np.int64))],
                names=["dk", "code", "s"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all runs of ``MIN_WORDS`` words that hold a paragraph, in two rows a place.

    Runs with ``SIDE`` words or more before the paragraph are under the hash of those words
    and the paragraph, the others under that of the paragraph and the words behind it.
    """
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(*utf8(part.column("text")))
            asked = part.column("asked")
            doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            pos = asked.flatten().to_numpy()
            first, size = words.first[doc], np.diff(words.first)[doc]
            m = max(0, len(words.hash) - MIN_WORDS + 1)
            value = np.zeros(m, np.uint64)
            for t in range(MIN_WORDS):
                value = value * np.uint64(BASE) + words.hash[t:t + m]
            value = mix(value)
            most = MIN_WORDS - LENGTH
            for before, low, high, length in ((SIDE, pos - most, pos - SIDE, LENGTH + SIDE), (0, pos - SIDE + 1, pos, LENGTH + most - SIDE + 1)):
                low, high = np.maximum(low, 0), np.minimum(high, size - MIN_WORDS)
                own = np.flatnonzero(high >= low)
                count = (high - low + 1)[own]
                at = (first + pos)[own] - before
                key = np.full(len(own), before + 1, np.uint64)
                for t in range(length):
                    key = key * np.uint64(BASE) + words.hash[at + t]
                spot = np.repeat((first + low)[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("dk").take(pa.array(doc[own], pa.int64())), pa.array(pos[own]), pa.array((low - pos)[own].astype(np.int32)), pa.array(signed(mix(key))), list_column(pa.array(signed(value[spot])), count)],
                    names=["dk", "pos", "low", "key", "runs"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of asked blocks of ``STEP`` words, and as many before and behind them."""
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(*utf8(part.column("text")))
            asked = part.column("asked")
            doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            block = asked.flatten().to_numpy()
            first, size = words.first[doc], np.diff(words.first)[doc]
            low, high = np.maximum(block - 1, 0) * STEP, np.minimum((block + 2) * STEP, size)
            count = (high - low).astype(np.int64)
            spot = np.repeat(first + low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield pa.RecordBatch.from_arrays(
                [part.column("dk").take(pa.array(doc, pa.int64())), pa.array(block), list_column(pa.array(signed(words.hash[spot])), count)],
                names=["dk", "block", "words"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points at which passages begin, at their first word, or end, behind their last."""
    for batch in batches:
        for part in pieces(batch, "text"):
            data, offs = utf8(part.column("text"))
            words, chars = Words(data, offs), _characters(data)
            asked = part.column("asked")
            doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            code = asked.flatten().to_numpy()
            right = code & 1
            word = words.first[doc] + (code >> 1) - right
            place = chars[np.where(right == 1, words.end[word], words.start[word])] - chars[offs[doc]]
            yield pa.RecordBatch.from_arrays(
                [part.column("dk").take(pa.array(doc, pa.int64())), pa.array(code), pa.array(place.astype(np.int32))],
                names=["dk", "code", "place"])


def _asked(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The documents asked for, once each, with the asked numbers; bounded by a document."""
    lists = wanted.groupBy("dk").agg(F.collect_set(column).alias("asked"))
    return docs.join(lists, "dk").select("dk", "doc_id", "text", "asked").dropDuplicates(["dk"])


def _islands(texts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the island of each, and the islands.

    Paragraphs that touch in both documents are a piece. Pieces with other words between
    them are one island if both spans, these words included, reach the similarity.
    """
    way = Window.partitionBy("dk", "cdk").orderBy("way")
    lane = F.sum(F.when(F.col("way") - F.lag("way").over(way) <= DRIFT, 0).otherwise(1)).over(way.rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy("dk", "cdk", "lane").orderBy("pos", "cpos")
    rows = rows.withColumn("way", F.col("pos") - F.col("cpos")).withColumn("lane", lane).withColumn("step", F.col("pos") - F.lag("pos").over(w))
    for name, most in (("part", LENGTH + STEP), ("piece", LENGTH)):
        rows = rows.withColumn(name, F.sum(F.when(F.col("step") <= most, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut(rows, "pieces")

    def spans(by):
        f, last = F.min(F.struct("pos", "cpos")), F.max(F.struct("pos", "cpos"))
        return rows.groupBy(*by).agg(f.alias("f"), last.alias("l"), F.min(F.struct("kept_id", "kept_dk", "component")).alias("o"),
                                     F.min("piece").alias("x"), F.max("piece").alias("y")).select(
            *by, F.col("f.pos").alias("p0"), F.col("f.cpos").alias("c0"), (F.col("l.pos") + LENGTH).alias("p1"),
            (F.greatest("l.cpos", "f.cpos") + LENGTH).alias("c1"), "o.*", "x", "y")

    whole = cut(spans(ISLAND[:-1]).filter("x <> y"), "joined")
    code = [(F.col(a).cast("long") * (1 << 32) + F.col(b)) for a, b in (("p0", "p1"), ("c0", "c1"))]
    asked = whole.select("dk", code[0].alias("code")).union(whole.select("cdk", code[1].alias("code"))).distinct()
    sets = cut(_asked(texts, asked, "code").mapInArrow(_spans, "dk long, code long, s array<long>"), "spans")
    both = whole.withColumn("ca", code[0]).withColumn("cb", code[1]).join(
        sets.select("dk", F.col("code").alias("ca"), F.col("s").alias("sa")), ["dk", "ca"]).join(
        sets.select(F.col("dk").alias("cdk"), F.col("code").alias("cb"), F.col("s").alias("sb")), ["cdk", "cb"])
    i = F.size(F.array_intersect("sa", "sb"))
    alike = both.filter(i * 100 >= (F.size("sa") + F.size("sb") - i) * PER_CENT).select(*ISLAND[:-1], F.lit(True).alias("alike"))
    rows = cut(rows.join(alike, ISLAND[:-1], "left").withColumn("piece", F.when(F.col("alike"), 0).otherwise(F.col("piece"))), "parts")
    return rows, cut(spans(ISLAND).drop("x", "y"), "islands")


def _run_islands(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Passages of equal words at ``places``: each run of ``MIN_WORDS`` words with its first document.

    Runs are equal as a whole, so one partner for each of them loses no passage.
    """
    # places with the same words around are one, known by its first document
    one = cut(places.groupBy("same", "around").agg(
        F.min(F.struct("dk", "pos", "size")).alias("r"), F.max("dk").alias("last"), F.min(F.struct("doc_id", "dk")).alias("k")).select(
        "same", "around", F.col("r.dk").alias("dk"), F.col("r.pos").alias("pos"), F.col("r.size").alias("size"), "last", "k"), "surroundings")
    runs = cut(_asked(texts, one, "pos").mapInArrow(_runs, "dk long, pos int, low int, key long, runs array<long>")
               .join(one.drop("same", "around"), ["dk", "pos"]), "runs")
    met = runs.groupBy("key").agg(F.min("dk").alias("x"), F.max("last").alias("y")).filter("x <> y").select("key")
    run = cut(runs.join(met, "key").select("dk", "pos", "size", "low", "last", "k", F.posexplode("runs").alias("i", "h")).select(
        "dk", "pos", "size", (F.col("low") + F.col("i")).alias("off"), "h", "last", "k"), "run")
    group = run.groupBy("h").agg(F.min(F.struct("dk", (F.col("pos") + F.col("off")).alias("at"), "size")).alias("c"), F.max("last").alias("last"), F.min("k").alias("k"))
    group = group.filter("c.dk <> last").select(
        "h", F.col("c.dk").alias("cdk"), F.col("c.at").alias("cat"), F.col("c.size").alias("csize"), F.struct("k.doc_id", "k.dk", "h").alias("o"))
    rows = run.select("dk", "pos", "off", "h").join(group, "h").withColumn("way", F.col("pos") + F.col("off") - F.col("cat"))
    w = Window.partitionBy("dk", "pos", "cdk", "way").orderBy("off")
    part = F.sum(F.when(F.col("off") - F.lag("off").over(w) <= 1, 0).otherwise(1)).over(w)
    spans = cut(rows.withColumn("part", part).groupBy("dk", "pos", "cdk", "way", "part").agg(
        F.min("off").alias("off"), F.min("cat").alias("c0"), (F.max("cat") + MIN_WORDS).alias("c1"), F.min("csize").alias("csize"), F.min("o").alias("o")), "run_spans")
    met = places.select("same", "around", F.col("dk").alias("own"), F.col("pos").alias("at"), "size").join(
        one.select("same", "around", "dk", "pos"), ["same", "around"]).join(spans, ["dk", "pos"]).filter("own <> cdk").select(
        F.col("own").alias("dk"), "cdk", (F.col("at") + F.col("off")).alias("p0"), "c0", "c1", "size", "csize", "o").withColumn("way", F.col("p0") - F.col("c0"))
    w = Window.partitionBy("dk", "cdk", "way").orderBy("c0", "c1")
    past = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("c0") <= F.col("past"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut(met.withColumn("past", past).withColumn("part", part).groupBy("dk", "cdk", "way", "part").agg(
        F.min("p0").alias("p0"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("size").alias("size"), F.min("csize").alias("csize"), F.min("o").alias("o")).select(
        "dk", "cdk", "p0", "c0", (F.col("c1") + F.col("way")).alias("p1"), "c1", "size", "csize",
        F.col("o.doc_id").alias("kept_id"), F.col("o.dk").alias("kept_dk"), F.col("o.h").alias("component")), "run_islands")


def _grown(texts: DataFrame, island: DataFrame) -> DataFrame:
    """Islands with the words, ``left`` and ``right``, by which both sides agree beyond them.

    Only ends with ``open0`` (left) and ``open1`` (right) are followed, by ``STEP`` words at
    most. Words are asked for by blocks, so there are no more of them than the texts have.
    """
    ends = [island.filter(f"open{r}").select("dk", F.col(p).alias("p"), "cdk", F.col(c).alias("c"), F.lit(r).alias("r"))
            for r, p, c in ((0, "p0", "c0"), (1, "p1", "c1"))]
    ends = cut(ends[0].union(ends[1]).distinct(), "ends")
    block = [F.expr(f"{x} div {STEP}").cast("int").alias("block") for x in ("p", "c")]
    wanted = ends.select("dk", block[0]).union(ends.select("cdk", block[1])).distinct()
    around = cut(_asked(texts, wanted, "block").mapInArrow(_surroundings, "dk long, block int, words array<long>"), "around")

    def outward(x: str):
        """The ``STEP`` words before place ``x``, nearest first, or behind it."""
        low, begin = F.greatest(F.col("block") - 1, F.lit(0)) * STEP, F.greatest(F.col(x) - STEP, F.lit(0))
        return F.when(F.col("r") == 0, F.reverse(F.slice("words", begin - low + 1, F.col(x) - begin))).otherwise(
            F.slice("words", F.col(x) - low + 1, F.lit(STEP)))

    met = ends.withColumn("block", block[0]).join(around, ["dk", "block"]).select("dk", "p", "cdk", "c", "r", outward("p").alias("own"))
    met = met.withColumn("block", block[1]).join(around.withColumnRenamed("dk", "cdk"), ["cdk", "block"]).select(
        "dk", "p", "cdk", "c", "r", "own", outward("c").alias("other"))
    differ = F.expr("array_position(zip_with(own, other, (a, b) -> a <=> b), false)")
    grown = cut(met.withColumn("differ", differ).select("dk", "p", "cdk", "c", "r", F.when(F.col("differ") == 0, F.size("own")).otherwise(
        F.col("differ") - 1).cast("int").alias("n")), "growth")
    for name, r, p, c in (("left", 0, "p0", "c0"), ("right", 1, "p1", "c1")):
        one = grown.filter(F.col("r") == r).select("dk", F.col("p").alias(p), "cdk", F.col("c").alias(c), F.col("n").alias(name))
        island = island.join(one, ["dk", p, "cdk", c], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return island


def _sides(island: DataFrame) -> DataFrame:
    """Both documents' spans of grown islands, if they are passages."""
    sides = None
    for d, p0, p1 in (("dk", "p0", "p1"), ("cdk", "c0", "c1")):
        one = island.select(F.col(d).alias("dk"), (F.col(p0) - F.col("left")).alias("w0"), (F.col(p1) + F.col("right")).alias("w1"),
                            "component", "kept_id", F.expr(f"{d} <> kept_dk").alias("removed"))
        sides = one if sides is None else sides.union(one)
    return sides.filter(F.col("w1") - F.col("w0") >= MIN_WORDS)


def _overlapping(spans: DataFrame) -> DataFrame:
    """``spans`` with ``part``, which numbers those of one document and verdict that overlap or touch."""
    w = Window.partitionBy("dk", "removed").orderBy("w0", "w1")
    past = F.max("w1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("w0") <= F.col("past"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("past", past).withColumn("part", part).drop("past")


def _open_ends(sides: DataFrame, island: DataFrame) -> DataFrame:
    """Islands of ``MIN_WORDS`` or more with ``open0`` and ``open1``: whether growth at that end can add a word.

    An end that lies ``STEP`` words or more inside the spans that its document has anyway
    adds none, nor does one beside the edge of the document.
    """
    key = ["dk", "p0", "cdk", "c0"]
    none = [F.lit(None).cast(t) for t in ("long", "int", "long", "int", "int")]
    spans = sides.select("dk", "w0", "w1", "removed", *[x.alias(n) for x, n in zip(none, ("d", "p", "cd", "c", "size"))])
    for d, p0, p1, size in (("dk", "p0", "p1", "size"), ("cdk", "c0", "c1", "csize")):
        spans = spans.union(island.select(d, p0, p1, F.expr(f"{d} <> kept_dk"), *key, size))
    w = Window.partitionBy("dk", "removed", "part")
    spans = _overlapping(spans).withColumn("u0", F.min("w0").over(w)).withColumn("u1", F.max("w1").over(w)).filter("d IS NOT NULL")
    ends = spans.groupBy(*[F.col(a).alias(b) for a, b in zip(("d", "p", "cd", "c"), key)]).agg(
        F.max((F.col("w0") - F.col("u0") < STEP) & (F.col("u0") > 0)).alias("open0"),
        F.max((F.col("u1") - F.col("w1") < STEP) & (F.col("u1") < F.col("size"))).alias("open1"))
    return cut(island.drop("size", "csize").join(ends, key), "open_ends")


def passages(docs: DataFrame) -> DataFrame:
    """dk, doc_id, start, end, n_words, component, kept_id, removed: one row per passage.

    Passages of ``MIN_WORDS`` words or more that stand in several documents, as code point
    spans. ``removed`` is false where the passage stays: in the smallest doc_id (then dk)
    of its cluster. Repeats inside one document alone are no cluster of documents and give
    no row. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.

    Null and empty texts and texts under ``LENGTH`` words give nothing; rows equal in
    doc_id and text are one document; rows that share a doc_id but not the text are two,
    a null doc_id comes first; an empty table gives no rows; other columns are ignored.
    """
    texts = _keyed(docs)
    # nearly all paragraphs stand alone: they are read from the texts twice and written only where a class meets another document
    here = texts.mapInArrow(
        _paragraphs, "dk long, doc_id long, pos int, size int, same long, around long, " + ", ".join(f"h{b} long" for b in range(KEYS)))
    # paragraphs of equal words are one class, known by its hash; only classes are banded and compared
    classes = here.groupBy("same").agg(
        F.min("dk").alias("cdk"), F.max("dk").alias("last"), *[F.min(f"h{b}").alias(f"h{b}") for b in range(KEYS)])
    # keys are shuffled once, in the same form for the counts and for the join
    keys = classes.select("same", "cdk", "last", F.explode(F.array(*[f"h{b}" for b in range(KEYS)])).alias("h")).repartition("h")
    centre = keys.groupBy("h").agg(F.min(F.struct("cdk", "same")).alias("c"), F.max("last").alias("_last")).filter("c.cdk <> _last")
    found = cut(keys.join(centre.select("h", F.col("c.same").alias("csame")).hint("merge"), "h"), "colliding")
    links = cut(found.select("same", "csame", "cdk", "last").distinct(), "links")
    member = cut(here.select("same", "around", "dk", "pos", "size", "doc_id").join(
        links.select("same", "cdk").distinct(), "same"), "members")
    # a class is compared, and met by others, at its first place in its smallest document
    place = cut(member.filter("dk = cdk").groupBy("same", "dk").agg(F.min("pos").alias("pos")), "places")
    open_ = links.filter("same <> csame").select("same", "csame")
    wanted = place.join(open_.select("same").union(open_.select("csame")).distinct(), "same")
    sets = cut(_asked(texts, wanted, "pos").mapInArrow(_sets, "dk long, pos int, s array<long>, marks array<long>")
               .join(wanted, ["dk", "pos"]).select("same", "s", "marks"), "sets")

    def verified(pairs):
        both = pairs.join(sets.select("same", F.col("s").alias("sa")), "same").join(
            sets.select(F.col("same").alias("csame"), F.col("s").alias("sb")), "csame")
        i, u = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
        return cut(both.filter(i * 100 >= u * PER_CENT).select("same", "csame"), "alike")

    alike = verified(open_)
    # classes of a bucket that are still apart after the centre's round meet on their rarest shingles
    label = components(alike.select(F.col("same").alias("a"), F.col("csame").alias("b")), "a", "b")
    state = cut(found.select("h", "same").join(label.withColumnRenamed("node", "same"), "same", "left").withColumn(
        "component", F.coalesce("component", "same")), "labelled")
    apart = state.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("h")
    rest = cut(state.join(apart, "h").select(F.col("same").alias("cls"), "component").distinct(), "apart")
    more = verified(_open_pairs(rest, sets.withColumnRenamed("same", "cls"), PER_CENT).select(
        F.col("b").alias("same"), F.col("a").alias("csame")))
    alike = alike.union(more)
    # equal paragraphs of several documents meet at their own place where no other class takes them in
    several = links.filter("cdk <> last")
    own = several.filter("same = csame").select("same").union(
        several.select("same").join(alike.select("same").distinct(), "same", "left_anti")).distinct()
    good = alike.union(own.select("same", F.col("same").alias("csame")))
    partners = good.join(place.select(F.col("same").alias("csame"), F.col("dk").alias("cdk"), F.col("pos").alias("cpos")), "csame").groupBy(
        "same").agg(F.collect_list(F.struct("cdk", "cpos")).alias("partners"))
    group = components(alike.select(F.col("same").alias("a"), F.col("csame").alias("b")), "a", "b").withColumnRenamed("node", "same")
    nodes = good.select("same").union(good.select("csame")).distinct().join(group, "same", "left").withColumn(
        "component", F.coalesce("component", "same"))
    first = member.groupBy("same").agg(F.min(F.struct("doc_id", "dk")).alias("k"))
    nodes = cut(nodes.join(first, "same").join(partners, "same", "left"), "nodes")
    keeper = nodes.groupBy("component").agg(F.min("k").alias("k"))
    nodes = nodes.drop("k").join(keeper, "component").select(
        "same", "component", F.col("k.doc_id").alias("kept_id"), F.col("k.dk").alias("kept_dk"), "partners")
    owner = cut(member.drop("cdk", "around").distinct().join(nodes, "same").select(
        "dk", "doc_id", "pos", "size", "same", "component", "kept_id", "kept_dk", F.inline_outer("partners")), "owner")
    # neighbours that agree with one document are one passage
    rows, island = _islands(texts, owner.filter("dk <> cdk"))
    island = cut(_grown(texts, island.withColumn("open0", F.lit(True)).withColumn("open1", F.lit(True))), "grown")
    # every other run of MIN_WORDS words at a place whose passage does not hold all its runs can have another partner
    reach = rows.join(island.select(*ISLAND, (F.col("p0") - F.col("left")).alias("w0"), (F.col("p1") + F.col("right")).alias("w1")),
                      ISLAND).groupBy("same", "dk", "pos").agg(F.max(
        (F.col("w0") <= F.greatest(F.col("pos") - MIN_WORDS + LENGTH, F.lit(0)))
        & (F.col("w1") >= F.least(F.col("pos") + MIN_WORDS, "size"))).alias("whole"))
    unsettled = reach.filter("NOT whole").select("same").distinct()
    sides = _sides(island)
    run = _run_islands(texts, cut(member.drop("cdk").distinct().join(unsettled, "same"), "unsettled"))
    sides = sides.union(_sides(_grown(texts, _open_ends(sides, run))))
    # overlapping spans of one document with one verdict are one row
    merged = cut(_overlapping(sides).groupBy("dk", "removed", "part").agg(
        F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.min("component").alias("component"), F.min("kept_id").alias("kept_id")), "spans")
    code = [(F.col("w0") * 2).alias("code"), (F.col("w1") * 2 + 1).alias("code")]
    edge = cut(_asked(texts, merged.select("dk", code[0]).union(merged.select("dk", code[1])).distinct(), "code").mapInArrow(
        _edges, "dk long, code int, place int"), "edges")
    for name, word, r in (("start", "w0", 0), ("end", "w1", 1)):
        merged = merged.join(edge.filter(F.col("code") % 2 == r).select(
            "dk", F.shiftright("code", 1).alias(word), F.col("place").alias(name)), ["dk", word])
    # what one cluster keeps and another removes whole is removed
    merged = cut(merged.withColumn("n_words", F.col("w1") - F.col("w0")), "merged")
    gone = merged.filter("removed").select(F.col("dk").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    stays = merged.filter("NOT removed").join(gone, F.expr("dk = d AND a <= start AND end <= b"), "left_anti")
    ids = owner.select("dk", "doc_id").distinct()
    return merged.filter("removed").union(stays).join(ids, "dk").select(
        "dk", "doc_id", "start", "end", "n_words", "component", "kept_id", "removed")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their removed passages, with their own columns.

    ``n_chars``, where there is such a column, counts the new text. Rows of which nothing
    but white space is left go; other rows stay, with their text cut or whole.
    """
    key, spans = free_names(docs, "dk", "spans")
    gone = passages(docs).filter("removed").groupBy(F.col("dk").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text)).join(gone, key, "left")
    rest = F.expr(f"""concat_ws('', transform(sequence(0, size({spans})), i -> substring(
        text, if(i = 0, 0, get({spans}, i - 1).end) + 1,
        greatest(if(i = size({spans}), length(text), get({spans}, i).start) - if(i = 0, 0, get({spans}, i - 1).end), 0))))""")
    out = out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(rest))
    out = out.filter(F.col(spans).isNull() | (F.length(F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " "))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
