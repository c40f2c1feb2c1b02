"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard, components.

Two permutations give the whole signature: the first places a shingle on a circle of 2^32
places, the second, shifted by one place per coordinate, is minimised over the set. With 20
bands of 4 rows a pair at similarity 0.85 is missed with a chance below 4 in 10 million,
at 0.8 below 2 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.components import components
from tablescout.llm.texts import BASE, Words, list_column, mix, mix32, pieces, signed, utf8
from tablescout.session import cut

STARS = 2  # rounds in which every bucket's classes are tested against one of them
MARKS = 16  # longs of a set's parity marks: 1,024 bits


def circulant(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of the sets ``values[first[i]:first[i + 1]]``, none of them empty."""
    circle = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat(mix32(circle + np.uint32(b * rows + r)), first)
            h = h * np.uint64(BASE) + low
        out[:, b] = mix(h)
    return out


def _distinct(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """For each set one bit per place, 1 where an odd number of its shingles falls.

    Two sets differ in at least as many shingles as their marks differ in bits.
    """
    out = np.zeros((len(sets), MARKS * 64), np.uint8)
    for row, values in zip(out, sets):
        row[:] = np.bincount((values >> np.uint64(20)).astype(np.int64) % len(row), minlength=len(row)) & 1
    return np.packbits(out, axis=1).view(np.int64)


def _signer(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*utf8(part.column("text")))
                value, at = words.shingles(k)
                first = np.searchsorted(words.doc[at], np.arange(part.num_rows + 1))
                sets = _distinct(value, first)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(n)
                digest = np.zeros((2, part.num_rows), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(full):
                    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    digest[0, full] = np.add.reduceat(mix(flat), begin)
                    digest[1, full] = np.add.reduceat(mix(flat ^ np.uint64(BASE)), begin)
                    keys = circulant(flat, begin, bands, rows)
                counts = np.where(n > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(signed(digest[0])), pa.array(signed(digest[1])),
                     list_column(pa.array(signed(keys.ravel())), counts)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"])
    return run


def _shingler(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*utf8(part.column("text")))
                value, at = words.shingles(k)
                sets = _distinct(value, np.searchsorted(words.doc[at], np.arange(part.num_rows + 1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), list_column(
                        pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)), np.array([len(s) for s in sets])),
                     list_column(pa.array(parity(sets).ravel()), np.full(len(sets), MARKS))],
                    names=["cls", "s", "marks"])
    return run


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Size, digest of the whole set and band hashes of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signer(k, bands, rows),
        "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
            .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                    F.size(F.array_intersect("sa", "sb")).alias("i")))
    return both.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * per_cent).select("a", "b")


def _fits(per_cent: int):
    """Whether two set sizes allow the similarity."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent


def links(sig: DataFrame, docs: DataFrame, k: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the component of every class that has a link.

    Equal sets are one class before anything is joined, so thousands of copies cost one
    row. First all classes of a bucket are tested against one centre; classes that it
    gathers are one component and need no test among themselves. Classes of buckets that
    still hold several components are then joined on their rarest shingles, which loses no
    pair, so that no link is left out however large the bucket is.
    """
    full = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("n_shingles", "d1", "d2").agg(
        F.min("doc_id").alias("cls"), F.first("bands").alias("bands")), "classes")
    keys = classes.select("cls", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "h"))
    shared = keys.groupBy("band", "h").agg(F.count("*").alias("c")).filter("c > 1").select("band", "h")
    members = cut(keys.join(shared, ["band", "h"]).select(F.xxhash64("band", "h").alias("bucket"), "cls", "n"), "members")
    wanted = members.select("cls").distinct()
    # the class is named after a document; rows that share an id are one document
    sets = cut(docs.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string"))
               .join(wanted, "cls", "left_semi").mapInArrow(_shingler(k), "cls long, s array<long>, marks array<long>")
               .filter("size(s) > 0").dropDuplicates(["cls", "s"]), "sets")
    found = label = None
    for turn in range(STARS):
        state = _mixed(members, label)
        place = F.xxhash64("cls", F.lit(turn))
        centre = state.groupBy("bucket").agg(F.min(F.struct(place.alias("p"), "cls", "n", "component")).alias("c")).select(
            "bucket", F.col("c.cls").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca"))
        other = state.select("bucket", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        pairs = centre.join(other, "bucket").filter("ca <> cb").filter(_fits(per_cent)).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = cut(_verified(pairs, sets, per_cent), "found")
        found = new if found is None else found.union(new)
        label = _label(found)
    pairs = _open_pairs(_mixed(members, label).select("cls", "component").distinct(), sets, per_cent)
    return classes, _label(found.union(_verified(pairs, sets, per_cent)))


def _label(found: DataFrame) -> DataFrame:
    return cut(components(found, "a", "b").select(F.col("node").alias("cls"), "component"), "label")


def _mixed(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """The members of buckets that hold more than one component so far."""
    own = F.col("cls")
    state = members.withColumn("component", own) if label is None else members.join(label, "cls", "left").withColumn(
        "component", F.coalesce("component", own))
    several = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    return cut(state.join(several, "bucket"), "mixed")


def _open_pairs(rest: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of different components that can still be alike: they share a rare shingle.

    Two sets of the similarity share one of their n - ceil(per_cent * n / 100) + 1 rarest
    shingles. In a group of near copies the rarest are those of a copy's own changes, so
    copies changed too much meet nobody, and no pair of one component is made. The parity
    marks bound the difference of two sets from below, so nearly every pair made is alike.
    """
    rows = sets.join(rest, "cls").select("cls", "component", F.size("s").alias("n"), F.explode("s").alias("g"))
    often = rows.groupBy("g").agg(F.count("*").alias("f"), F.min("component").alias("x"), F.max("component").alias("y"))
    ranked = rows.join(often, "g").groupBy("cls", "component", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "g", (F.col("x") != F.col("y")).alias("open")))).alias("r"))
    size = (F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1).cast("int")
    head = F.transform(F.slice("r", 1, size), lambda x, i: F.struct(x["g"].alias("g"), x["open"].alias("open"), i.alias("i")))
    head = ranked.select("cls", "component", "n", head.alias("r")).select(
        "cls", "component", "n", F.transform("r", lambda x: x["g"]).alias("gs"), F.explode(F.filter("r", lambda x: x["open"])).alias("t"))
    head = cut(head.select("cls", "component", "n", F.col("t.g").alias("g"), F.col("t.i").alias("i"),
                           F.when(F.col("t.i") > 0, F.slice("gs", F.lit(1), F.col("t.i"))).otherwise(F.array().cast("array<long>")).alias("before"))
               .join(sets.select("cls", "marks"), "cls"), "rare")

    def side(x):
        return head.select(F.col("g").alias("g" + x), *(F.col(c).alias(c + x) for c in ("cls", "n", "component", "i", "before", "marks")))

    # the rarest common shingle decides for a pair; what is left behind it bounds the overlap
    rest = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    enough = rest * (100 + per_cent) >= (F.col("na") + F.col("nb")) * per_cent
    apart = sum((F.bit_count(F.col("marksa")[i].bitwiseXOR(F.col("marksb")[i])) for i in range(MARKS)), F.lit(0))
    near = apart * (100 + per_cent) <= (F.col("na") + F.col("nb")) * (100 - per_cent)
    return side("a").join(side("b"), (F.col("ga") == F.col("gb")) & (F.col("componenta") < F.col("componentb")) & _fits(per_cent) & enough
                          & near & ~F.arrays_overlap("beforea", "beforeb")).select(
        F.least("clsa", "clsb").alias("a"), F.greatest("clsa", "clsb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents are linked when 100 * intersection >= per_cent * union of their sets of
    distinct ``k``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer
    words: the whole sequence is one shingle). ``component_id`` is the smallest doc_id
    reachable, ``kept`` whether that is the row's own.

    A null or wordless text has an empty set and no link. A row without doc_id gives
    component_id null and is kept. Rows that share a doc_id are one document. Equal texts
    meet whatever their number; no partner or bucket is capped. Other columns are ignored;
    an empty table gives an empty result.
    """
    sig = cut(signatures(docs, k, bands, rows), "signatures")
    classes, label = links(sig, docs, k, per_cent)
    named = classes.select("n_shingles", "d1", "d2", "cls").join(label, "cls", "left").select(
        "n_shingles", "d1", "d2", F.coalesce("component", "cls").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_per_group(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for.

    Of rows that share a doc_id one stays, the one whose text sorts first.
    """
    found = near_duplicates(docs, k, per_cent).groupBy("doc_id").agg(
        F.min("kept").alias("_kept"), F.count("*").alias("_rows")).filter("doc_id IS NOT NULL AND (NOT _kept OR _rows > 1)")
    found = cut(found, "copies")
    out = docs.join(found.filter("NOT _kept").select("doc_id"), "doc_id", "left_anti")
    again = found.filter("_kept").select("doc_id")
    if again.isEmpty():
        return out.select(*[docs[c] for c in docs.columns])
    single = out.join(again, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    row = F.struct(*[docs[c] for c in ("text", *(c for c in docs.columns if c != "text"))])
    several = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row"))
    return single.union(several.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns]))
