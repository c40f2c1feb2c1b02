"""Packing into windows of near-equal length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.pretokens import Interner, Splitter, texts_of
from tablescout.llm.texts import pieces, shared
from tablescout.session import cut

GROUP = 1024  # pieces that one differencing run takes
GRAIN = 256  # what is left of a document after whole windows is cut into pieces of this size
KNOWN = 1 << 19  # pre-tokens whose ids a task keeps before it starts anew


class Encoder:
    """Token ids of whole texts, each distinct pre-token encoded once while it is kept.

    Broadcast, a Python worker keeps it and what it knows from task to task.
    """

    def __init__(self, path: str):
        self.path = path
        self.splitter = Splitter(path)
        self._forget()

    def __reduce__(self):
        return Encoder, (self.path,)

    def _forget(self):
        self.seen = Interner()
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offset of each text's first id."""
        if len(self.seen) > KNOWN:
            self._forget()
        parts, row, after = self.splitter.segments(texts)
        codes, start, end, value, first = self.splitter.split(parts)
        number, fresh = self.seen.number(value)
        if len(fresh):
            got = self.splitter.tokenizer.encode_batch_fast(texts_of(codes, start[fresh], end[fresh]), add_special_tokens=False)
            ids = [e.ids for e in got]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.length = np.concatenate([self.length, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        size = self.length[number]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        out = self.flat[np.repeat(self.begin[number] - (stop - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        bounds = np.concatenate([[0], stop])[first]  # of each part
        if (after >= 0).any():
            spot = np.flatnonzero(after >= 0)
            out = np.insert(out, bounds[spot + 1], after[spot].astype(np.uint32))
            bounds = bounds + np.concatenate([[0], np.cumsum(after >= 0)])
        return out, np.concatenate([bounds[np.searchsorted(row, np.arange(len(texts)))], bounds[-1:]])


def _cutter(encoder_of, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, offs = encoder.encode(part.column("text").to_pylist())
                doc, start, length, crc, tokens = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    whole = len(own) - len(own) % capacity
                    cuts = [*range(0, whole, capacity), *range(whole, len(own), min(GRAIN, capacity)), len(own)]
                    for at, to in zip(cuts[:-1], cuts[1:]):
                        piece = own[at:to]
                        doc.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        tokens.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size by Karmarkar-Karp differencing into ``windows`` windows.

    Every size starts as a partition with one filled window. The two partitions of the
    largest imbalance are merged, the fullest windows of one onto the emptiest of the other.
    """
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        load, node = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        load[0], node[0] = s, i
        heap.append((-int(s), i, load, node))
    heapq.heapify(heap)
    made, merges, turn = n, [], n
    while len(heap) > 1:
        _, _, la, na = heapq.heappop(heap)
        _, _, lb, nb = heapq.heappop(heap)
        load, nb = la + lb[::-1], nb[::-1]
        both = (na >= 0) & (nb >= 0)
        node = np.where(na >= 0, na, nb)
        k = int(both.sum())
        if k:
            merges.append((made, na[both], nb[both]))
            node[both] = np.arange(made, made + k)
            made += k
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        turn += 1  # ties go to the older partition
        heapq.heappush(heap, (-int(load[0] - load[-1]), turn, load, node))
    window = np.full(made, -1, np.int64)
    if heap:
        final = heap[0][3]
        window[final[final >= 0]] = np.flatnonzero(final >= 0)
    for base, a, b in reversed(merges):
        window[a] = window[base:base + len(a)]
        window[b] = window[base:base + len(a)]
    return window[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, none over ``capacity``; the window count rises until all fit."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, count)
        over = np.maximum(np.bincount(window, sizes, minlength=count) - capacity, 0).sum()
        if not over:
            return window
        count += max(1, int(over) // capacity)


def _packer(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=False, kind="stable").reset_index(drop=True)
        window = windows_of(rows["length"].to_numpy(), capacity)
        rows = rows.assign(sequence_id=(int(key[0]) * (1 << 20) + window) * 2 + 1)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]
    return run


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document is its ids by the tokenizer file followed by ``end_id``. What fills whole
    windows is cut off first; the rests, in pieces of at most ``GRAIN`` ids that balance well,
    are dealt by row into groups of about ``GROUP`` pieces and packed by differencing, so a
    group is bounded whatever key repeats.
    ``offset`` is the place inside the sequence, without gaps.

    A null or empty text is the end id alone; repeated rows and null ids are packed each on
    their own; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = cut(texts.mapInArrow(_cutter(shared(docs.sparkSession, Encoder(path)), capacity, end_id),
                                "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "cuts")
    rows = cuts.withColumn("row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    return full.union(rest.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("g")
                      .applyInPandas(_packer(capacity), PACKED))
