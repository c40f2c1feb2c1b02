"""Vectorised views of text columns inside Arrow batches: bytes, words, hashes, lookups.

All functions run in tasks on one bounded piece of a batch. Hashes are 64 bits wide; two
different words or shingles meet with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

def free_names(df, *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of ``df`` is called so, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared(spark, thing):
    """A function that gives ``thing`` inside tasks; each Python worker unpacks it once for all its tasks.

    Classes travel with it, so that workers need no copy of this package.
    """
    held = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    def get():
        if "thing" not in held.value:
            held.value["thing"] = pickle.loads(held.value.pop("packed"))
        return held.value["thing"]
    return get


PIECE_BYTES = 2 << 20  # text bytes handled at once; one longer text is handled alone
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers: the permutation that circulant MinHash shifts."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES):
    """Slices of a batch, each with at most ``limit`` bytes of text or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield batch.slice(at)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, A-Z lower-cased.

    ``start`` and ``end`` are byte places, ``doc`` the row, ``hash`` the word's hash,
    ``first`` the index of each row's first word (one more entry closes the last row).
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        size = len(data)
        lut = np.arange(256, dtype=np.uint8)
        lut[65:91] += 32
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        low = lut[data]
        ink = ~space[data]
        edge = np.zeros(size + 1, bool)
        edge[offs] = True
        before = np.empty(size, bool)
        before[:1] = True
        before[1:] = ~ink[:-1] | edge[1:-1]
        after = np.empty(size, bool)
        after[-1:] = True
        after[:-1] = ~ink[1:] | edge[1:-1]
        self.start = np.flatnonzero(ink & before)
        self.end = np.flatnonzero(ink & after) + 1
        power = np.full(size, BASE, np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(letters[low] * power, out=total[1:])
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        back[:1] = 1
        np.cumprod(back, out=back)
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offs)), "left")

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``k`` words inside one row.

        A row with fewer words gives its whole sequence as one; a row without words none.
        """
        n = len(self.hash)
        m = max(0, n - k + 1)
        value = np.full(m, k, np.uint64)
        for t in range(k):
            value = value * np.uint64(BASE) + self.hash[t:t + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1:k - 1 + m]) if m else np.zeros(0, np.int64)
        value = mix(value[at])
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for j, d in enumerate(short):
                own = self.hash[self.first[d]:self.first[d + 1]]
                h = np.full(1, len(own), np.uint64)
                for w in own:
                    h = h * np.uint64(BASE) + w
                extra[j] = mix(h)[0]
            at = np.concatenate([at, self.first[short]])
            value = np.concatenate([value, extra])
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
        return value, at


class KeyTable:
    """Places of 64-bit keys by open addressing, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64, copy=False)
        bits = max(4, int(len(keys) * 3 + 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys), dtype=np.int32)
        at = mix(keys) & self.mask
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + np.uint64(1)) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where it is absent."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        rest = None
        at = mix(wanted) & self.mask
        while True:
            got = self.slot[at]
            hit = (got >= 0) & (self.keys[got] == wanted)
            if rest is None:
                out[hit] = got[hit]
                rest = np.flatnonzero((got >= 0) & ~hit)
            else:
                out[rest[hit]] = got[hit]
                rest = rest[(got >= 0) & ~hit]
            if not len(rest):
                return out
            at = (at[(got >= 0) & ~hit] + np.uint64(1)) & self.mask
            wanted = wanted[(got >= 0) & ~hit]


def list_column(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of the given lengths over ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
