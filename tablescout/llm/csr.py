"""Sparse matrices in compressed rows, and their products row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PRODUCTS = 1 << 20  # single products made at once


@dataclass
class Csr:
    """Row i holds ``value[start[i]:start[i + 1]]`` in the columns ``column[start[i]:start[i + 1]]``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.start))


def ones(start: np.ndarray, column: np.ndarray, width: int) -> Csr:
    return Csr(start, column, np.ones(len(column), np.int64), width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.column, kind="stable")
    count = np.bincount(m.column, minlength=m.width)
    return Csr(np.concatenate([[0], np.cumsum(count)]), m.row_of()[order], m.value[order], m.rows)


def product_blocks(a: Csr, b: Csr, products: int = PRODUCTS) -> Iterator[tuple[int, Csr]]:
    """The rows of ``a`` times ``b`` in blocks, each with the number of its first row.

    Gustavson's way: a row of the product is the sum of the rows of ``b`` that its entries
    choose. A block takes as many rows as make at most ``products`` single products, or one.
    """
    length = np.diff(b.start)
    work = np.concatenate([[0], np.cumsum(length[a.column])])[a.start]  # single products before each row
    at = 0
    while at < a.rows:
        to = max(at + 1, int(np.searchsorted(work, work[at] + products, "right")) - 1)
        own = slice(a.start[at], a.start[to])
        chosen, many = a.column[own], length[a.column[own]]
        entry = np.arange(int(many.sum())) + np.repeat(b.start[chosen] - (np.cumsum(many) - many), many)
        row = np.repeat(np.repeat(np.arange(to - at), np.diff(a.start[at:to + 1])), many)
        key, where = np.unique(row * b.width + b.column[entry], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.repeat(a.value[own], many) * b.value[entry])
        count = np.bincount(key // max(1, b.width), minlength=to - at)
        yield at, Csr(np.concatenate([[0], np.cumsum(count)]), key % max(1, b.width), total, b.width)
        at = to
