"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.session import cut

CHUNK = 200_000  # links that one task joins into trees


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's links as stars: every node with the smallest one it reaches in the chunk."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    Links are dealt into chunks of at most about ``CHUNK``; each chunk is reduced to stars
    on its own. If there was more than one, large-star and small-star steps alternate until
    nothing moves; each step has at most as many rows as there are links, and minima are
    pre-aggregated, so a hot node never gathers in one task. Null ends and self links are
    ignored; no edge gives no row.
    """
    raw = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"), "links")
    chunks = max(1, -(-raw.count() // CHUNK))
    now = cut(raw.repartition(chunks).mapInArrow(_forest, "u long, v long"), "stars")
    seen = None
    while chunks > 1:
        now = cut(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
