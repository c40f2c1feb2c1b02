"""Exact top-k inner products by tiles of queries and shards, merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.texts import list_column
from tablescout.session import cut

TILE = 4096  # vectors in a query tile or a shard
STRIP = 256  # queries multiplied at once: STRIP x TILE scores are held
FAN_IN = 8  # top lists that one merge takes


def _packed(rows: DataFrame, tile: int) -> DataFrame:
    """tile, ids, values: groups of about ``tile`` vectors, dealt by the hash of the id."""
    count = rows.count()
    tiles = max(1, -(-count // tile))
    return cut(rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).groupBy("tile").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(
            "tile", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("values")), "tiles")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k of each row, ties to the smaller id; masked scores are NaN-free -inf."""
    if scores.shape[1] > k:
        # every score above the k-th, and of its ties those of the smallest ids
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        wide = int((scores >= kth).sum(axis=1).max())
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[:, order]
        keep = np.argsort(np.where(scores >= kth, 0, 1), axis=1, kind="stable")[:, :wide]
        ids, scores = ids[keep], np.take_along_axis(scores, keep, axis=1)
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _multiply(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = (np.asarray(batch.column(c)[i].values, np.int64) for c in ("q_ids", "ids"))
                q, x = (np.asarray(batch.column(c)[i].values, np.int64) for c in ("q_values", "values"))
                dim = len(x) // len(ids)
                q, x = q.reshape(len(q_ids), dim), x.reshape(len(ids), dim)
                # whole numbers stay exact in doubles below 2^53; beyond, Python's multiply
                bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * dim
                kind = np.float64 if bound < 2**53 else object
                x = x.astype(kind).T
                for a in range(0, len(q_ids), STRIP):
                    own = q_ids[a:a + STRIP]
                    scores = q[a:a + STRIP].astype(kind) @ x
                    if kind is np.float64:
                        scores[own[:, None] == ids] = -np.inf
                    top, value = _best(ids, scores, k) if kind is np.float64 else _best_exact(own, ids, scores, k)
                    real = (value > -np.inf) if kind is np.float64 else np.array([[v is not None for v in r] for r in value]).reshape(value.shape)
                    n = real.sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), batch.column("tile")[i].as_py(), np.int32)), pa.array(own),
                         list_column(pa.array(top[real].astype(np.int64)), n), list_column(pa.array(value[real].astype(np.int64)), n)],
                        names=["tile", "query_id", "ids", "scores"])
    return run


def _best_exact(own: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Top lists of scores beyond 2^53, by whole numbers; short lists end with None."""
    top = np.zeros((len(own), k), np.int64)
    value = np.full((len(own), k), None, object)
    for i, me in enumerate(own):
        order = sorted((j for j in range(len(ids)) if ids[j] != me), key=lambda j: (-scores[i, j], ids[j]))[:k]
        top[i, :len(order)] = ids[order]
        value[i, :len(order)] = [max(1 - 2**63, min(2**63 - 1, scores[i, j])) for j in order]
    return top, value


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query.

    Both inputs have vec_id and ``v``, an array of whole numbers. A query is not its own
    candidate; ties go to the smaller vec_id. Every query tile meets every shard tile in
    one product; partial lists of ``k`` are merged ``FAN_IN`` shards at a time.

    Rows whose vec_id or v is null, or whose v holds null or is of another length than
    most, take no part; of rows with one vec_id the largest vector counts once. With fewer
    candidates than ``k`` all are given; without any, a query has no row. Scores beyond 64
    bits are given as the largest of their sign. Other columns are ignored.
    """
    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v").cast("array<bigint>")
        return df.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
            "vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").groupBy("vec_id").agg(F.max("v").alias("v"))

    rows, asked = sound(vectors), sound(queries)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "tile int, query_id long, ids array<long>, scores array<long>"
    if size is None or size[0] == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, asked = rows.filter(F.size("v") == size[0]), asked.filter(F.size("v") == size[0])
    shards = _packed(rows, tile)
    tiles = _packed(asked, tile).select(F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    count = shards.agg(F.max("tile")).first()[0] + 1
    # every shard asks for all query tiles: tiles are copied, vectors stay where they are
    copies = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    lists = copies.repartition(count, "tile").join(shards.repartition(count, "tile"), "tile").mapInArrow(_multiply(k), schema)

    def merged(rows: DataFrame) -> DataFrame:
        both = F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("i"))
        best = F.slice(F.array_sort(F.flatten(F.collect_list(both))), 1, k)
        return rows.withColumn("tile", (F.col("tile") / FAN_IN).cast("int")).groupBy("tile", "query_id").agg(best.alias("b")).select(
            "tile", "query_id", F.col("b.i").alias("ids"), F.transform("b.s", lambda s: -s).alias("scores"))

    while True:
        lists, count = merged(lists), -(-count // FAN_IN)
        if count == 1:
            break
    out = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.ids").alias("vec_id"), F.col("t.scores").alias("score"))
