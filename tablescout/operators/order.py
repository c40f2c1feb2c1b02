"""Exact positions and quantiles of data that fits no single task.

A plain ``row_number`` over a group sorts the whole group in one task. Here the
rows are cut into key ranges by a distributed sort; only one count per range and
group is summed up in order, and rows are numbered inside their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.session import cut


def ranged(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows with their key range in ``_chunk``, held as a table.

    Held, because the bounds are sampled: every later read must see the same ones. The
    number of ranges is the session's shuffle partitions, less where the data is small.
    """
    return cut(df.repartitionByRange(*keys).withColumn("_chunk", F.spark_partition_id()), "ranged")


def with_running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """Add the running sum (this row included) of each expression, per group in order.

    ``order`` must be total inside a group. Rows per task are bounded by the range size.
    """
    keys = [F.col(g) for g in group]
    parts = ranged(df.withColumns({f"_s_{k}": e for k, e in sums.items()}), [*keys, *order])
    sizes = parts.groupBy(*group, "_chunk").agg(
        *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_chunk").alias("_c"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{k}": F.sum(f"_s_{k}").over(inside) for k in sums})
    same = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offsets, same, "left")
    return out.select(*df.columns, *[
        (F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add the 1-based position of every row in its group."""
    return with_running_sums(df, group, order, {out: F.lit(1).cast("bigint")})


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """First ``k`` rows per group. Each task keeps at most ``k`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def exact_quantiles(
    freq: DataFrame, group: str, value: str, weight: str, probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles from distinct ``(group, value, weight)`` rows.

    Output: ``group, p, q``. Only the ranges that hold a wanted rank are sorted through.
    """
    parts = ranged(freq.select(group, value, weight), [F.col(group), F.col(value)])
    by_group = Window.partitionBy(group)
    sizes = (
        parts.groupBy(group, "_chunk").agg(F.sum(weight).alias("n"))
        .withColumn("total", F.sum("n").over(by_group))
        .withColumn("before", F.sum("n").over(
            by_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    )
    spots = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    wanted = (
        sizes.withColumn("p", spots)
        .withColumn("spot", F.col("p") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array(F.floor("spot"), F.ceil("spot"))))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        .select(group, "_chunk", "p", "spot", "rank", "before")
    )
    inside = Window.partitionBy(group, "_chunk").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0)
    held = (
        parts.join(wanted.select(group, "_chunk").distinct(), [group, "_chunk"], "left_semi")
        .withColumn("upto", F.sum(weight).over(inside))
    )
    rank = F.col("rank") - F.col("before")
    found = held.join(wanted, [group, "_chunk"]).filter(
        (rank >= F.col("upto") - F.col(weight)) & (rank < F.col("upto")))
    low = F.min(value)
    part = F.max(F.col("spot") - F.floor("spot"))
    return found.groupBy(group, "p").agg((low + (F.max(value) - low) * part).alias("q"))
