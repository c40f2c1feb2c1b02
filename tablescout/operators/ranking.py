"""Filter and rank scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.order import with_position

SCORES = ["overall_score", "relevance_score", "joinability_score", "metadata_completeness_score"]


def removed() -> Column:
    """Top-priority rows that are already relevant and well described."""
    return F.coalesce(
        F.col("priority").isin(fv.REMOVE_PRIORITIES)
        & (F.coalesce("relevance_score", F.lit(0.0)) >= fv.REMOVE_SCORE)
        & (F.coalesce("metadata_completeness_score", F.lit(0.0)) >= fv.REMOVE_SCORE), F.lit(False))


def keep(rows: DataFrame, remove: Column | None = None) -> DataFrame:
    return rows.filter(~(removed() if remove is None else remove))


def rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rank per seed by the four scores, ties in the order of the ``order`` columns."""
    by = [F.desc(f"_{c}") for c in SCORES] + [F.asc(c) for c in order]
    filled = rows.withColumns({f"_{c}": F.coalesce(c, F.lit(0.0)) for c in SCORES})
    return with_position(filled, ["seed_id"], by, "rank").drop(*[f"_{c}" for c in SCORES])


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seed_id").agg(
        F.count_if(~removed()).alias("filtered_candidates"),
        F.count_if(removed()).alias("removed_candidates"))
