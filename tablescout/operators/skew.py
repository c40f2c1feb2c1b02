"""Joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column,
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``big`` with ``small`` so that one key's rows of ``big`` go to many tasks.

    ``spread`` is hashed into the salt, so it must vary within a key. Every row of
    ``small`` is repeated once per salt; ``how`` may be inner, left or left_semi.

    Both sides are shuffled. Spark judges ``small`` by the files it comes from, before rows are
    exploded and repeated, and would send far more than its limit through the driver.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")
