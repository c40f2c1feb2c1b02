"""Execution of the integration: one left join per surviving candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.entities import resolve
from tablescout.operators.matching import domain_text
from tablescout.operators.profile import kind_of
from tablescout.session import cut


@dataclass
class JoinPlan:
    """What to do with one candidate: (candidate column, seed column) keys and new columns."""

    dataset_id: str
    keys: list[tuple[str, str]]
    new_columns: list[str]
    landing_page: str | None = None
    null_keys: str = "match"
    threshold: float = fv.MATCH_THRESHOLD
    # Column with the seed's row order; equal fuzzy scores go to the earliest seed value.
    seed_order: str | None = None


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def is_number(df: DataFrame, name: str) -> bool:
    return kind_of(df.schema[name].dataType) in ("int", "float", "bool")


def entity_map(seed: DataFrame, cand: DataFrame, plan: JoinPlan,
               pairs: list[tuple[str, str]]) -> DataFrame:
    """``domain`` (the candidate column), candidate normal form, seed normal form.

    Without an order column equal scores go to the first seed value by text.
    """
    pos = _col(plan.seed_order).cast("bigint") if plan.seed_order else F.lit(0).cast("bigint")
    cells = [F.struct(F.lit(c).alias("domain"), domain_text(_col(s)).alias("norm")) for c, s in pairs]
    seeds = seed.select(pos.alias("pos"), F.explode(F.array(*cells)).alias("v")).select("v.*", "pos")
    cells = [F.struct(F.lit(c).alias("domain"), domain_text(_col(c)).alias("norm")) for c, _ in pairs]
    return resolve(seeds, cand.select(F.explode(F.array(*cells)).alias("v")).select("v.*"), plan.threshold)


def key_type(seed: DataFrame, cand: DataFrame, c: str, s: str) -> str:
    """Whole numbers compare as such, other numeric seed keys as doubles."""
    if not is_number(seed, s):
        return "text"
    whole = all(kind_of(d.schema[n].dataType) == "int" for d, n in ((seed, s), (cand, c)))
    return "bigint" if whole else "double"


def with_keys(seed: DataFrame, cand: DataFrame, plan: JoinPlan) -> tuple[DataFrame, DataFrame]:
    """Both sides with their harmonised keys ``_l0.._ln`` and ``_r0.._rn``, in the normal form that the overlap was checked in."""
    texts = [(c, s) for c, s in plan.keys if not is_number(seed, s)]
    mapped = cut(entity_map(seed, cand, plan, texts), "entity-map") if texts else None
    left, right = seed, cand
    for i, (c, s) in enumerate(plan.keys):
        kind = key_type(seed, cand, c, s)
        if kind != "text":
            left = left.withColumn(f"_l{i}", _col(s).cast(kind))
            truth = kind_of(cand.schema[c].dataType) == "bool"  # a truth value is a number, its text is none
            right = right.withColumn(f"_r{i}", _col(c).cast(kind) if truth else _col(c).cast("string").try_cast(kind))
            continue
        left = left.withColumn(f"_l{i}", F.when(_col(s).isNotNull(), domain_text(_col(s))))
        names = mapped.filter(F.col("domain") == c).select(
            F.col("norm").alias("_norm"), F.col("seed_norm").alias("_seed"))
        own = F.when(_col(c).isNotNull(), domain_text(_col(c)))
        right = right.withColumn("_norm", own).join(names, "_norm", "left").withColumn(
            f"_r{i}", F.coalesce("_seed", "_norm")).drop("_norm", "_seed")
    return left, right


def left_join(left: DataFrame, right: DataFrame, n_keys: int, null_keys: str = "match") -> DataFrame:
    """Left join on ``_l*`` and ``_r*``; null keys meet null keys unless skipped."""
    same = F.lit(True)
    for i in range(n_keys):
        a, b = F.col(f"_l{i}"), F.col(f"_r{i}")
        same = same & (a.eqNullSafe(b) if null_keys == "match" else a == b)
    return left.join(right, same, "left")


def join_candidate(seed: DataFrame, cand: DataFrame, plan: JoinPlan) -> DataFrame:
    """The seed with the candidate's new columns and a ``__source`` column for each."""
    if not plan.keys or not plan.new_columns:
        return seed
    left, right = with_keys(seed, cand, plan)
    n = len(plan.keys)
    right = right.select(*[f"_r{i}" for i in range(n)], *[_col(c) for c in plan.new_columns])
    joined = left_join(left, right, n, plan.null_keys)
    return joined.select(
        *[_col(c) for c in seed.columns],
        *[x for c in plan.new_columns for x in (
            _col(c), F.when(_col(c).isNotNull(), F.lit(plan.landing_page)).alias(f"{c}__source"))])


def augment(seed: DataFrame, cands: dict[str, DataFrame], plans: list[JoinPlan],
            cut_every: int = 8) -> DataFrame:
    """Apply the plans in order. The loop runs over plans, never over rows."""
    out = seed
    for i, plan in enumerate(plans, start=1):
        out = join_candidate(out, cands[plan.dataset_id], plan)
        if i % cut_every == 0 and i < len(plans):
            out = cut(out, "augmented")
    return out


def rows_matched(joined: DataFrame, first_new: str) -> DataFrame:
    return joined.agg(F.count(_col(first_new)).alias("rows_matched"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null share per column, one scan."""
    one = df.agg(*[F.avg(_col(c).isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"c{i}").alias("completeness"))
        for i, c in enumerate(columns)])).alias("s")).select("s.*")


def coverage(seed_columns: list[str], augmented_columns: list[str]) -> dict[str, list[str]]:
    """Added and provenance columns, from the two schemas."""
    old = set(seed_columns)
    return {
        "added": [c for c in augmented_columns if c not in old and not c.endswith("__source")],
        "provenance": [c for c in augmented_columns if c.endswith("__source")],
    }
