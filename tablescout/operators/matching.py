"""Planning of the integration: columns, keys, overlaps, ownership of new columns.

All tables here hold names or distinct values, for many candidates at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions.similarity import best_names
from tablescout.functions.text import norm_col, norm_value, number_text
from tablescout.operators.order import top_k
from tablescout.session import cut


def url_extension(url: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def is_api_url(url: Column) -> Column:
    has_query = F.regexp_replace(url, "#.*$", "").rlike(r"\?.")
    words = [F.contains(F.lower(url), F.lit(w)) for w in fv.API_WORDS]
    hit = has_query
    for w in words:
        hit = hit | w
    return hit


def url_skip_reason(url: Column) -> Column:
    """Why a URL is not fetched; null when it is."""
    ext = url_extension(url)
    table_like = ext.isin(fv.TABULAR_EXT + fv.ARCHIVE_EXT)
    return F.when(ext.isin(fv.SKIP_EXT), F.concat(F.lit("skipped non-tabular extension: "), ext)).when(
        is_api_url(url) & ~table_like, F.lit("skipped API/service URL"))


def content_skip_reason(content_type: Column, length: Column, max_bytes: int | None = fv.MAX_FILE_BYTES) -> Column:
    """Why a fetched file is not read; without ``max_bytes`` its length is no reason."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    reason = F.when(kind.rlike("|".join(fv.SKIP_CONTENT_WORDS)), F.concat(F.lit("skipped content-type: "), kind))
    if max_bytes is None:
        return reason
    return reason.when(length > max_bytes, F.lit(f"skipped: file exceeds {max_bytes // (1024 * 1024)} MB"))


def eligible(ranked: DataFrame, threshold: float = fv.SCORE_THRESHOLD, k: int = fv.TOP_K) -> DataFrame:
    """The candidates to attempt, in rank order, numbered from 1."""
    ok = ranked.filter(F.coalesce("overall_score", F.lit(0.0)) >= threshold)
    return top_k(ok, ["seed_id"], [F.asc("rank")], k, "index")


def match_columns(seed_cols: DataFrame, cand_cols: DataFrame,
                  threshold: float = fv.MATCH_THRESHOLD) -> DataFrame:
    """Candidate columns mapped to seed columns.

    ``seed_cols``: seed_id, columns (array in order). ``cand_cols``: seed_id, dataset_id,
    col, cand_pos. A name pair is scored once per seed, however many candidates use it;
    the seed's names travel as one array, so no pair becomes a row.
    """
    names = cand_cols.select("seed_id", norm_col(F.col("col")).alias("norm")).distinct()

    @F.pandas_udf("at int, score double")
    def best(name: pd.Series, options: pd.Series) -> pd.DataFrame:
        return best_names(name, options, threshold)

    scored = names.join(seed_cols, "seed_id").withColumn(
        "best", best("norm", F.transform("columns", norm_col)))
    chosen = scored.filter("best.at is not null").select(
        "seed_id", "norm", F.get("columns", F.col("best.at")).alias("seed_col"),
        F.col("best.score").alias("score"))
    claims = cand_cols.withColumn("norm", norm_col(F.col("col"))).join(chosen, ["seed_id", "norm"])
    return top_k(claims, ["seed_id", "dataset_id", "seed_col"], [F.asc("cand_pos")], 1, "_rn").select(
        "seed_id", "dataset_id", "col", "cand_pos", "seed_col", "score")


def priority_keys(identifiers: Column, datetimes: Column, entities: Column) -> Column:
    return F.array_distinct(F.concat(identifiers, datetimes, entities))


def domain_text(value: Column) -> Column:
    """Normal form in which values of both sides are compared."""
    return norm_value(number_text(value))


def numeric_overlap(pairs: DataFrame) -> DataFrame:
    """``pairs``: seed_min, seed_max, cand_min, cand_max. Empty ranges count as overlapping."""
    apart = (F.col("cand_max") < F.col("seed_min")) | (F.col("cand_min") > F.col("seed_max"))
    return pairs.withColumn("overlap", F.when(apart, 0.0).otherwise(1.0))


def value_overlap(pairs: DataFrame, seed_values: DataFrame, cand_values: DataFrame) -> DataFrame:
    """Share of a candidate column's distinct raw values known to the seed column.

    ``pairs``: seed_id, dataset_id, col, seed_col. ``seed_values``: seed_id, seed_col, value.
    ``cand_values``: dataset_id, col, value. Both sides shrink to distinct values first,
    so no key of the join is heavier than the number of datasets that use the value.
    """
    known = seed_values.filter("value is not null").select(
        "seed_id", "seed_col", domain_text(F.col("value")).alias("norm")).distinct()
    asked = (
        cand_values.filter("value is not null").select("dataset_id", "col", "value").distinct()
        .join(pairs, ["dataset_id", "col"])
        .select("seed_id", "dataset_id", "col", "seed_col", domain_text(F.col("value")).alias("norm"))
        .groupBy("seed_id", "dataset_id", "col", "seed_col", "norm").agg(F.count(F.lit(1)).alias("n"))
    )
    marked = asked.join(known.withColumn("known", F.lit(True)), ["seed_id", "seed_col", "norm"], "left")
    shares = marked.groupBy("seed_id", "dataset_id", "col", "seed_col").agg(
        (F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return pairs.join(shares, ["seed_id", "dataset_id", "col", "seed_col"], "left").withColumn(
        "overlap", F.round(F.coalesce("share", F.lit(0.0)), 4)).drop("share")


def join_keys(overlaps: DataFrame, minimum: float = fv.MIN_VALUE_OVERLAP) -> DataFrame:
    """Pairs with their verdict; an unchecked pair (null overlap) is kept."""
    ok = F.coalesce(F.col("overlap") >= minimum, F.lit(True))
    return overlaps.withColumn("is_key", ok).withColumn(
        "reason", F.when(~ok, F.lit("value overlap too small")))


def new_attributes(cand_cols: DataFrame, keys: DataFrame, mapping: DataFrame,
                   seed_cols: DataFrame) -> DataFrame:
    """Candidate columns that are no key, not mapped and not named like a seed column."""
    used = keys.select("seed_id", "dataset_id", "col").unionByName(
        mapping.select("seed_id", "dataset_id", "col")).distinct()
    taken = seed_cols.select("seed_id", F.explode("columns").alias("c")).select(
        "seed_id", norm_col(F.col("c")).alias("norm")).distinct()
    return (
        cand_cols.withColumn("norm", norm_col(F.col("col")))
        .join(used, ["seed_id", "dataset_id", "col"], "left_anti")
        .join(taken, ["seed_id", "norm"], "left_anti")
    )


def first_owner(attributes: DataFrame) -> DataFrame:
    """Columns that survive when candidates are applied in rank order.

    ``attributes``: seed_id, dataset_id, rank, col, cand_pos, norm. An earlier candidate owns
    the normal name of its columns and of their ``__source`` columns.

    Of a name the smallest rank survives, unless an earlier survivor's ``__source`` column has
    that name. The latter's name is the former's without its last word, so names are settled
    by their number of such words, a join per number, and no seed's columns meet in one row.
    The attributes are held as a table, as they are read for the names and for the result.
    """
    attributes = cut(attributes, "attributes")
    tail = F.regexp_extract(F.concat(F.lit(" "), F.col("norm")), r"((?: source)+)$", 1)
    names = attributes.groupBy("seed_id", "norm").agg(F.min("rank").alias("rank")).withColumn(
        "depth", (F.length(tail) / len(" source")).cast("int")).withColumn(
        "owner", F.trim(F.regexp_replace(F.concat(F.lit(" "), F.col("norm")), " source$", "")))
    names = cut(names, "names")
    deepest = names.agg(F.max("depth")).first()[0] or 0
    kept = names.filter("depth = 0").select("seed_id", "norm", "rank")
    level = kept
    for depth in range(1, deepest + 1):
        owners = level.select("seed_id", F.col("norm").alias("owner"), F.col("rank").alias("owner_rank"))
        level = names.filter(F.col("depth") == depth).join(owners, ["seed_id", "owner"], "left").filter(
            F.col("owner_rank").isNull() | (F.col("rank") <= F.col("owner_rank"))).select("seed_id", "norm", "rank")
        kept = kept.unionByName(level)
    return attributes.join(kept, ["seed_id", "norm", "rank"]).select("seed_id", "rank", "dataset_id", "cand_pos", "col", "norm")


def statuses(cands: DataFrame, keys: DataFrame, owned: DataFrame) -> DataFrame:
    """Outcome per attempted candidate.

    ``cands``: seed_id, dataset_id, n_urls, usable_url (null when no file parsed).
    """
    has_key = keys.filter("is_key").select("seed_id", "dataset_id").distinct().withColumn(
        "has_key", F.lit(True))
    has_new = owned.groupBy("seed_id", "dataset_id").agg(F.count(F.lit(1)).alias("n_new"))
    rows = cands.join(has_key, ["seed_id", "dataset_id"], "left").join(
        has_new, ["seed_id", "dataset_id"], "left")
    no_url, no_file = F.col("n_urls") == 0, F.col("usable_url").isNull()
    no_key, no_new = F.col("has_key").isNull(), F.col("n_new").isNull()
    return rows.withColumn(
        "status", F.when(no_url | no_file, "skipped").when(no_key, "no_join_keys")
        .when(no_new, "join_failed").otherwise("integrated")).withColumn(
        "skip_reason", F.when(no_url, "no download URLs")
        .when(no_file, "no downloadable tabular file found").when(no_key, "no join keys matched")
        .when(no_new, "no new attributes to add").otherwise("")).drop("has_key", "n_new")


def status_counts(rows: DataFrame) -> DataFrame:
    def n(status):
        return F.count_if(F.col("status") == status)
    return rows.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("candidates_eligible"), n("integrated").alias("candidates_integrated"),
        n("skipped").alias("candidates_skipped"), n("no_join_keys").alias("candidates_no_join"),
        n("join_failed").alias("candidates_failed"))


REPORTED = ["index", "dataset_id", "title", "connector", "source_name", "landing_page", "overall_score", "download_urls", "attempted_urls",
            "usable_url", "status", "skip_reason"]


def report(rows: DataFrame) -> DataFrame:
    """One report row per seed with its candidates in order, at most those attempted, and all that is known of each."""
    known = [c for c in REPORTED if c in rows.columns]
    items = F.array_sort(F.collect_list(F.struct(*known)))
    return status_counts(rows).join(rows.groupBy("seed_id").agg(items.alias("candidates")), "seed_id")


def conflicts(cells: DataFrame) -> DataFrame:
    """Contradicting values of one attribute from different sources.

    ``cells``: seed_key, attribute (normal name), source, value. Counts shrink map-side on
    (key, attribute, value) before anything is grouped by key.
    """
    values = cells.filter("value is not null").groupBy(
        "seed_key", "attribute", domain_text(F.col("value")).alias("norm")).agg(
        F.min("source").alias("s0"), F.max("source").alias("s1"))
    return values.groupBy("seed_key", "attribute").agg(
        F.count(F.lit(1)).alias("n_values"), F.min("s0").alias("s0"), F.max("s1").alias("s1")
    ).filter("s0 <> s1").select("seed_key", "attribute", "n_values", (F.col("n_values") > 1).alias(
        "is_conflict"))


def conflict_rate(found: DataFrame) -> DataFrame:
    return found.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if("is_conflict").alias("conflicting"),
        F.round(F.avg(F.col("is_conflict").cast("double")), 4).alias("conflict_rate"))
