"""Quality of ranked lists, of integration and of the augmented table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.order import with_position


def relevant() -> Column:
    score = F.coalesce("overall_score", F.lit(0.0)) >= fv.RELEVANT_SCORE
    salient = F.coalesce("matched_salient_columns", F.array().cast("array<string>"))
    return score & (F.size(salient) >= fv.RELEVANT_SALIENT)


def judged(ranked: DataFrame) -> DataFrame:
    """``seed_id, rank, rel, overall_score`` of a ranked list."""
    return ranked.select("seed_id", "rank", relevant().alias("rel"), "overall_score")


def _heads(rows: DataFrame, ks) -> DataFrame:
    """The first rows of each list, once per k they belong to: at most sum(ks) per seed."""
    return rows.filter(F.col("rank") <= max(ks)).withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))


def precision_at_k(rows: DataFrame, ks=fv.K_VALUES) -> DataFrame:
    return _heads(rows, ks).groupBy("seed_id", "k").agg(
        F.round(F.avg(F.col("rel").cast("double")), 4).alias("precision"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean over the relevant rows of (relevant rows so far / rank)."""
    hits = with_position(rows.filter("rel").select("seed_id", "rank"), ["seed_id"],
                         [F.asc("rank")], "hit")
    found = hits.groupBy("seed_id").agg(F.avg(F.col("hit") / F.col("rank")).alias("ap"))
    return rows.select("seed_id").distinct().join(found, "seed_id", "left").select(
        "seed_id", F.round(F.coalesce("ap", F.lit(0.0)), 4).alias("average_precision"))


def mean_average_precision(rows: DataFrame) -> DataFrame:
    return average_precision(rows).agg(F.round(F.avg("average_precision"), 4).alias("map"))


def ndcg_at_k(rows: DataFrame, ks=fv.K_VALUES) -> DataFrame:
    total = rows.groupBy("seed_id").agg(F.count_if("rel").alias("n_rel"))
    gain = F.col("rel").cast("double") / F.log2(F.col("rank") + 1)
    dcg = _heads(rows, ks).groupBy("seed_id", "k").agg(F.sum(gain).alias("dcg"))
    places = F.sequence(F.lit(1), F.greatest(F.least("k", "n_rel"), F.lit(1)).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return dcg.join(total, "seed_id").select("seed_id", "k", F.when(
        F.col("n_rel") > 0, F.round(F.col("dcg") / ideal, 4)).otherwise(0.0).alias("ndcg"))


def score_range(rows: DataFrame) -> DataFrame:
    score = F.coalesce("overall_score", F.lit(0.0))
    return rows.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("total_candidates"), F.count_if("rel").alias("relevant_count"),
        F.round(F.min(score), 4).alias("score_min"), F.round(F.max(score), 4).alias("score_max"),
        F.round(F.avg(score), 4).alias("score_mean"))


def retrieval_metrics(rows: DataFrame, ks=fv.K_VALUES) -> DataFrame:
    """One row per seed with every ranking metric."""
    out = score_range(rows).join(average_precision(rows), "seed_id")
    for table, name in ((precision_at_k(rows, ks), "precision"), (ndcg_at_k(rows, ks), "ndcg")):
        out = out.join(table.groupBy("seed_id").pivot("k", list(ks)).agg(F.first(name)).select(
            "seed_id", *[F.col(str(k)).alias(f"{name}_at_{k}") for k in ks]), "seed_id", "left")
    return out


def integration_rates(statuses: DataFrame) -> DataFrame:
    """``statuses``: seed_id and one status per eligible candidate."""
    def n(status):
        return F.count_if(F.col("status") == status)
    got = statuses.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("candidates_eligible"), n("integrated").alias("candidates_joined"),
        n("skipped").alias("candidates_skipped"), n("no_join_keys").alias("candidates_no_join_keys"),
        n("join_failed").alias("candidates_failed"))
    total = F.col("candidates_eligible")
    downloaded = total - F.col("candidates_skipped")
    return got.withColumn("candidates_downloaded", downloaded).withColumn(
        "join_success_rate", F.round(F.col("candidates_joined") / total, 4)).withColumn(
        "download_success_rate", F.round(downloaded / total, 4))


def skip_breakdown(statuses: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif("skip_reason", F.lit("")), "status", F.lit("unknown"))
    return statuses.groupBy("seed_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def connector_breakdown(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("seed_id", F.coalesce("connector", F.lit("unknown")).alias(
        "connector")).agg(F.count(F.lit(1)).alias("n"))


def augmentation_metrics(cover: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Coverage and completeness gain.

    ``cover``: seed_id, seed_columns, new_columns. ``before`` and ``after``: seed_id and
    one completeness per column.
    """
    def mean(t, name):
        return t.groupBy("seed_id").agg(F.round(F.avg("completeness"), 4).alias(name))
    return (
        cover.join(mean(before, "avg_completeness_before"), "seed_id", "left")
        .join(mean(after, "avg_completeness_after"), "seed_id", "left")
        .withColumn("coverage_gain", F.when(F.col("seed_columns") > 0, F.round(
            F.col("new_columns") / F.col("seed_columns"), 4)).otherwise(0.0))
        .withColumn("completeness_gain", F.round(
            F.coalesce("avg_completeness_after", F.lit(0.0))
            - F.coalesce("avg_completeness_before", F.lit(0.0)), 4))
    )


def findings(metrics: DataFrame) -> DataFrame:
    """Messages from precision_at_10, download and join rate, coverage gain, new_columns, candidates_downloaded."""
    p10, load = F.coalesce("precision_at_10", F.lit(0.0)), F.col("download_success_rate")
    join, cover = F.col("join_success_rate"), F.col("coverage_gain")

    def message(name):
        text = F.lit(fv.MESSAGES[name])
        for slot, value in (
            ("{p10}", p10.cast("string")), ("{download}", F.round(load * 100, 0).cast("int").cast("string")),
            ("{gain}", F.round(cover * 100, 0).cast("int").cast("string")),
            ("{columns}", F.col("new_columns").cast("string")), ("{downloaded}", F.col("candidates_downloaded").cast("string")),
        ):
            if slot in fv.MESSAGES[name]:
                text = F.replace(text, F.lit(slot), value)
        return text

    found = F.array_compact(F.array(
        F.when(p10 >= 0.5, message("retrieval_ok")).otherwise(message("retrieval_low")),
        F.when(load < 0.2, message("download_low")),
        F.when(join == 0, message("join_none")),
        F.when(cover == 0, message("coverage_none")).otherwise(message("coverage"))))
    advice = F.array_compact(F.array(
        F.when(p10 < 0.5, message("advice_retrieval")),
        F.when(load < 0.2, message("advice_download")),
        F.when(join == 0, message("advice_join_1")),
        F.when(join == 0, message("advice_join_2"))))
    return metrics.select("seed_id", found.alias("findings"), advice.alias("recommendations"))
