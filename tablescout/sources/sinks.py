"""Outputs of the steps. Documents stay tables; only a signature is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_signature(signature: DataFrame, path: str) -> None:
    signature.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """JSON lines, compressed: queries of a seed differ by a few words, so their files shrink to a fraction.

    At the fastest level: the files are a third larger than at the usual one, whose search took more time than the JSON.
    """
    queries.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")


def write_discovery(results: DataFrame, errors: DataFrame, header: DataFrame, path: str) -> None:
    for name, part in (("results", results), ("errors", errors), ("header", header)):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Row order is no property of a table, so ``rank`` must be a column."""
    if "rank" not in ranked.columns:
        raise ValueError("ranked rows need a rank column")
    ranked.write.mode("overwrite").parquet(path)


def write_augmented(augmented: DataFrame, path: str) -> None:
    """CSV, Parquet or JSON records, by the suffix of the path."""
    out = augmented.write.mode("overwrite")
    if path.endswith(".csv"):
        out.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        out.parquet(path)
    else:
        out.option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def queries_header(queries: DataFrame) -> DataFrame:
    """Totals of the query documents, one row per seed; the queries stay rows."""
    def listed(c: str) -> Column:
        return F.array_sort(F.collect_set(c))
    return queries.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("total_queries"), listed("concept").alias("concepts"),
        listed("identifier").alias("identifiers"), listed("target_connector").alias("target_connectors"))
