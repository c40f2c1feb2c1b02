"""Inputs of the registered queries, derived from the driver's tables.

Each helper has an SQL twin under the same name, a WITH part for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.profile import concepts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lits(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def values(rows) -> str:
    def one(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


# Column names that seeds draw from, one per order of a customer.
COLUMN_NAMES = [
    "country_code", "country_name", "year", "gdp_usd", "gdp_growth_pct", "population",
    "life_expectancy", "infant_mortality_rate", "literacy_rate_pct", "urban_pop_pct",
    "co2_emissions_kt", "region", "income_group", "currency_code", "product_sku",
    "company_sector", "hospital_beds", "event_id", "notes",
]


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed per customer: every order adds a column name and a sample value."""
    name = F.element_at(F.array(*[F.lit(c) for c in COLUMN_NAMES]),
                        (F.col("o_orderkey") % len(COLUMN_NAMES) + 1).cast("int"))
    cells = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("seed_id"), name.alias("name"),
        F.col("o_orderpriority").alias("value")).agg(F.min("o_orderkey").alias("p"))
    cols = cells.groupBy("seed_id", "name").agg(
        F.min("p").alias("first_pos"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))),
                            lambda s: s["value"]), 1, 5).alias("values"))
    rows = cols.groupBy("seed_id").agg(
        F.array_sort(F.collect_list(F.struct("first_pos", "name", "values"))).alias("c"))
    names = F.transform("c", lambda s: s["name"])
    entity = F.filter("c", lambda s: s["name"].isin("country_name", "region"))
    return rows.select(
        "seed_id", names.alias("columns"),
        concepts(F.array_join(names, " ")).alias("concepts"),
        F.filter(names, lambda n: n.rlike(fv.ID_PATTERN)).alias("identifiers"),
        F.map_from_entries(F.transform(entity, lambda s: F.struct(s["name"], s["values"]))).alias(
            "samples"))


def concepts_sql(text: str) -> str:
    hits = ", ".join(
        f"CASE WHEN regexp_matches(lower({text}), '{p}') THEN '{c}' END"
        for c, p in sorted(fv.CONCEPT_PATTERNS.items()))
    return f"list_filter([{hits}], lambda c: c IS NOT NULL)"


SIGNATURES_SQL = f"""
cells AS (
  SELECT o_custkey AS seed_id,
         list_extract({lits(COLUMN_NAMES)}, (o_orderkey % {len(COLUMN_NAMES)} + 1)::INT) AS name,
         o_orderpriority AS value, min(o_orderkey) AS p
  FROM orders GROUP BY 1, 2, 3),
cols AS (
  SELECT seed_id, name, min(p) AS first_pos, list(value ORDER BY p)[1:5] AS vals
  FROM cells GROUP BY 1, 2),
seeds AS (
  SELECT seed_id, list(name ORDER BY first_pos) AS columns,
         max(vals) FILTER (name = 'country_name') AS country_names,
         max(vals) FILTER (name = 'region') AS regions
  FROM cols GROUP BY 1),
sig AS (
  SELECT *, {concepts_sql("list_aggregate(columns, 'string_agg', ' ')")} AS concepts,
         list_filter(columns, lambda n: regexp_matches(n, '{fv.ID_PATTERN}')) AS identifiers
  FROM seeds)
"""
