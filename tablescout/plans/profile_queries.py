"""Registered queries of the column profile."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators import profile as pr
from tablescout.plans.inputs import concepts_sql, table

# Views over the driver's tables: Spark select list (also valid in DuckDB) and kinds.
I64, I32, F64, OBJ, TS = "int64", "int32", "float64", "object", "datetime64[ns]"
VIEWS = {
    "orders": ("orders", {
        "order_id": ("o_orderkey", I64), "cust_id": ("o_custkey", I64),
        "o_orderstatus": ("o_orderstatus", OBJ), "o_totalprice": ("o_totalprice", F64),
        "o_orderdate": ("o_orderdate", TS), "order_year": ("year(o_orderdate)", I32),
        "o_orderpriority": ("o_orderpriority", OBJ)}),
    "events": ("events", {
        "event_id": ("event_id", I64), "ts": ("ts", TS), "user_id": ("user_id", I64),
        "event_type": ("event_type", OBJ), "value": ("value", F64), "props": ("props", OBJ)}),
    "documents": ("documents", {
        "doc_id": ("doc_id", I64), "text": ("text", OBJ), "lang": ("lang", OBJ),
        "source": ("source", OBJ), "n_chars": ("n_chars", I64)}),
    "part": ("part", {
        "p_partkey": ("p_partkey", I64), "p_name": ("p_name", OBJ), "p_brand": ("p_brand", OBJ),
        "p_type": ("p_type", OBJ), "p_size": ("p_size", I32), "p_retailprice": ("p_retailprice", F64)}),
    "lineitem": ("lineitem", {
        "l_orderkey": ("l_orderkey", I64), "l_partkey": ("l_partkey", I64),
        "l_suppkey": ("l_suppkey", I64), "l_linenumber": ("l_linenumber", I32),
        "l_quantity": ("l_quantity", F64), "l_extendedprice": ("l_extendedprice", F64),
        "l_discount": ("l_discount", F64), "l_tax": ("l_tax", F64),
        "volume": ("l_quantity * l_quantity * l_quantity", F64)}),
    "customer": ("customer", {
        "cust_id": ("c_custkey", I64), "c_name": ("c_name", OBJ),
        "nation_code": ("CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END", I32),
        "c_acctbal": ("CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END", F64),
        "c_mktsegment": ("CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END", OBJ)}),
}
KIND = {I64: "int", I32: "int", F64: "float", OBJ: "string", TS: "datetime"}


def view(spark, sf, name):
    source, cols = VIEWS[name]
    return table(spark, sf, source).selectExpr(*[f"{e} AS {c}" for c, (e, _) in cols.items()])


def view_sql(name):
    source, cols = VIEWS[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, (e, _) in cols.items()) + f" FROM {source}"


def stats_sql(name):
    """One row of statistics per column of a view."""
    parts = []
    for i, (c, (_, base)) in enumerate(VIEWS[name][1].items()):
        kind = KIND[base]
        num = kind in ("int", "float")
        length = f"avg(length({c}))" if kind == "string" else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{name}' AS dataset, {i}::INT AS col_pos, '{c}' AS name, '{kind}' AS kind, "
            f"'{base}' AS base, count(*)::BIGINT AS n_rows, count({c})::BIGINT AS non_null, "
            f"count(DISTINCT {c})::BIGINT AS unique_count, {length} AS avg_len, "
            + (f"min({c})::DOUBLE AS num_min, max({c})::DOUBLE AS num_max " if num else
               "NULL::DOUBLE AS num_min, NULL::DOUBLE AS num_max ")
            + f"FROM ({view_sql(name)})")
    return " UNION ALL ".join(parts)


RAW_SQL = "CASE WHEN kind = 'int' AND non_null < n_rows THEN 'float64' ELSE base END"
LADDER_SQL = f"""CASE
  WHEN kind = 'datetime' OR (kind = 'int' AND non_null = n_rows AND regexp_matches(lower(name), '{fv.TIME_PATTERN}')
       AND coalesce(num_min >= 1800 AND num_max <= 2100, true)) THEN 'datetime'
  WHEN kind IN ('int', 'float') THEN 'numeric'
  WHEN regexp_matches(lower(name), '{fv.ID_PATTERN}') THEN 'identifier'
  WHEN unique_count > 0.95::DOUBLE * non_null AND non_null > 5 AND avg_len <= 20 THEN 'identifier'
  WHEN unique_count / non_null > 0.3::DOUBLE AND unique_count / non_null < 0.98::DOUBLE AND avg_len > 3 THEN 'entity'
  WHEN unique_count / non_null <= 0.3::DOUBLE THEN 'categorical'
  WHEN avg_len > 60 THEN 'free_text' ELSE 'categorical' END"""


def typed_sql(names):
    union = " UNION ALL ".join(stats_sql(n) for n in names)
    return f"""stats AS ({union}),
  ladder AS (SELECT *, {RAW_SQL} AS raw_dtype, {LADDER_SQL} AS semantic_type FROM stats),
  typed AS (SELECT *,
    semantic_type = 'identifier' OR regexp_matches(lower(name), '{fv.ID_PATTERN}') AS is_candidate_identifier,
    semantic_type IN ('entity', 'categorical') AND unique_count > 3 AS is_entity_like,
    semantic_type IN ('categorical', 'entity', 'datetime', 'identifier') AS is_useful_for_querying,
    semantic_type = 'identifier' OR regexp_matches(lower(name), '{fv.GEO_PATTERN}')
      OR regexp_matches(lower(name), '{fv.TIME_PATTERN}')
      OR (semantic_type = 'categorical' AND unique_count <= 100) AS is_useful_for_joining
    FROM ladder)"""


POSITION = {"orders": "order_id", "events": "event_id", "documents": "doc_id", "part": "p_partkey"}
TYPED = list(POSITION)


def _typed(spark, sf, names=TYPED):
    def one(n):
        df = view(spark, sf, n)
        return pr.typed_columns(df, pr.frequency_table(df, POSITION[n]), POSITION[n]).select(
            F.lit(n).alias("dataset"), "name", "raw_dtype", "semantic_type", *pr.flags().keys())
    return reduce(lambda a, b: a.unionByName(b), [one(n) for n in names])


def _named(df, stats):
    """Column names in place of positions."""
    return pr.columns_table(df).select("col_pos", "name").join(stats, "col_pos")


def _nulls(spark, sf):
    df = view(spark, sf, "customer")
    return _named(df, pr.null_stats(df))


def _freq(spark, sf, name, pos=None):
    df = view(spark, sf, name)
    return df, pr.frequency_table(df, pos)


QUERIES, ORACLES = {}, {}

QUERIES["prof_nulls"] = lambda s, sf: _nulls(s, sf).select("name", "null_count", "null_ratio")
ORACLES["prof_nulls"] = f"""SELECT name, n_rows - non_null AS null_count,
  round((n_rows - non_null) / n_rows, 4) AS null_ratio FROM ({stats_sql("customer")})"""


def _unique(s, sf):
    df, freq = _freq(s, sf, "orders")
    return _named(df, pr.null_stats(df).join(pr.unique_stats(freq), "col_pos")).select(
        "name", "unique_count", F.round(F.col("unique_count") / F.col("n_rows"), 4).alias("unique_ratio"))


QUERIES["prof_unique"] = _unique
ORACLES["prof_unique"] = f"""SELECT name, unique_count, round(unique_count / n_rows, 4) AS unique_ratio
  FROM ({stats_sql("orders")})"""


def _dtype(s, sf):
    df = view(s, sf, "customer")
    return pr.with_dtype(pr.columns_table(df).join(pr.null_stats(df), "col_pos")).select("name", "raw_dtype")


QUERIES["prof_dtype"] = _dtype
ORACLES["prof_dtype"] = f"""SELECT name, {RAW_SQL} AS raw_dtype FROM ({stats_sql("customer")})"""


def _samples(s, sf):
    df, freq = _freq(s, sf, "part", "p_partkey")
    return _named(df, pr.sample_values(freq)).select(
        "name", F.array_join("sample_values", "|").alias("sample_values"))


QUERIES["prof_samples"] = _samples
ORACLES["prof_samples"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, string_agg(v::VARCHAR, '|' ORDER BY p) AS sample_values FROM
    (SELECT {e} AS v, min(p_partkey) AS p FROM part GROUP BY 1 ORDER BY p LIMIT 5)"""
    for c, (e, _) in VIEWS["part"][1].items())


def _numeric(s, sf):
    df = view(s, sf, "lineitem")
    freq = pr.frequency_table(df)
    return _named(df, pr.wide_stats(df).join(pr.quantiles(freq), "col_pos")).select(
        "name", "num_min", "num_max", F.round("avg", 4).alias("mean"), F.round("sd", 4).alias("std"),
        F.round("median", 4).alias("median"))


QUERIES["prof_numeric"] = _numeric
ORACLES["prof_numeric"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, min({c})::DOUBLE AS num_min, max({c})::DOUBLE AS num_max,
    round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(median({c})::DOUBLE, 4) AS median
    FROM ({view_sql("lineitem")})""" for c in VIEWS["lineitem"][1])


def _date_range(s, sf):
    df = view(s, sf, "orders")
    return _named(df, pr.wide_stats(df)).filter(F.col("name").isin("o_orderdate", "order_year")).select(
        "name", "min", "max")


QUERIES["prof_datetime_range"] = _date_range
ORACLES["prof_datetime_range"] = """SELECT 'o_orderdate' AS name, min(o_orderdate)::DATE::VARCHAR AS min,
  max(o_orderdate)::DATE::VARCHAR AS max FROM orders UNION ALL
  SELECT 'order_year', min(year(o_orderdate))::VARCHAR, max(year(o_orderdate))::VARCHAR FROM orders"""


def _tops(s, sf):
    df, freq = _freq(s, sf, "part")
    return _named(df, pr.top_values(freq)).select("name", "value", "cnt", "rn")


QUERIES["prof_top_values"] = _tops
ORACLES["prof_top_values"] = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS name, ({e})::VARCHAR AS value, count(*)::BIGINT AS cnt,
    row_number() OVER (ORDER BY count(*) DESC, ({e})::VARCHAR)::INT AS rn FROM part GROUP BY {e}) WHERE rn <= 10"""
    for c, (e, _) in VIEWS["part"][1].items())


def _sniff(s, sf):
    df = table(s, sf, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS iso",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS slashed",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS broken",
        "o_orderpriority")
    found = pr.date_sniff(df, "o_orderkey")
    return _named(df, found).select("name", F.col("date_format").isNotNull().alias("is_date"),
                                    F.round("date_rate", 4).alias("date_rate"))


QUERIES["prof_datetime_sniff"] = _sniff
ORACLES["prof_datetime_sniff"] = """WITH first AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20),
  cells AS (
    SELECT 'iso' AS name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM first UNION ALL
    SELECT 'slashed', o_orderkey, strftime(o_orderdate, '%d/%m/%Y') FROM first UNION ALL
    SELECT 'broken', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM first UNION ALL
    SELECT 'o_orderpriority', o_orderkey, o_orderpriority FROM first),
  heads AS (SELECT name, arg_min(v, o_orderkey) AS head FROM cells GROUP BY 1),
  chosen AS (SELECT name, CASE WHEN try_strptime(head, '%Y-%m-%d') IS NOT NULL THEN 1
    WHEN try_strptime(head, '%m/%d/%Y') IS NOT NULL THEN 2
    WHEN try_strptime(head, '%d/%m/%Y') IS NOT NULL THEN 3 ELSE 0 END AS fmt FROM heads),
  rates AS (SELECT name, avg(CASE WHEN (fmt = 1 AND try_strptime(v, '%Y-%m-%d') IS NOT NULL)
      OR (fmt = 2 AND try_strptime(v, '%m/%d/%Y') IS NOT NULL)
      OR (fmt = 3 AND try_strptime(v, '%d/%m/%Y') IS NOT NULL) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate
    FROM cells JOIN chosen USING (name) GROUP BY 1)
  SELECT name, rate > 0.8::DOUBLE AS is_date, round(rate, 4) AS date_rate FROM rates"""

QUERIES["prof_semantic_type"] = lambda s, sf: _typed(s, sf).select(
    "dataset", "name", "raw_dtype", "semantic_type")
ORACLES["prof_semantic_type"] = f"""WITH {typed_sql(TYPED)}
  SELECT dataset, name, raw_dtype, semantic_type FROM typed"""
QUERIES["prof_flags"] = lambda s, sf: _typed(s, sf).select("dataset", "name", *pr.flags().keys())
ORACLES["prof_flags"] = f"""WITH {typed_sql(TYPED)} SELECT dataset, name, is_candidate_identifier,
  is_entity_like, is_useful_for_querying, is_useful_for_joining FROM typed"""

_KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _composite(s, sf):
    # The first line of each order and line number, so that this pair is a key.
    first = table(s, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"),
        F.min("l_shipdate").alias("l_shipdate"))
    return pr.composite_keys(first, _KEY_COLS)


QUERIES["prof_composite_keys"] = _composite
ORACLES["prof_composite_keys"] = f"""WITH first AS MATERIALIZED (SELECT l_orderkey, l_linenumber,
  min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2)
  SELECT * FROM ({" UNION ALL ".join(
      f'''SELECT {i}::INT AS pair_pos, '{a}' AS col_a, '{b}' AS col_b WHERE NOT EXISTS
      (SELECT 1 FROM first WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b} HAVING count(*) > 1)'''
      for i, (a, b) in enumerate(combinations(_KEY_COLS, 2)))}) ORDER BY pair_pos LIMIT 5"""

# Every document is a dataset whose words are its column names.
QUERIES["prof_concepts"] = lambda s, sf: table(s, sf, "documents").select(
    "doc_id", F.array_join(pr.concepts(F.col("text")), "|").alias("concepts"))
ORACLES["prof_concepts"] = f"""SELECT doc_id, coalesce(list_aggregate({concepts_sql("text")}, 'string_agg', '|'), '')
  AS concepts FROM documents"""

_DUP = "user_id, event_type, floor(value / 10) AS level"
QUERIES["prof_duplicates"] = lambda s, sf: pr.duplicate_rows(
    table(s, sf, "events").selectExpr("user_id", "event_type", "floor(value / 10) AS level"))
ORACLES["prof_duplicates"] = f"""SELECT sum(n - 1)::BIGINT AS duplicate_row_count FROM
  (SELECT count(*) AS n FROM (SELECT {_DUP} FROM events) GROUP BY user_id, event_type, level)"""

QUERIES["prof_high_missing"] = lambda s, sf: _nulls(s, sf).filter("null_share > 0.2").select("name")
ORACLES["prof_high_missing"] = f"""SELECT name FROM ({stats_sql("customer")})
  WHERE (n_rows - non_null) / n_rows > 0.2::DOUBLE"""


def _sketches(s, sf):
    """Estimates from sketches of four parts of the lines, merged, beside the exact values."""
    df = view(s, sf, "lineitem")
    parts = reduce(lambda a, b: a.unionByName(b), [pr.sketches(df.filter(F.pmod("l_orderkey", F.lit(4)) == i)) for i in range(4)])
    near = pr.estimates(pr.merged(parts))
    freq = pr.frequency_table(df)
    exact = pr.unique_stats(freq).join(pr.quantiles(freq).withColumnsRenamed({"q1": "exact_q1", "median": "exact_median", "q3": "exact_q3"}), "col_pos")
    return _named(df, near.join(exact, "col_pos")).select(
        "name", "unique_count", "unique_estimate", "exact_q1", "q1", "exact_median", "median", "exact_q3", "q3", F.round("outlier_share", 4).alias("outlier_share"))


QUERIES["prof_sketches"] = _sketches  # estimates: tests hold their errors against exact values


def _outliers(s, sf):
    def one(n):
        df, freq = _freq(s, sf, n)
        return _named(df, pr.outliers(freq, pr.quantiles(freq))).select(
            F.lit(n).alias("dataset"), "name", "outlier_count")
    return one("lineitem").unionByName(one("events"))


def _outlier_sql(n, c):
    return f"""SELECT '{n}' AS dataset, '{c}' AS name, count(*)::BIGINT AS outlier_count FROM ({view_sql(n)}),
    (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM ({view_sql(n)}))
    WHERE {c} < q1 - (q3 - q1) * 1.5::DOUBLE OR {c} > q3 + (q3 - q1) * 1.5::DOUBLE HAVING count(*) > 0"""


QUERIES["prof_outliers"] = _outliers
ORACLES["prof_outliers"] = " UNION ALL ".join(
    _outlier_sql(n, c) for n in ("lineitem", "events")
    for c, (_, base) in VIEWS[n][1].items() if KIND[base] in ("int", "float"))


def _lists(s, sf):
    def one(n):
        df = view(s, sf, n)
        one_row = pr.signature_lists(pr.profile_columns(df, POSITION[n]))
        samples = F.transform(F.map_entries("entity_value_samples"),
                              lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
        return one_row.select(F.lit(n).alias("dataset"), *[
            F.array_join(c, "|").alias(c) for c in (
                "candidate_identifiers", "entity_like_columns", "important_attributes",
                "salient_column_names")], F.array_join(samples, "|").alias("entity_value_samples"))
    return one("part").unionByName(one("events"))


def _sample_sql(n):
    pos = POSITION[n]
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS dataset, '{c}' AS name, '{c}=' || string_agg(v, ',' ORDER BY p) AS vals FROM
        (SELECT {c} AS v, min({pos}) AS p FROM ({view_sql(n)}) GROUP BY 1 ORDER BY p LIMIT 5)"""
        for c, (_, base) in VIEWS[n][1].items() if base == OBJ)


def _agg(cond):
    return f"coalesce(string_agg(name, '|' ORDER BY col_pos) FILTER ({cond}), '')"


QUERIES["prof_signature_lists"] = _lists
ORACLES["prof_signature_lists"] = f"""WITH {typed_sql(["part", "events"])},
  samples AS ({_sample_sql("part")} UNION ALL {_sample_sql("events")})
  SELECT dataset, {_agg("is_candidate_identifier")} AS candidate_identifiers,
    {_agg("is_entity_like")} AS entity_like_columns,
    {_agg("semantic_type = 'numeric' AND round(unique_count / n_rows, 4) > 0.5::DOUBLE")} AS important_attributes,
    {_agg("is_useful_for_querying OR is_useful_for_joining")} AS salient_column_names,
    coalesce(string_agg(vals, '|' ORDER BY col_pos) FILTER (is_entity_like), '') AS entity_value_samples
  FROM typed LEFT JOIN samples USING (dataset, name) GROUP BY dataset"""


def _preview(s, sf):
    df, freq = _freq(s, sf, "customer")
    stats = pr.null_stats(df).join(pr.unique_stats(freq), "col_pos")
    return pr.with_dtype(pr.columns_table(df).join(stats, "col_pos")).select(
        "name", "raw_dtype", "null_count", F.round(F.col("null_share") * 100, 2).alias("null_pct"),
        "unique_count")


QUERIES["prof_preview"] = _preview
ORACLES["prof_preview"] = f"""SELECT name, {RAW_SQL} AS raw_dtype, n_rows - non_null AS null_count,
  round((n_rows - non_null) / n_rows * 100, 2) AS null_pct, unique_count FROM ({stats_sql("customer")})"""
