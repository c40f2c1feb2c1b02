"""Column profiles and the seed signature.

Everything that needs distinct values reads one frequency table
``(col_pos, value, num, cnt, first_pos)``: one shuffle on (column, value) with
map-side counts, so a column of few values costs little and no column sits in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import fixed_values as fv
from tablescout.functions.text import let
from tablescout.operators.order import exact_quantiles, top_k
from tablescout.session import cut

# Date texts that count as dates: (shape, format). The first value picks the format.
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
    (r"^\d{2}:\d{2}$", "HH:mm"),
    (r"^\d{2}:\d{2}:\d{2}$", "HH:mm:ss"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]


# A row position added for the profile alone; it is no data column.
POS = "_pos"


def fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if f.name != POS]


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "string"


def base_dtype(dtype: T.DataType) -> str:
    names = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
             "double": "float64", "float": "float32", "boolean": "bool"}
    if kind_of(dtype) == "datetime":
        return "datetime64[ns]"
    return names.get(dtype.simpleString(), "float64" if kind_of(dtype) == "float" else "object")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def columns_table(df: DataFrame) -> DataFrame:
    """One row per column, from the schema."""
    rows = [(i, f.name, kind_of(f.dataType), base_dtype(f.dataType))
            for i, f in enumerate(fields(df))]
    return df.sparkSession.createDataFrame(
        rows, "col_pos int, name string, kind string, base_dtype string")


def _typed_cells(df: DataFrame, pos: str | None) -> DataFrame:
    """Non-null cells as ``(pos, col_pos, text, whole, frac)``: a number is no text, so it travels as eight bytes."""
    items = []
    for i, f in enumerate(fields(df)):
        c, kind = clean(df, f.name), kind_of(f.dataType)
        decimal = isinstance(f.dataType, T.DecimalType)
        number = {"whole": kind == "int", "frac": kind == "float" and not decimal}
        text = F.lit(None) if any(number.values()) else F.to_json(c) if kind == "nested" else c
        items.append(F.struct(
            F.lit(i).alias("col_pos"), text.cast("string").alias("text"),
            (c if number["whole"] else F.lit(None)).cast("bigint").alias("whole"),
            (c if number["frac"] else c if decimal else F.lit(None)).cast("double").alias("frac")))
    where = F.col(f"`{pos}`").cast("bigint") if pos else F.lit(None).cast("bigint")
    return (
        df.select(where.alias("pos"), F.explode(F.array(*items)).alias("c")).select("pos", "c.*")
        .filter(F.coalesce("text", F.col("whole").cast("string"), F.col("frac").cast("string")).isNotNull())
    )


def _as_values(df: DataFrame, single: list[int]) -> DataFrame:
    """Typed cells with ``value`` as text and ``num`` as a number; ``single``: columns of single precision."""
    frac = F.when(F.col("col_pos").isin(single), F.col("frac").cast("float").cast("string")).otherwise(F.col("frac").cast("string"))
    return df.withColumn("value", F.coalesce("text", F.col("whole").cast("string"), frac)).withColumn(
        "num", F.coalesce(F.col("frac"), F.col("whole").cast("double"))).drop("text", "whole", "frac")


def _singles(df: DataFrame) -> list[int]:
    return [i for i, f in enumerate(fields(df)) if isinstance(f.dataType, T.FloatType)]


def cells(df: DataFrame, pos: str | None = None) -> DataFrame:
    """Non-null cells as ``(pos, col_pos, value, num)``."""
    return _as_values(_typed_cells(df, pos), _singles(df)).select("pos", "col_pos", "value", "num")


def frequency_table(df: DataFrame, pos: str | None = None) -> DataFrame:
    """Distinct values per column with their count and first place. Numbers are grouped and shuffled as numbers."""
    counted = _typed_cells(df, pos).groupBy("col_pos", "text", "whole", "frac").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    return _as_values(counted, _singles(df)).select("col_pos", "value", "num", "cnt", "first_pos")


def sketches(df: DataFrame, lg_k: int = 14, k: int = 800) -> DataFrame:
    """col_pos, distinct_sketch, number_sketch: mergeable sketches of every column, from one scan and without a shuffle of values.

    ``distinct_sketch`` is a HyperLogLog of 2^``lg_k`` registers (standard error 1.04 / 2^(lg_k / 2)), over
    the column's texts; ``number_sketch`` a KLL of size ``k`` (rank error about 2.3 / k), null for other columns.
    Sketches of parts or days of a table are merged by ``merged``.
    """
    parts = []
    for i, f in enumerate(fields(df)):
        c, kind = clean(df, f.name), kind_of(f.dataType)
        text = F.to_json(c) if kind == "nested" else c.cast("string")
        number = F.kll_sketch_agg_double(c.cast("double"), k) if kind in ("int", "float") else F.lit(None).cast("binary")
        parts.append(F.struct(F.lit(i).alias("col_pos"), F.hll_sketch_agg(text, lg_k).alias("distinct_sketch"), number.alias("number_sketch")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def merged(sketched: DataFrame) -> DataFrame:
    """One pair of sketches per column from those of several parts."""
    return sketched.groupBy("col_pos").agg(
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.count("number_sketch") > 0, F.kll_merge_agg_double("number_sketch")).alias("number_sketch"))


STEPS = 200  # parts of the rank scale at which the share of outliers is read off


def estimates(sketched: DataFrame) -> DataFrame:
    """col_pos, unique_estimate, q1, median, q3 and the share of numbers outside the 1.5 IQR fences, to 1 / ``STEPS``."""
    places = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    out = sketched.select(
        "col_pos", F.hll_sketch_estimate("distinct_sketch").alias("unique_estimate"),
        F.when(F.col("number_sketch").isNotNull(), F.kll_sketch_get_quantile_double("number_sketch", places)).alias("q"))
    q1, q2, q3 = (F.get("q", F.lit(STEPS * i // 4)) for i in (1, 2, 3))
    fence = (F.col("q3") - F.col("q1")) * 1.5
    outside = F.filter("q", lambda x: (x < F.col("q1") - fence) | (x > F.col("q3") + fence))
    return out.select("*", q1.alias("q1"), q2.alias("median"), q3.alias("q3")).withColumn(
        "outlier_share", F.when(F.col("q1").isNotNull(), F.size(outside) / (STEPS + 1))).drop("q")


def wide_stats(df: DataFrame) -> DataFrame:
    """Row count, nulls and moments of every column in one scan, no shuffle of rows."""
    none = F.lit(None)
    per_column = []
    for i, f in enumerate(fields(df)):
        c, kind = clean(df, f.name), kind_of(f.dataType)
        number = kind in ("int", "float")
        low, high = (none, none) if kind == "nested" else (F.min(c), F.max(c))
        if kind == "datetime":
            low, high = F.min(c).cast("date"), F.max(c).cast("date")
        per_column.append(F.struct(
            F.lit(i).alias("col_pos"),
            F.count(c).alias("non_null"),
            (low.cast("string")).alias("min"), (high.cast("string")).alias("max"),
            (F.min(c).cast("double") if number else none.cast("double")).alias("num_min"),
            (F.max(c).cast("double") if number else none.cast("double")).alias("num_max"),
            (F.avg(c) if number else none).cast("double").alias("avg"),
            (F.stddev_samp(c) if number else none).cast("double").alias("sd"),
        ))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*per_column).alias("cols"))
    return one.select("n_rows", F.inline("cols"))


def null_stats(df: DataFrame) -> DataFrame:
    share = F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("non_null")) / F.col("n_rows"))
    return (
        wide_stats(df).withColumn("null_count", F.col("n_rows") - F.col("non_null"))
        .withColumn("null_share", share)
        .withColumn("null_ratio", F.round(share, 4))
    )


def unique_stats(freq: DataFrame) -> DataFrame:
    """Distinct values, non-null cells and mean text length per column."""
    return freq.groupBy("col_pos").agg(
        F.count(F.lit(1)).alias("unique_count"),
        (F.sum(F.length("value") * F.col("cnt")) / F.sum("cnt")).alias("avg_len"))


def sample_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct values in row order; in value order without positions."""
    kept = top_k(freq, ["col_pos"], [F.asc_nulls_last("first_pos"), F.asc("value")], k, "rn")
    return kept.groupBy("col_pos").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]
    ).alias("sample_values"))


def top_values(freq: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with counts, ties by value."""
    return top_k(freq, ["col_pos"], [F.desc("cnt"), F.asc("value")], k, "rn")


def quantiles(freq: DataFrame) -> DataFrame:
    found = exact_quantiles(
        freq.filter(F.col("num").isNotNull()), "col_pos", "num", "cnt", [0.25, 0.5, 0.75])
    return found.groupBy("col_pos").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))


def outliers(freq: DataFrame, quant: DataFrame) -> DataFrame:
    """Values strictly outside the 1.5 IQR fences, columns of at least 4 values."""
    fence = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("num") < F.col("q1") - fence) | (F.col("num") > F.col("q3") + fence)
    # quant holds one row per column of the table, so its size is the schema's.
    return (
        freq.filter(F.col("num").isNotNull()).join(F.broadcast(quant), "col_pos")
        .groupBy("col_pos").agg(
            F.sum("cnt").alias("n"),
            F.sum(F.when(outside, F.col("cnt")).otherwise(0)).alias("outlier_count"))
        .filter((F.col("n") >= 4) & (F.col("outlier_count") > 0))
        .select("col_pos", "outlier_count")
    )


def parsed_date(text: Column, fmt: int) -> Column:
    shape, pattern = DATE_SHAPES[fmt]
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))


def date_sniff(df: DataFrame, pos: str, k: int = 20) -> DataFrame:
    """Share of the first ``k`` non-null texts that parse in the first text's format."""
    texts = [f.name for f in fields(df) if kind_of(f.dataType) == "string"]
    table = cells(df, pos).filter(F.col("col_pos").isin(
        [i for i, f in enumerate(fields(df)) if f.name in texts]))
    first = top_k(table, ["col_pos"], [F.asc("pos")], k, "rn")
    hits = F.array(*[parsed_date(F.col("value"), i).isNotNull().cast("int")
                     for i in range(len(DATE_SHAPES))])
    heads = first.withColumn("hits", hits).groupBy("col_pos").agg(
        F.array_sort(F.collect_list(F.struct("rn", "hits"))).alias("seen"))
    chosen = F.array_position(F.element_at("seen", 1)["hits"], 1)
    parsed = F.size(F.filter("seen", lambda s: F.get(s["hits"], (chosen - 1).cast("int")) == 1))
    rate = F.when(chosen > 0, parsed / F.size("seen")).otherwise(0.0)
    return heads.select(
        "col_pos", F.when(rate > 0.8, (chosen - 1).cast("int")).alias("date_format"),
        rate.alias("date_rate"))


def semantic_type(sniffed: Column) -> Column:
    """The type ladder over one row of column statistics."""
    name = F.lower("name")
    ratio = F.when(F.col("non_null") > 0, F.col("unique_count") / F.col("non_null")).otherwise(0.0)
    is_text = F.col("kind").isin("string", "nested") | (
        (F.col("kind") == "bool") & (F.col("raw_dtype") == "object"))
    int_now = (F.col("kind") == "int") & (F.col("raw_dtype") != "float64")
    year_like = name.rlike(fv.TIME_PATTERN) & int_now & F.coalesce(
        (F.col("num_min") >= 1800) & (F.col("num_max") <= 2100), F.lit(True))
    return (
        F.when((F.col("kind") == "datetime") | year_like, "datetime")
        .when(F.col("kind").isin("int", "float", "bool") & ~is_text, "numeric")
        .when(is_text & F.coalesce(sniffed, F.lit(False)), "datetime")
        .when(name.rlike(fv.ID_PATTERN), "identifier")
        .when((ratio > 0.95) & (F.col("non_null") > 5) & (F.col("avg_len") <= 20), "identifier")
        .when(is_text & (ratio > 0.3) & (ratio < 0.98) & (F.col("avg_len") > 3), "entity")
        .when(is_text & (ratio <= 0.3), "categorical")
        .when(is_text & (F.col("avg_len") > 60), "free_text")
        .otherwise("categorical")
    )


def with_dtype(stats: DataFrame) -> DataFrame:
    """An integer column with nulls reads as float64, a boolean one as object."""
    missing = F.col("null_count") > 0
    return stats.withColumn("raw_dtype", F.when(missing & (F.col("kind") == "int"), "float64")
                            .when(missing & (F.col("kind") == "bool"), "object")
                            .otherwise(F.col("base_dtype")))


def flags() -> dict[str, Column]:
    name, sem = F.lower("name"), F.col("semantic_type")
    return {
        "is_candidate_identifier": (sem == "identifier") | name.rlike(fv.ID_PATTERN),
        "is_entity_like": sem.isin("entity", "categorical") & (F.col("unique_count") > 3),
        "is_useful_for_querying": sem.isin("categorical", "entity", "datetime", "identifier"),
        "is_useful_for_joining": (sem == "identifier") | name.rlike(fv.GEO_PATTERN)
        | name.rlike(fv.TIME_PATTERN)
        | ((sem == "categorical") & (F.col("unique_count") <= 100)),
    }


def typed_columns(df: DataFrame, freq: DataFrame, pos: str | None) -> DataFrame:
    """Statistics, semantic type and flags, one row per column."""
    stats = (
        columns_table(df).join(null_stats(df), "col_pos")
        .join(unique_stats(freq), "col_pos", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))
        .withColumn("unique_ratio", F.when(F.col("n_rows") > 0, F.round(
            F.col("unique_count") / F.col("n_rows"), 4)))
    )
    has_text = any(kind_of(f.dataType) == "string" for f in fields(df))
    if pos and has_text:
        stats = stats.join(date_sniff(df, pos), "col_pos", "left")
    else:
        stats = stats.withColumn("date_format", F.lit(None).cast("int"))
    typed = with_dtype(stats).withColumn(
        "semantic_type", semantic_type(F.col("date_format").isNotNull()))
    return typed.withColumns(flags())


def date_ranges(freq: DataFrame, typed: DataFrame) -> DataFrame:
    """First and last day of text columns that read as dates."""
    fmt = typed.filter("semantic_type = 'datetime' and date_format is not null").select(
        "col_pos", "date_format")
    day = F.coalesce(*[F.when(F.col("date_format") == i, parsed_date(F.col("value"), i))
                       for i in range(len(DATE_SHAPES))]).cast("date")
    # fmt holds at most one row per column of the table.
    return freq.join(F.broadcast(fmt), "col_pos").groupBy("col_pos").agg(
        F.min(day).cast("string").alias("day_min"), F.max(day).cast("string").alias("day_max"))


def profile_columns(df: DataFrame, pos: str | None = None) -> DataFrame:
    """The full column profile, one row per column, held as a table."""
    freq = cut(frequency_table(df, pos), "freq")
    typed = cut(typed_columns(df, freq, pos), "typed")
    quant = cut(quantiles(freq), "quantiles")
    tops = (
        top_values(freq).groupBy("col_pos").agg(F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "value", "cnt"))),
            lambda s: F.struct(s["value"], s["cnt"]))).alias("top_values"))
    )
    out = (
        typed.join(sample_values(freq), "col_pos", "left")
        .join(quant, "col_pos", "left").join(tops, "col_pos", "left")
        .join(date_ranges(freq, typed), "col_pos", "left")
        .join(outliers(freq, quant), "col_pos", "left")
    )
    sem = F.col("semantic_type")
    numeric, ranged = sem == "numeric", sem.isin("numeric", "datetime")
    return cut(out.select(
        "col_pos", "name", "raw_dtype", "semantic_type", "n_rows", "null_count", "null_share",
        "null_ratio", "unique_count", "unique_ratio",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        F.when(ranged, F.when(F.col("date_format").isNotNull(), F.col("day_min"))
               .otherwise(F.col("min"))).alias("min"),
        F.when(ranged, F.when(F.col("date_format").isNotNull(), F.col("day_max"))
               .otherwise(F.col("max"))).alias("max"),
        F.when(numeric, F.round("avg", 4)).alias("mean"),
        F.when(numeric, F.round("sd", 4)).alias("std"),
        F.when(numeric, F.col("median")).alias("median"),
        F.when(sem.isin("categorical", "entity"), F.col("top_values")).alias("top_values"),
        *flags().keys(), "outlier_count"), "profile")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls are equal."""
    per_group = df.groupBy(*[F.col(f"`{f.name}`") for f in fields(df)]).agg(
        F.count(F.lit(1)).alias("_n"))
    return per_group.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"))


SKETCH = 1 << 8  # one in so many combinations, by hash, is in the sketch that tells repeating pairs


def composite_keys(df: DataFrame, ids: list[str], limit: int = 5) -> DataFrame:
    """Column pairs whose non-null combinations never repeat, first ``limit`` in order.

    A sketch holds the combinations with the smallest hashes of every pair. Two equal ones in it
    prove that a pair repeats, so pairs that repeat often are settled by a small part of the
    rows. Only the others are counted in full, one after the other until ``limit`` are found.
    """
    cols = ids or [f.name for f in fields(df)][:10]
    pairs = list(combinations(cols, 2))
    spark = df.sparkSession
    schema = "pair_pos int, col_a string, col_b string"
    if not pairs:
        return spark.createDataFrame([], schema)

    def key(i):
        a, b = (clean(df, c) for c in pairs[i])
        return F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(F.lit(i), a, b))

    marks = F.filter(F.array(*[F.struct(F.lit(i).alias("pair_pos"), key(i).alias("h")) for i in range(len(pairs))]),
                     lambda m: F.pmod(m["h"], F.lit(SKETCH)) == 0)
    sketch = df.select(F.explode(marks).alias("m"), *[clean(df, c).alias(f"_{j}") for j, c in enumerate(cols)])
    # equal hashes of different values must not settle a pair: the values are compared as well
    values = F.array(*[F.when(F.col("m.pair_pos") == i, F.to_json(F.struct(*[F.col(f"_{cols.index(c)}").alias(str(n)) for n, c in enumerate(p)])))
                       for i, p in enumerate(pairs)])
    repeated = {r["pair_pos"] for r in sketch.groupBy(F.col("m.pair_pos").alias("pair_pos"), F.concat_ws("", values).alias("v")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("pair_pos").distinct().collect()}  # at most one row per pair
    found = []
    for i, (a, b) in enumerate(pairs):
        if i in repeated or len(found) == limit:
            continue
        x, y = clean(df, a), clean(df, b)
        again = df.select(x.alias("a"), y.alias("b")).filter("a is not null and b is not null").groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not again.head(1):
            found.append((i, a, b))
    return spark.createDataFrame(found, schema)


def concepts(names_text: Column) -> Column:
    """Sorted topic areas of a text of column names."""
    def hits(text):
        # The patterns are plain alternatives, and a text search beats a regex on long texts.
        return F.array_compact(F.array(*[
            F.when(reduce(lambda a, b: a | b, [
                F.contains(text, F.lit(w)) for w in p.strip("()").split("|")]), F.lit(c))
            for c, p in sorted(fv.CONCEPT_PATTERNS.items())]))
    return let(F.lower(names_text), hits)


def signature_lists(profile: DataFrame) -> DataFrame:
    """The name lists of the signature, in column order, as one row."""

    def names(cond: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(cond, F.struct("col_pos", "name"))))
        return F.transform(picked, lambda s: s["name"])

    has_samples = F.col("is_entity_like") & (F.size("sample_values") > 0)
    samples = F.array_sort(F.collect_list(
        F.when(has_samples, F.struct("col_pos", "name", "sample_values"))))
    return profile.agg(
        names(F.col("is_candidate_identifier")).alias("candidate_identifiers"),
        names(F.col("is_entity_like")).alias("entity_like_columns"),
        names((F.col("semantic_type") == "numeric") & (F.col("unique_ratio") > 0.5)).alias(
            "important_attributes"),
        names(F.col("is_useful_for_querying") | F.col("is_useful_for_joining")).alias(
            "salient_column_names"),
        names(F.col("null_share") > 0.2).alias("high_missingness_columns"),
        names(F.lit(True)).alias("column_names"),
        F.map_from_entries(F.transform(samples, lambda s: F.struct(
            s["name"], s["sample_values"]))).alias("entity_value_samples"),
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("outlier_count") > 0, F.struct(
                "col_pos", "name", "outlier_count")))),
            lambda s: F.struct(s["name"], F.struct(
                s["outlier_count"].alias("outlier_count"), F.lit("IQR_1.5x").alias("method"))),
        )).alias("outlier_summary"),
        F.array_sort(F.collect_list(F.struct(
            "col_pos", "name", "raw_dtype", "semantic_type", "null_count", "null_ratio",
            "unique_count", "unique_ratio", "sample_values", "min", "max", "mean", "std",
            "median", F.to_json("top_values").alias("top_values"), *flags().keys(),
        ))).alias("columns"),
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
    )


def signature(df: DataFrame, name: str, pos: str | None = None,
              profile: DataFrame | None = None, file_format: str | None = None) -> DataFrame:
    """The seed signature: one row whose size is that of the schema."""
    prof = profile if profile is not None else profile_columns(df, pos)
    ids = [r["name"] for r in prof.filter("is_candidate_identifier").orderBy("col_pos")
           .select("name").collect()]
    keys = composite_keys(df, ids).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pair_pos", "col_a", "col_b"))),
        lambda s: F.array(s["col_a"], s["col_b"])).alias("candidate_composite_keys"))
    lists, dup = signature_lists(prof), duplicate_rows(df)
    joined_names = F.array_join("column_names", " ")
    parts = lists.unionByName(keys, allowMissingColumns=True).unionByName(dup, allowMissingColumns=True)
    one = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])  # three rows
    return one.select(
        F.lit(name).alias("dataset_name"), F.lit(file_format).alias("file_format"),
        F.current_timestamp().cast("string").alias("profiled_at"),
        "n_rows", "n_columns", "columns", "candidate_identifiers", "candidate_composite_keys",
        "entity_like_columns", "important_attributes", "salient_column_names",
        "entity_value_samples",
        F.struct("duplicate_row_count", "high_missingness_columns", "outlier_summary").alias(
            "quality_profile"),
        concepts(joined_names).alias("inferred_concepts"))
