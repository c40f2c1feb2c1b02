"""Seed tables: CSV, TSV, JSON and Parquet with the reference's typing rules."""

from __future__ import annotations

import csv
import io
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import fixed_values as fv
from tablescout.session import cut, new_folder
from tablescout.sources import blocks

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def without_na(df: DataFrame) -> DataFrame:
    """Texts that mean missing become null."""
    return df.select(*[
        F.when(~_col(f.name).isin(fv.NA_TOKENS), _col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else _col(f.name) for f in df.schema.fields])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null: both mean missing."""
    return df.select(*[
        F.when(~F.isnan(_col(f.name)), _col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else _col(f.name)
        for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest type that all their values fit, found in one scan."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    checks = []
    for i, n in enumerate(names):
        c = _col(n)
        checks += [F.count(c).alias(f"n{i}"),
                   F.count_if(c.rlike(WHOLE) & c.try_cast("bigint").isNotNull()).alias(f"w{i}"),
                   F.count_if(c.rlike(NUMBER)).alias(f"d{i}"), F.count_if(c.rlike(TRUTH)).alias(f"b{i}")]
    seen = df.agg(*checks).first()  # four counts per column
    casts = {}
    for i, n in enumerate(names):
        total = seen[f"n{i}"]
        if total == 0:
            casts[n] = _col(n).try_cast("double")
        elif seen[f"w{i}"] == total:
            casts[n] = F.trim(_col(n)).try_cast("bigint")
        elif seen[f"d{i}"] == total:
            casts[n] = F.trim(_col(n)).try_cast("double")
        elif seen[f"b{i}"] == total:
            casts[n] = F.lower(_col(n)).try_cast("boolean")
    return df.select(*[casts.get(c, _col(c)).alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", infer: bool = True, position: str | None = None) -> DataFrame:
    """A headed text table. All cells are read as text, so that every NA text is seen.

    One file is read by many tasks, also where quoted cells hold line breaks. ``position``
    names a column for the place of each row over all files, from 0.
    """
    options = {"sep": sep, "escape": '"'}
    if blocks.has_open_lines(spark, path, sep):
        raw = _quoted_records(spark, path, options, position)
    else:
        raw = spark.read.options(header=True, inferSchema=False, **options).csv(path)
        raw = with_row_position(raw, position) if position else raw
    raw = without_na(raw)
    return infer_types(raw) if infer else raw


def has_wide_rows(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether some record has more cells than the header has names."""
    if blocks.has_open_lines(spark, path, sep):
        rows = blocks.delimited_records(spark, path, sep)
    else:
        rows = spark.read.option("lineSep", "\n").text(path).withColumn("head", F.lit(False)).filter("trim(value) <> ''")
    first = spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> ''").head(1)
    names = len(next(csv.reader([first[0]["value"]], delimiter=sep))) if first else 0
    return bool(rows.filter("not head").filter(_cells_of("value", sep) > names).head(1))


def _cells_of(value: str, sep: str) -> Column:
    """Number of cells of a record, separators inside quotes aside."""
    bare = F.regexp_replace(value, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _quoted_records(spark: SparkSession, path: str, options: dict[str, str], position: str | None) -> DataFrame:
    rows = cut(blocks.delimited_records(spark, path, options["sep"]), "records")
    head = rows.filter("head").orderBy("pos").first()
    names = safe_names(next(csv.reader(io.StringIO(head["value"], newline=""), delimiter=options["sep"])))
    kind = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv("value", kind.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {**options, "multiLine": "true"})
    out = rows.filter("not head").select("pos", cells.alias("r"))
    place = [F.col("pos").alias(position)] if position else []
    return out.select(*[F.col(f"r._c{i}").alias(n) for i, n in enumerate(names)], *place)


def safe_names(cells: list[str]) -> list[str]:
    """Names for the cells of a header: empty ones and ones that occur twice get their place."""
    often = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if often[c.lower()] > 1 else c for i, c in enumerate(cells)]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ",")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "\t")


def json_records(text: Column, strict: bool = False) -> Column:
    """The records of one JSON document as an array of JSON texts.

    An array gives its elements; an object its first list in document order, else itself.
    ``strict`` (candidate files): the list must not be empty and an object is no record.
    """
    body = F.trim(text)
    return F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")).otherwise(
        F.coalesce(_first_list(body, strict), F.lit(None).cast("array<string>") if strict
                   else F.array(body)))


def _first_list(body: Column, strict: bool) -> Column:
    members = F.from_json(body, "map<string,string>")
    usable = F.filter(F.json_object_keys(body), lambda k: F.startswith(
        F.coalesce(members[k], F.lit("")), F.lit("[")) & (
        F.size(F.from_json(members[k], "array<string>")) > (0 if strict else -1)))
    return F.from_json(members[F.get(usable, F.lit(0))], "array<string>")


def read_json(spark: SparkSession, path: str, strict: bool = False, position: str | None = None) -> DataFrame:
    """Records arrays and envelopes, one document per file, of any size; the schema is inferred by Spark.

    Elements of one large array are cut by many tasks. Columns come in the order in which the
    records name them first; ``position`` names a column for the records' order.
    """
    records = cut(blocks.json_elements(spark, path, strict), "json-elements")
    folder = new_folder(spark, "json-records")
    records.select(F.concat(F.lit('{"at":'), "pos", F.lit(',"record":'), "value", F.lit("}"))).write.text(folder)
    rows = spark.read.json(folder)
    if not isinstance(rows.schema["record"].dataType, T.StructType):
        raise ValueError(f"{path} holds no records")
    first = records.select("pos", F.posexplode(F.json_object_keys("value")).alias("i", "name")).groupBy("name").agg(
        F.min(F.struct("pos", "i")).alias("first"))
    order = {r["name"]: i for i, r in enumerate(first.orderBy("first").select("name").collect())}  # names only
    names = sorted(rows.schema["record"].dataType.names, key=lambda n: order.get(n, len(order)))
    place = [F.col("at").alias(position)] if position else []
    return rows.select(*[F.col("record").getField(n).alias(n) for n in names], *place)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


READERS = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".parquet": read_parquet}


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    for ext, reader in READERS.items():
        if path.lower().rstrip("/").endswith(ext):
            return reader(spark, path)
    raise ValueError(f"unsupported seed format: {path}; known: {', '.join(READERS)}")


def with_row_position(df: DataFrame, out: str = "_pos") -> DataFrame:
    """Number the rows of a file source in file order, from 0.

    Must directly follow the read, while rows still know their file and block. Rows of a block
    stand in one task one after the other, so the count and the first number of every block,
    a small table, give the place of each row without sorting any.
    """
    file, block, at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    marked = df.withColumns({"_file": file, "_start": block, "_at": at})
    sizes = marked.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_file = sizes.withColumn("_in_file", F.sum("_n").over(
        Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)))
    files = sizes.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    files = files.select("_file", F.sum("_rows").over(  # one row per file
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)).alias("_files_before"))
    zero = F.lit(0).cast("bigint")
    starts = in_file.join(files, "_file").select(
        "_file", "_start", (F.coalesce("_in_file", zero) + F.coalesce("_files_before", zero) - F.col("_first")).alias("_shift"))
    return marked.join(starts, ["_file", "_start"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_file", "_start", "_at", "_shift")
