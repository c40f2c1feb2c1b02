"""Files fetched upstream: gates, archives, charsets and their cells."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions.files import file_cells, suffix, unpacked
from tablescout.operators.matching import content_skip_reason, url_skip_reason
from tablescout.operators.order import top_k
from tablescout.session import cut
from tablescout.sources import tables
from tablescout.sources.tables import infer_types

CELLS = "url string, member string, row_id bigint, col_pos int, col string, value string, error string"


def gate(manifest: DataFrame, max_bytes: int | None = fv.MAX_FILE_BYTES) -> DataFrame:
    """``skip_reason`` per landed file; null when its bytes are worth reading.

    ``manifest``: url, path, content_type, status, length. ``max_bytes`` None: large files are no reason.
    """
    failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP error: "), F.col("status").cast("string")))
    return manifest.withColumn("skip_reason", F.coalesce(
        url_skip_reason(F.col("url")), failed,
        content_skip_reason(F.col("content_type"), F.col("length"), max_bytes)))


def landed_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Bytes of the files that pass the gates. Files over the limit are never opened:
    the length filter reaches the scan. Per file: url, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(
        F.col("length") <= fv.MAX_FILE_BYTES).select("path", "content")
    return files.join(gate(manifest).filter("skip_reason is null").select("url", "path"), "path").select(
        "url", "content")


def archive_members(files: DataFrame) -> DataFrame:
    return files.mapInArrow(unpacked, "url string, member string, content binary, error string")


def charset(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(F.startswith(head, F.lit("EFBBBF")), "UTF-8")
        .when(F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF")), "UTF-16")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    )


def decoded(content: Column) -> Column:
    kind = charset(content)
    text = F.when(kind == "UTF-16", F.decode(content, "UTF-16")).when(
        kind == "UTF-8", content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def sniffed_separator(text: Column) -> Column:
    """For ``.txt``: the first separator that splits the header into more than one field, quoted ones aside."""
    head = F.regexp_replace(F.substring_index(text, "\n", 1), '"[^"]*"', "")
    seps = [(",", ","), ("\t", "\t"), (";", ";"), ("|", r"\|")]
    return F.coalesce(*[F.when(F.size(F.split(head, rx)) > 1, F.lit(s)) for s, rx in seps])


def candidate_cells(files: DataFrame) -> DataFrame:
    """Long cells of every landed file; a file without a usable table gives one error row."""
    return files.mapInPandas(file_cells, CELLS)


def read_table(spark: SparkSession, path: str, url: str) -> tuple[DataFrame | None, str]:
    """The table of one landed file by the reader of its format, or the reason why there is none.

    Text, JSON and Parquet of any size are read by many tasks; only archives are opened inside
    one task, up to a size. ``path`` may be a folder of parts.
    """
    kind = suffix(url)
    inner = suffix(url[:-3]) if kind == ".gz" else kind
    try:
        if kind == ".zip" or (kind == ".gz" and not path.lower().endswith(".gz")):
            df, reason = _archived(spark, path, url)
        elif inner in (".xls", ".xlsx"):
            return None, "spreadsheets are not read"
        elif inner == ".parquet":
            df, reason = tables.read_parquet(spark, path), ""
        elif inner == ".json":
            df, reason = tables.read_json(spark, path, strict=True), ""
        else:
            df, reason = _delimited(spark, path, inner)
    except (AnalysisException, ValueError) as e:
        return None, f"parse error: {str(e).splitlines()[0]}"
    if df is None:
        return None, reason
    if len(df.columns) < 2:
        return None, f"only {len(df.columns)} column(s)"
    return (df, "") if df.head(1) else (None, "empty table")


def _delimited(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame | None, str]:
    head = spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> ''").head(1)
    first = {".tsv": ["\t"], ".txt": []}.get(kind, [","])
    more = {".tsv": [], ".txt": [",", "\t", ";", "|"]}.get(kind, ["\t", ";", "|"])
    for sep in (*first, *more) if head else ():
        fields = next(csv.reader([head[0]["value"]], delimiter=sep), [])
        if (sep in first or len(fields) > 1) and not tables.has_wide_rows(spark, path, sep):
            return tables.read_delimited(spark, path, sep), ""
    return None, "could not parse as tabular data"


def _archived(spark: SparkSession, path: str, url: str) -> tuple[DataFrame | None, str]:
    files = spark.read.format("binaryFile").load(path).select(F.lit(url).alias("url"), "content")
    cells = cut(candidate_cells(files), "cells")
    bad = cells.filter("error <> ''").select("error").head(1)
    return (None, bad[0]["error"]) if bad else (wide(cells, url), "")


def open_candidates(chosen: DataFrame, manifest: DataFrame, max_bytes: int | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The table behind the first usable URL of every chosen candidate, and one row per candidate on what was tried.

    ``chosen``: dataset_id, index, download_urls of the candidates to attempt, a bounded list.
    ``manifest``: url, path, content_type, status, length of all landed files. The gate is passed
    before a file is opened, and a candidate's later URLs stay closed once one is usable.
    Second output: dataset_id, usable_url, attempted_urls, url_reasons.
    """
    spark = chosen.sparkSession
    urls = chosen.select("dataset_id", "index", F.posexplode("download_urls").alias("at", "url")).withColumn(
        "url", F.trim("url")).filter("url <> ''")
    known = gate(manifest, max_bytes).select("url", "path", "skip_reason")
    rows = urls.join(known, "url", "left").orderBy("index", "at").collect()  # URLs of at most top-k candidates
    found, tried = {}, {}
    for r in rows:
        d = r["dataset_id"]
        if d in found:
            continue
        reason, df = r["skip_reason"] or ("" if r["path"] else "not landed"), None
        if not reason:
            df, reason = read_table(spark, r["path"], r["url"])
        tried.setdefault(d, []).append((r["url"], reason))
        if df is not None:
            found[d] = df
    out = [(d, t[-1][0] if d in found else None, [u for u, _ in t], [x for _, x in t if x]) for d, t in tried.items()]
    return found, spark.createDataFrame(out, "dataset_id string, usable_url string, attempted_urls array<string>, url_reasons array<string>")


def file_status(cells: DataFrame) -> DataFrame:
    return cells.groupBy("url").agg(
        (F.max("error") == "").alias("usable"), F.max("error").alias("error"),
        (F.max("row_id") + 1).alias("n_rows"), (F.max("col_pos") + 1).alias("n_cols"),
        F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("text_bytes"))


def first_usable_url(cands: DataFrame, status: DataFrame) -> DataFrame:
    """Per candidate the first URL, in list order, with a usable table, and the URLs tried.

    ``cands``: dataset_id, download_urls. ``status``: url, usable.
    """
    urls = (
        cands.select("dataset_id", F.posexplode("download_urls").alias("at", "url"))
        .withColumn("url", F.trim("url")).filter("url <> ''")
    )
    ok = urls.join(status.filter("usable").select("url").distinct(), "url", "left_semi")
    first = top_k(ok, ["dataset_id"], [F.asc("at")], 1, "_rn").select(
        "dataset_id", F.col("url").alias("usable_url"), F.col("at").alias("_at"))
    tried = F.filter(F.transform("download_urls", lambda u, i: F.when(
        F.col("_at").isNull() | (i <= F.col("_at")), F.trim(u))), lambda u: u != "")
    return cands.join(first, "dataset_id", "left").select(
        "dataset_id", "download_urls", "usable_url", tried.alias("attempted_urls"))


def wide(cells: DataFrame, url: str) -> DataFrame:
    """The typed table of one landed file. Its size is bounded by the file limit."""
    one = cells.filter(F.col("url") == url)
    names = [r["col"] for r in one.filter("row_id = 0").orderBy("col_pos").select("col").collect()]
    rows = one.groupBy("row_id").pivot("col_pos", list(range(len(names)))).agg(F.first("value"))
    unique = [n if names.index(n) == i else f"{n}.{names[:i].count(n)}" for i, n in enumerate(names)]
    return infer_types(rows.select(*[F.col(str(i)).alias(n) for i, n in enumerate(unique)]))
