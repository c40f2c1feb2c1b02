"""Web pages: links and embedded dataset descriptions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import fixed_values as fv
from tablescout.operators.order import top_k
from tablescout.sources.payloads import STRINGS, either, flat_text, json_list, metadata, some

SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
NUMBERED = r"^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _numbered(text: Column) -> Column:
    """Numeric character references, decimal or hexadecimal, as the characters they name."""
    def one(part):
        mark = F.regexp_extract(part, NUMBERED, 0)
        digits = F.regexp_extract(mark, "[0-9a-fA-F]+", 0)
        code = F.when(F.lower(F.substring(mark, 1, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        named = (mark != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(named, F.concat(sign, F.substring(part, F.length(mark) + 1, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    return F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), F.array_join(
        F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(text)


def unescape(text: Column) -> Column:
    text = _numbered(text)
    for mark, ch in ENTITIES.items():
        text = F.replace(text, F.lit(mark), F.lit(ch))
    return text


def links(html: Column, first: int | None = None) -> Column:
    """Distinct absolute links in page order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 1), lambda u: unescape(F.regexp_replace(u, "^[\"']|[\"']$", "")))
    kept = F.array_distinct(F.filter(found, lambda u: F.startswith(u, F.lit("http"))))
    return F.slice(kept, 1, first) if first else kept


def _words(value) -> str:
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return " ".join(_words(v) for v in value)
    return "" if value is None else str(value)


def dataset_node(value):
    """The first description of a dataset, depth first through the known containers."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            if "dataset" in _words(node.get("@type")).lower():
                return node
            todo.extend(node.get(k) for k in ("itemListElement", "mainEntity", "@graph"))
    return None


@F.pandas_udf(T.StringType())
def first_dataset(scripts: pd.Series) -> pd.Series:
    def one(texts):
        for text in texts if texts is not None else ():
            try:
                node = dataset_node(json.loads(text))
            except ValueError:
                continue
            if node:
                return json.dumps(node)
        return None
    return scripts.map(one)


def dataset_pages(pages: DataFrame) -> DataFrame:
    """One candidate per page that embeds a dataset description. ``pages``: url, html."""
    node = pages.filter(F.contains(F.lower("html"), F.lit("ld+json"))).select(
        "url", F.regexp_extract("html", TITLE, 1).alias("_title"),
        first_dataset(F.regexp_extract_all("html", F.lit(SCRIPT), 1)).alias("_node")
    ).filter("_node is not null")
    d = node.withColumn("i", F.from_json("_node", (
        "`@id` string, identifier string, name string, description string, url string, keywords string, "
        "distribution string, creator string, publisher string, temporalCoverage string, spatialCoverage string")))
    words = F.when(F.startswith("i.keywords", F.lit("[")), json_list(F.col("i.keywords"))).otherwise(
        F.transform(F.split("i.keywords", ","), lambda k: F.trim(k)))
    files = F.filter(json_list(F.col("i.distribution")), lambda o: F.startswith(o, F.lit("{")))
    urls = F.transform(files, lambda o: either(F.get_json_object(o, "$.contentUrl"), F.get_json_object(o, "$.downloadUrl")))
    title = either(F.col("i.name"), unescape(F.col("_title")))
    return d.select(
        F.lit("Schema.org").alias("connector"), F.lit("Schema.org Dataset Page").alias("source_name"),
        F.col("url").alias("source_url"), either(F.col("i.@id"), F.col("i.identifier"), title).alias("dataset_id"),
        F.coalesce(title, "url").alias("title"), flat_text(F.col("i.description")).alias("description"),
        F.coalesce(either(F.col("i.url")), "url").alias("landing_page"), some(words).alias("keywords"),
        some(urls).alias("download_urls"), F.array().cast(STRINGS).alias("field_names"),
        metadata(creator=flat_text(F.col("i.creator")), publisher=flat_text(F.col("i.publisher")),
                 temporal_coverage=flat_text(F.col("i.temporalCoverage")),
                 spatial_coverage=flat_text(F.col("i.spatialCoverage"))).alias("raw_metadata"))


def discover(searches: DataFrame, pages: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    """First ``limit`` dataset pages among the first links of each search answer.

    ``searches``: query_id, query, html.
    """
    hits = searches.select("query_id", "query", F.posexplode(links(F.col("html"), 2 * limit)).alias("at", "source_url"))
    found = hits.join(dataset_pages(pages), "source_url")
    return top_k(found, ["query_id"], [F.asc("at")], limit, "pos").drop("at")
