"""Landed catalog answers turned into candidates of one schema.

``landed``: query_id, query, source_name, source_url, status, error, body. Bodies are parsed
with JVM functions; values whose shape varies stay JSON text until their shape is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.order import top_k

STRINGS = "array<string>"
MEMBERS = "map<string,string>"
CANDIDATE = ["connector", "source_name", "source_url", "dataset_id", "title", "description",
             "landing_page", "keywords", "download_urls", "field_names", "raw_metadata"]


def either(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def or_empty(*cols: Column) -> Column:
    return F.coalesce(either(*cols), F.lit(""))


def json_list(text: Column) -> Column:
    """A JSON list as texts; a single value as a list of one; null as no values."""
    return (
        F.when(text.isNull(), F.array().cast(STRINGS))
        .when(F.startswith(text, F.lit("[")), F.coalesce(F.from_json(text, STRINGS), F.array(text))).otherwise(F.array(text))
    )


# Stand for an escaped backslash and an escaped quote while strings are told apart; no text holds them.
_SLASH, _QUOTE = "﷐", "﷑"
# A string with the colon that makes it a name, or another scalar, or an empty list or object.
_TOKEN = r'"[^"]*"(?:\s*:)?|-?[0-9][0-9.eE+\-]*|true|false|null|\[\s*\]|\{\s*\}'


def scalars(text: Column) -> Column:
    """The scalars of a JSON value of any depth, in document order; null and empty lists and objects count as empty.

    Read off the text itself: no level is parsed into a value of its own.
    """
    slashes, quote = F.lit("\\\\"), F.lit('\\"')
    masked = F.replace(F.replace(text, slashes, F.lit(_SLASH)), quote, F.lit(_QUOTE))
    found = F.filter(F.regexp_extract_all(masked, F.lit(_TOKEN), 0), lambda t: ~F.endswith(t, F.lit(":")) | ~F.startswith(t, F.lit('"')))
    found = F.transform(found, lambda t: F.when(t.rlike(r"^(null|\[\s*\]|\{\s*\})$"), F.lit('""')).otherwise(t))
    whole = F.concat(F.lit("["), F.array_join(found, ","), F.lit("]"))
    return F.from_json(F.replace(F.replace(whole, F.lit(_QUOTE), quote), F.lit(_SLASH), slashes), STRINGS)


def flat_text(text: Column) -> Column:
    """The scalars of a JSON value of any depth joined by blanks; a text that only looks like JSON stays."""
    is_json = F.when(F.startswith(text, F.lit("[")), F.from_json(text, STRINGS).isNotNull()).when(
        F.startswith(text, F.lit("{")), F.from_json(text, MEMBERS).isNotNull())
    return F.when(text.isNull(), "").when(is_json, F.array_join(scalars(text), " ")).otherwise(text)


def some(values: Column) -> Column:
    """A list without nulls and empty texts."""
    return F.filter(F.coalesce(values, F.array().cast(STRINGS)), lambda v: v.isNotNull() & (v != ""))


def metadata(**parts: Column) -> Column:
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))])


def answer(landed: DataFrame) -> DataFrame:
    """``landed`` with the members of each answer in ``_top``, null where it failed or is no JSON object.

    This one parse decides whether an answer can be read, so no size limit of its own applies.
    """
    return landed.withColumn("_top", F.when(F.coalesce("status", F.lit(0)) < 400, F.from_json("body", MEMBERS)))


def errors(landed: DataFrame, connector: str, once_per_source: bool = False) -> DataFrame:
    """Error rows of failed answers; catalogs fetched once report once, at their first query."""
    failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    bad = answer(landed).filter("_top is null").select(
        F.lit(connector).alias("connector"), "source_name", "source_url",
        F.coalesce("error", failed, F.lit("unreadable answer")).alias("discovery_error"),
        "query", "query_id", F.lit(True).alias("is_error"))
    if once_per_source:
        bad = top_k(bad, ["source_url"], [F.asc("query_id")], 1, "_rn").drop("_rn")
    return bad


def _list_texts(text: Column) -> Column:
    """The items of a JSON list; null if it is none."""
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, STRINGS))


def _placed(rows: DataFrame, *columns: Column, texts: str, at: str) -> DataFrame:
    """A row for each of ``texts``, its place in ``at`` and its JSON in ``_item``.

    Spark would repeat the parse of the whole answer in a filter on its size before a plain explode.
    """
    return rows.select(*columns, F.posexplode_outer(texts).alias(at, "_item")).filter(F.col(at).isNotNull())


def _items(landed: DataFrame, path: list[str], schema: str, limit: int | None) -> DataFrame:
    """The first ``limit`` items of each good answer, parsed, with their 1-based place.

    Each level is a column of its own, so that it is parsed once however often it is named.
    """
    rows = answer(landed)
    for name in path[:-1]:
        rows = rows.withColumn("_top", F.from_json(F.col("_top")[name], MEMBERS))
    rows = rows.withColumn("_list", F.col("_top")[path[-1]]).withColumn("_texts", _list_texts(F.col("_list")))
    rows = _placed(
        rows.withColumn("_texts", F.slice("_texts", 1, limit)) if limit else rows, F.col("query_id"), F.col("query"),
        F.col("source_name").alias("_source"), F.col("source_url").alias("_url"), texts="_texts", at="_at")
    return rows.withColumn("pos", F.col("_at") + 1).withColumn("i", F.from_json("_item", schema))


def _candidates(items: DataFrame, connector: str, **parts: Column) -> DataFrame:
    parts["connector"] = F.lit(connector)
    return items.select("query_id", "query", "pos", *[parts[c].alias(c) for c in CANDIDATE])


def ckan(landed: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    d = _items(landed, ["result", "results"], (
        "id string, name string, title string, notes string, organization struct<title:string>, "
        "metadata_modified string, license_title string, tags string, "
        "resources array<struct<url:string, schema:struct<fields:array<struct<name:string>>>>>"), limit)
    fields = F.flatten(F.transform("i.resources", lambda r: F.coalesce(
        r["schema"]["fields"]["name"], F.array().cast(STRINGS))))
    tags = F.transform(json_list(F.col("i.tags")), lambda t: F.when(
        F.startswith(t, F.lit("{")), F.get_json_object(t, "$.display_name")).otherwise(t))
    base = F.regexp_replace("_url", "/+$", "")
    return _candidates(
        d, "CKAN", source_name=F.col("_source"), source_url=F.col("_url"),
        dataset_id=either(F.col("i.id"), F.col("i.name")),
        title=or_empty(F.col("i.title"), F.col("i.name")), description=or_empty(F.col("i.notes")),
        landing_page=F.when(either(F.col("i.name")).isNotNull(), F.concat(
            base, F.lit("/dataset/"), F.col("i.name"))).otherwise(F.col("_url")),
        keywords=F.filter(tags, lambda t: t.isNotNull()), download_urls=some(F.col("i.resources.url")),
        field_names=some(fields), raw_metadata=metadata(
            organization=F.coalesce("i.organization.title", F.lit("")),
            metadata_modified=F.col("i.metadata_modified"), license_title=F.col("i.license_title")))


def dcat_entries(landed: DataFrame) -> DataFrame:
    """Entries of landed catalogs with their order: ``dataset`` or, if empty, ``datasets``.

    ``landed``: catalog_pos, source_name, source_url, status, error, body.
    """
    top = F.col("_top")
    d = answer(landed).withColumn("_first", top["dataset"]).withColumn("_second", top["datasets"]).withColumn(
        "_first", _list_texts(F.col("_first"))).withColumn(
        "_texts", F.when(F.size("_first") > 0, F.col("_first")).otherwise(_list_texts(F.col("_second"))))
    d = _placed(d, F.col("catalog_pos"), F.col("source_name").alias("_source"), F.col("source_url").alias("_url"),
                texts="_texts", at="entry_pos")
    d = d.withColumn("i", F.from_json("_item", (
        "title string, description string, keyword string, identifier string, `@id` string, "
        "landingPage string, accessURL string, distribution string, dataDictionary string, "
        "publisher string, theme string, issued string, modified string")))

    def members(text, *names):
        objects = F.filter(json_list(text), lambda o: F.startswith(o, F.lit("{")))
        # ``either`` would name, and so read, each member twice
        return some(F.transform(objects, lambda o: F.get(some(F.array(*[F.get_json_object(o, f"$.{n}") for n in names])), F.lit(0))))

    d = d.withColumns({"_title": flat_text(F.col("i.title")), "_desc": flat_text(F.col("i.description")),
                       "_words": some(json_list(F.col("i.keyword")))})
    title, desc, words = F.col("_title"), F.col("_desc"), F.col("_words")
    return d.select(
        "catalog_pos", "entry_pos", F.concat_ws("#", "_url", "entry_pos").alias("entry_id"),
        F.lit("DCAT").alias("connector"), F.col("_source").alias("source_name"),
        F.col("_url").alias("source_url"),
        either(F.col("i.identifier"), F.col("i.@id"), title).alias("dataset_id"),
        title.alias("title"), desc.alias("description"),
        either(F.col("i.landingPage"), F.col("i.accessURL"), F.col("i.@id")).alias("landing_page"),
        words.alias("keywords"), members(F.col("i.distribution"), "downloadURL", "accessURL").alias("download_urls"),
        members(F.col("i.dataDictionary"), "label", "name").alias("field_names"),
        metadata(publisher=flat_text(F.col("i.publisher")), theme=flat_text(F.col("i.theme")),
                 issued=F.col("i.issued"), modified=F.col("i.modified")).alias("raw_metadata"),
        F.concat_ws(" ", title, desc, F.array_join(words, " ")).alias("text"))


def socrata(landed: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    d = _items(landed, ["results"], (
        "permalink string, resource struct<id:string, name:string, description:string, "
        "columns_name:array<string>, updatedAt:string, createdAt:string, attribution:string>, "
        "metadata struct<domain:string, domain_tags:string, license:string>"), limit)
    domain, asset = either(F.col("i.metadata.domain")), either(F.col("i.resource.id"))
    url = F.concat(F.lit("https://"), domain, F.lit("/api/views/"), asset,
                   F.lit("/rows.csv?accessType=DOWNLOAD"))
    return _candidates(
        d, "Socrata",
        source_name=F.coalesce(F.concat(F.lit("Socrata ("), domain, F.lit(")")), F.lit("Socrata")),
        source_url=F.coalesce(F.concat(F.lit("https://"), domain), F.lit(fv.SOCRATA_URL)),
        dataset_id=F.coalesce(asset, F.col("i.permalink")),
        title=F.coalesce("i.resource.name", F.lit("")),
        description=F.coalesce("i.resource.description", F.lit("")),
        landing_page=F.coalesce("i.permalink", F.lit("")), keywords=json_list(F.col("i.metadata.domain_tags")),
        download_urls=some(F.array(url)),
        field_names=F.coalesce("i.resource.columns_name", F.array().cast(STRINGS)),
        raw_metadata=metadata(
            domain=F.coalesce(domain, F.lit("")), updatedAt=F.col("i.resource.updatedAt"),
            createdAt=F.col("i.resource.createdAt"), attribution=F.col("i.resource.attribution"),
            license=F.col("i.metadata.license")))


def arcgis(landed: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    d = _items(landed, ["results"], (
        "id string, owner string, title string, snippet string, description string, tags string, "
        "typeKeywords string, type string, modified string, access string, licenseInfo string"), limit)
    key = either(F.col("i.id"))
    tags = either(F.nullif("i.tags", F.lit("[]")), F.col("i.typeKeywords"))
    url = F.concat(F.lit("https://hub.arcgis.com/api/download/v1/items/"), key,
                   F.lit("/csv?redirect=true&layers=0"))
    return _candidates(
        d, "ArcGIS", source_name=F.lit("ArcGIS Hub"), source_url=F.lit(fv.ARCGIS_URL),
        dataset_id=F.coalesce(key, F.lit("")), title=F.coalesce("i.title", F.lit("")),
        description=or_empty(F.col("i.snippet"), F.col("i.description")),
        landing_page=F.coalesce(F.concat(F.lit("https://hub.arcgis.com/datasets/"), key), F.lit("")),
        keywords=some(json_list(tags)), download_urls=some(F.array(url)),
        field_names=F.array().cast(STRINGS), raw_metadata=metadata(
            owner=F.coalesce("i.owner", F.lit("")), type=F.col("i.type"), modified=F.col("i.modified"),
            access=F.col("i.access"), licenseInfo=F.coalesce("i.licenseInfo", F.lit(""))))


def datacite(landed: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    d = _items(landed, ["data"], (
        "attributes struct<doi:string, titles:array<struct<title:string>>, "
        "descriptions:array<struct<description:string>>, subjects:string, contentUrl:string, "
        "publisher:string, publicationYear:string, version:string, rightsList:string>"), limit)
    doi = either(F.col("i.attributes.doi"))
    titles, texts = F.col("i.attributes.titles"), F.col("i.attributes.descriptions")
    subjects = F.transform(F.filter(json_list(F.col("i.attributes.subjects")), lambda s: F.startswith(
        s, F.lit("{"))), lambda s: F.get_json_object(s, "$.subject"))
    return _candidates(
        d, "DataCite", source_name=F.lit("DataCite"), source_url=F.lit(fv.DATACITE_URL),
        dataset_id=F.coalesce(doi, F.lit("")),
        title=F.when(F.size(titles) > 0, F.coalesce(F.get(titles, F.lit(0))["title"], F.lit(""))).otherwise(
            F.coalesce(doi, F.lit(""))),
        description=F.coalesce(F.get(texts, F.lit(0))["description"], F.lit("")),
        landing_page=F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.lit("")),
        keywords=some(subjects), download_urls=some(json_list(F.col("i.attributes.contentUrl"))),
        field_names=F.array().cast(STRINGS), raw_metadata=metadata(
            doi=F.coalesce(doi, F.lit("")), publisher=flat_text(F.col("i.attributes.publisher")),
            publicationYear=F.col("i.attributes.publicationYear"), version=F.col("i.attributes.version"),
            license=flat_text(F.col("i.attributes.rightsList"))))


def all_candidates(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
