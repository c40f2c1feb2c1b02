"""Finding candidates in the catalog and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions.text import extract_years, name_tokens, score4, slug_tokens, token_overlap
from tablescout.operators.order import top_k, with_position
from tablescout.operators.skew import salted_join
from tablescout.session import cut


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _joined(c: str) -> Column:
    return F.coalesce(F.array_join(c, " "), F.lit(""))


def searchable_text() -> Column:
    return F.lower(F.concat_ws(" ", _text("title"), _text("description"),
                               _joined("keywords"), _joined("field_names")))


def catalog_search(queries: DataFrame, catalog: DataFrame, limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    """Per query the ``limit`` catalog entries with the greatest share of query tokens.

    ``queries``: query, and any keys. ``catalog``: entry_id, catalog_pos, entry_pos, text.
    Output: the query columns with entry_id, score and pos (1-based).

    Scores come from an inverted index, never from all pairs. Equal query texts are
    searched once. A first look at a few entries of each query's rarest token gives a
    lower bound ``b`` of its last kept hit count. An entry with ``b`` hits holds at least
    ``r`` of the ``m - b + r`` rarest of the ``m`` tokens, so the postings of the ``b - r``
    most frequent ones are skipped and read only for entries with ``r`` hits so far.
    Exact for any ``b`` and ``r``; ``r`` is half of ``b``.

    Every join is shuffled: postings and tokens pack so well that Spark, which judges them by
    their files, would send many times its limit through the driver.
    """
    asked = (
        queries.select("query").distinct()
        .withColumn("tokens", F.array_distinct(slug_tokens(F.col("query"))))
        .select("query", F.size("tokens").alias("n_tokens"), _items("tokens").alias("token")).filter("token is not null")
    )
    postings = (
        catalog.select("entry_id", "catalog_pos", "entry_pos",
                       _items(F.array_distinct(slug_tokens(F.col("text")))).alias("token")).filter("token is not null")
        .join(asked.select("token").distinct().hint("merge"), "token", "left_semi")
    )
    postings = cut(postings, "postings")
    spread = postings.groupBy("token").agg(F.count(F.lit(1)).alias("entries"))
    by_rarity = F.array_sort(F.collect_list(F.struct("entries", "token")))
    # The tokens of one query text, so the lists are as short as the text.
    ranked = cut(
        asked.join(spread.hint("merge"), "token").groupBy("query", "n_tokens").agg(by_rarity.alias("t"))
        .select("query", "n_tokens", F.size("t").alias("m"), F.posexplode("t").alias("rarity", "t"))
        .select("query", "n_tokens", "m", "rarity", F.col("t.token").alias("token")), "tokens")

    entry = ["entry_id", "catalog_pos", "entry_pos"]
    in_order = [F.asc("catalog_pos"), F.asc("entry_pos")]
    look = top_k(
        salted_join(postings, ranked.filter("rarity = 0").select("query", "token"),
                    ["token"], F.col("entry_id")),
        ["query"], in_order, 4 * limit, "_rn").select("query", "entry_id")
    seen = _count_hits(look, ranked, postings)
    bound = (
        top_k(seen, ["query"], [F.desc("hits"), F.asc("entry_id")], limit, "_rn")
        .filter(F.col("_rn") == limit).select("query", F.col("hits").alias("bound"))
    )
    plan = cut(
        ranked.join(bound.hint("merge"), "query", "left")
        .withColumn("bound", F.greatest(F.coalesce("bound", F.lit(1)), F.lit(1)))
        .withColumn("need", F.ceil(F.col("bound") / 2))
        .withColumn("kept", F.col("rarity") < F.col("m") - F.col("bound") + F.col("need")), "search")

    found = (
        salted_join(postings, plan.filter("kept").select("query", "n_tokens", "need", "token"),
                    ["token"], F.col("entry_id"))
        .groupBy("query", "n_tokens", "need", *entry).agg(F.count(F.lit(1)).alias("kept_hits"))
        .filter("kept_hits >= need")
    )
    skipped = plan.filter("not kept").select("query", "token")
    more = (
        found.join(skipped.hint("merge"), "query").join(
            postings.select("entry_id", "token").hint("merge"), ["entry_id", "token"], "left_semi")
        .groupBy("query", "entry_id").agg(F.count(F.lit(1)).alias("more_hits"))
    )
    hits = F.col("kept_hits") + F.coalesce("more_hits", F.lit(0))
    scored = found.join(more.hint("merge"), ["query", "entry_id"], "left").select(
        "query", *entry, F.round(hits / F.col("n_tokens"), 4).alias("score"))
    best = top_k(scored, ["query"], [F.desc("score"), *in_order], limit, "pos")
    # Many seeds may ask the same text; its few answers meet them in many tasks.
    return salted_join(queries, best.select("query", "entry_id", "score", "pos"), ["query"],
                       F.struct(*queries.columns))


def _items(tokens) -> Column:
    """One row per token, and a null where there is none.

    The plain form has Spark ask, before equal queries are one, whether every query has a token.
    """
    return F.explode_outer(tokens)


def _count_hits(pairs: DataFrame, ranked: DataFrame, postings: DataFrame) -> DataFrame:
    return (
        pairs.join(ranked.select("query", "token").hint("merge"), "query")
        .join(postings.select("entry_id", "token").hint("merge"), ["entry_id", "token"], "left_semi")
        .groupBy("query", "entry_id").agg(F.count(F.lit(1)).alias("hits"))
    )


def year_range(doc_years: Column, columns: Column) -> Column:
    """The query document's two years, else the first datetime column with whole years."""
    def usable(c):
        return ((c["semantic_type"] == "datetime") & c["min"].rlike(r"^\d{4}$")
                & c["max"].rlike(r"^\d{4}$"))
    first = F.get(F.filter(columns, usable), F.lit(0))
    own = F.when(F.size(doc_years) == 2, F.struct(
        doc_years[0].cast("int").alias("year_min"), doc_years[1].cast("int").alias("year_max")))
    return F.coalesce(own, F.when(first.isNotNull(), F.struct(
        first["min"].cast("int").alias("year_min"), first["max"].cast("int").alias("year_max"))))


def completeness() -> Column:
    texts = [F.when(F.length(F.trim(c)) >= 0, (F.length(c) > 0).cast("int")).otherwise(0)
             for c in ("title", "description", "landing_page", "source_name", "dataset_id")]
    urls = (F.size(F.coalesce("download_urls", F.array().cast("array<string>"))) > 0).cast("int")
    return F.round(sum(texts[1:], texts[0]) / 6 + urls / 6, 4)


def field_tokens(fields: Column) -> Column:
    """Names with their tokens, cut once per seed rather than once per candidate."""
    return F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.struct(
        f.alias("name"), name_tokens(f).alias("tokens")))


def matched_fields(fields: Column, text: Column) -> Column:
    """Names all of whose tokens occur in the text; a name without tokens always does.

    ``fields``: names with tokens.
    """
    kept = F.filter(fields, lambda f: F.forall(f["tokens"], lambda t: F.contains(text, t)))
    return F.transform(kept, lambda f: f["name"])


def year_overlap(years: Column, text: Column, low: Column, high: Column) -> Column:
    hit = F.exists(years, lambda y: (y >= low) & (y <= high)) | F.contains(text, F.lit("year"))
    return F.coalesce(hit, F.lit(False))


def with_joinability(rows: DataFrame) -> DataFrame:
    """Add the seed-side scores to rows of candidate texts and seed fields.

    Seed fields: join_fields and salient_columns (names with tokens), year_min, year_max. Years
    that the rows bring as ``years_found`` are not looked for again.
    """
    w = fv.JOINABILITY_WEIGHTS
    no_years = F.col("year_min").isNull() | F.col("year_max").isNull()

    def share(matched: str, fields: str, weight: float) -> Column:
        size = F.size(fields)
        return F.when(size > 0, F.least(F.size(matched) / size, F.lit(1.0)) * weight).otherwise(0.0)

    if "years_found" not in rows.columns:
        rows = rows.withColumn("years_found", extract_years(F.col("_text")))
    return (
        rows.withColumn("matched_join_fields", matched_fields(F.col("join_fields"), F.col("_text")))
        .withColumn("matched_salient_columns", matched_fields(F.col("salient_columns"), F.col("_text")))
        .withColumn("has_year_overlap", F.when(no_years, F.lit(False)).otherwise(year_overlap(
            F.col("years_found"), F.col("_text"), F.col("year_min"), F.col("year_max"))))
        .withColumn("joinability_score", score4(
            share("matched_join_fields", "join_fields", w["join"])
            + share("matched_salient_columns", "salient_columns", w["salient"])
            + F.when(F.col("has_year_overlap"), w["year"]).otherwise(0.0)))
    )


JOINABILITY = ["matched_join_fields", "matched_salient_columns", "years_found", "has_year_overlap",
               "joinability_score"]


def overall() -> Column:
    w = fv.OVERALL_WEIGHTS
    return score4(w["relevance"] * F.col("relevance_score") + w["joinability"] * F.col("joinability_score")
                  + w["completeness"] * F.col("metadata_completeness_score"))


def finalize(found: DataFrame, candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """All scores of found candidates.

    ``found``: seed_id, query, entry_id and any keys. ``candidates``: entry_id and the
    candidate columns. ``fields``: per seed join_fields, salient_columns, year_min, year_max.
    Texts are read once per (query text, entry) and once per (seed, entry), however many
    queries and seeds share them; years are looked for once per entry that was found. Seeds and entries are shuffled to what was found, never sent
    through the driver; texts come first, as rows with a seed's fields are the widest.
    """
    wanted = found.select("entry_id").distinct().hint("merge")
    texts = candidates.select("entry_id", searchable_text().alias("_text")).join(wanted, "entry_id", "left_semi").hint("merge")
    dated = texts.withColumn("years_found", extract_years(F.col("_text"))).hint("merge")
    relevance = found.select("query", "entry_id").distinct().join(texts, "entry_id").select(
        "query", "entry_id", token_overlap(F.col("query"), F.col("_text")).alias("relevance_score"))
    per_seed = fields.withColumns({c: field_tokens(F.col(c)) for c in ("join_fields", "salient_columns")})
    joinability = with_joinability(
        found.select("seed_id", "entry_id").distinct().join(dated, "entry_id").join(per_seed.hint("merge"), "seed_id")
    ).select("seed_id", "entry_id", *JOINABILITY)
    described = candidates.withColumn("metadata_completeness_score", completeness())
    return (
        salted_join(found, relevance, ["query", "entry_id"], F.col("seed_id"))
        .join(joinability.hint("merge"), ["seed_id", "entry_id"])
        .join(described.hint("merge"), "entry_id").withColumn("overall_score", overall())
    )


def join_fields(signature: DataFrame) -> DataFrame:
    """The signature columns that scoring needs."""
    return signature.select(
        "seed_id", F.concat("candidate_identifiers", "entity_like_columns").alias("join_fields"),
        F.col("salient_column_names").alias("salient_columns"), "year_min", "year_max")


def route(queries: DataFrame, max_queries: int = fv.MAX_QUERIES) -> DataFrame:
    """The queries that are sent, whatever their connector."""
    return queries.filter(F.col("id") <= max_queries)


def run_plan(queries: DataFrame, max_queries: int = fv.MAX_QUERIES) -> DataFrame:
    return route(queries, max_queries).select(
        "seed_id", F.col("id").alias("query_id"), "query",
        F.col("target_connector").alias("connector"), "strategy")


def connector_counts(queries: DataFrame, max_queries: int = fv.MAX_QUERIES) -> DataFrame:
    return run_plan(queries, max_queries).groupBy("seed_id", "connector").agg(
        F.count(F.lit(1)).alias("n"))


def landed_answers(queries: DataFrame, landed: DataFrame, max_queries: int = fv.MAX_QUERIES,
                   limit: int = fv.PER_QUERY_LIMIT) -> DataFrame:
    """Queries with the candidates landed for them, ``limit`` per query and source."""
    sent = run_plan(queries, max_queries).filter(F.col("connector").isin(fv.REACHABLE_CONNECTORS))
    hits = landed.filter(F.col("pos") <= limit)
    return salted_join(sent, hits, ["connector", "query"], F.col("seed_id"))


def answers_met(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """Queries beside what was landed for their connector and text; equal texts of many seeds meet it in many tasks."""
    own = sent.withColumnRenamed("target_connector", "connector").filter(F.col("connector").isin(fv.REACHABLE_CONNECTORS))
    return salted_join(own, answers, ["connector", "query"], F.col("seed_id"))


def sorted_results(rows: DataFrame, dedupe: bool = False) -> DataFrame:
    """Non-error rows with their position by overall score, ties in found order.

    ``rows``: seed_id, query_id, pos, is_error, overall_score. ``dedupe`` keeps each
    dataset's best row per seed.
    """
    ok = rows.filter(~F.coalesce("is_error", F.lit(False)))
    best = [F.desc("overall_score"), F.asc("query_id"), F.asc("pos")]
    if dedupe:
        ok = top_k(ok, ["seed_id", "connector", "source_name", "dataset_id"], best, 1, "_rn").drop("_rn")
    return with_position(ok, ["seed_id"], best, "position")


def result_totals(rows: DataFrame) -> DataFrame:
    bad = F.coalesce("is_error", F.lit(False))
    return rows.groupBy("seed_id").agg(
        F.count_if(~bad).alias("total_candidates"), F.count_if(bad).alias("total_errors"))
