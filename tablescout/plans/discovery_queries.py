"""Registered queries of discovery, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions import text as tx
from tablescout.operators import discovery as di
from tablescout.operators import evaluate as ev
from tablescout.operators import ranking as rk
from tablescout.plans import querygen_queries as qq
from tablescout.plans.inputs import lits, table

QUERIES, ORACLES = {}, {}

# Catalog: every document is an entry. Queries: every benchmark text, five seeds.
JOIN_FIELDS = ["the_id", "und_code", "tion", "id"]
SALIENT = ["heren", "les_key", "eau_name", "country_code"]


def _catalog(s, sf):
    return table(s, sf, "documents").selectExpr(
        "cast(doc_id as string) AS dataset_id", "doc_id AS entry_id", "0 AS catalog_pos",
        "doc_id AS entry_pos", "source AS source_name",
        "concat(source, ' ', 1990 + doc_id % 40) AS title", "text AS description",
        "array(lang) AS keywords", "cast(array() AS array<string>) AS field_names",
        "CASE WHEN doc_id % 3 > 0 THEN concat('http://example.org/', doc_id) END AS landing_page",
        "CASE WHEN doc_id % 4 > 0 THEN array(concat('http://example.org/', doc_id, '.csv')) END AS download_urls",
        "concat_ws(' ', source, 1990 + doc_id % 40, text, lang) AS text")


def _queries(s, sf):
    return table(s, sf, "benchmark").selectExpr(
        "item_id % 5 AS seed_id", "item_id AS query_id", "text AS query",
        "cast(item_id % 5 + 1 AS int) AS priority", "'benchmark' AS strategy")


def _found(s, sf):
    return di.catalog_search(_queries(s, sf), _catalog(s, sf))


def _scored(s, sf):
    fields = table(s, sf, "benchmark").select((F.col("item_id") % 5).alias("seed_id")).distinct().withColumns({
        "join_fields": F.array(*map(F.lit, JOIN_FIELDS)), "salient_columns": F.array(*map(F.lit, SALIENT)),
        "year_min": F.lit(2000), "year_max": F.lit(2010)})
    return di.finalize(_found(s, sf).drop("score"), _catalog(s, sf).drop("text", "catalog_pos", "entry_pos"), fields)


def _tok(e):
    return (f"list_filter(string_split(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda w: len(w) > 2)")


_YEARS = ("list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({e}, "
          "'\\b(19\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b', 1), lambda y: y::INT), "
          "lambda y: y BETWEEN 1900 AND 2100)))")


def years_sql(e):
    return _YEARS.format(e=e)


CATALOG_SQL = """catalog AS (SELECT doc_id AS entry_id, doc_id::VARCHAR AS dataset_id, source AS source_name,
  source || ' ' || (1990 + doc_id % 40) AS title, text AS description, [lang] AS keywords,
  CASE WHEN doc_id % 3 > 0 THEN 'http://example.org/' || doc_id END AS landing_page,
  CASE WHEN doc_id % 4 > 0 THEN ['http://example.org/' || doc_id || '.csv'] END AS download_urls,
  source || ' ' || (1990 + doc_id % 40) || ' ' || text || ' ' || lang AS text FROM documents)"""
SEARCH_SQL = f"""{CATALOG_SQL},
  asked AS (SELECT item_id, list_distinct({_tok("text")}) AS toks FROM benchmark),
  qt AS (SELECT item_id, len(toks) AS m, unnest(toks) AS token FROM asked),
  dt AS (SELECT entry_id, unnest(list_distinct({_tok("text")})) AS token FROM catalog),
  pairs AS (SELECT item_id, entry_id, round(count(*) / max(m), 4) AS score FROM qt JOIN dt USING (token) GROUP BY 1, 2),
  found AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, entry_id)::INT AS pos FROM pairs
    QUALIFY pos <= 5)"""


def _match_sql(fields, text):
    parts = []
    for f in fields:
        toks = [t for t in f.replace("_", " ").split() if len(t) > 2]
        cond = " AND ".join(f"contains({text}, '{t}')" for t in toks) or "true"
        parts.append(f"CASE WHEN {cond} THEN '{f}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


SCORED_SQL = f"""{SEARCH_SQL},
  base AS (SELECT item_id % 5 AS seed_id, item_id AS query_id, pos, score AS relevance_score, c.*,
    (item_id % 5 + 1)::INT AS priority, lower(c.text) AS hay,
    round((1 + 1 + 1 + 1 + CASE WHEN landing_page IS NULL THEN 0 ELSE 1 END
      + CASE WHEN download_urls IS NULL THEN 0 ELSE 1 END) / 6, 4) AS metadata_completeness_score
    FROM found JOIN catalog c USING (entry_id)),
  matched AS (SELECT *, {_match_sql(JOIN_FIELDS, "hay")} AS mj, {_match_sql(SALIENT, "hay")} AS ms,
    {years_sql("hay")} AS years FROM base),
  over AS (SELECT *, len(list_filter(years, lambda y: y BETWEEN 2000 AND 2010)) > 0 OR contains(hay, 'year') AS has_year_overlap FROM matched),
  joinable AS (SELECT *, round((least(len(mj) / {len(JOIN_FIELDS)}, 1) * 0.6::DOUBLE + least(len(ms) / {len(SALIENT)}, 1) * 0.25::DOUBLE
    + CASE WHEN has_year_overlap THEN 0.15::DOUBLE ELSE 0 END)::DECIMAL(18, 10), 4)::DOUBLE AS joinability_score FROM over),
  scored AS (SELECT *, round((0.55::DOUBLE * relevance_score + 0.30::DOUBLE * joinability_score
    + 0.15::DOUBLE * metadata_completeness_score)::DECIMAL(18, 10), 4)::DOUBLE AS overall_score FROM joinable)"""

QUERIES["disc_slug_tokens"] = lambda s, sf: table(s, sf, "documents").select(
    "doc_id", F.array_join(tx.slug_tokens(F.col("text")), "|").alias("tokens"))
ORACLES["disc_slug_tokens"] = f"""SELECT doc_id, coalesce(list_aggregate({_tok("text")}, 'string_agg', '|'), '') AS tokens FROM documents"""

QUERIES["disc_safe_text"] = lambda s, sf: table(s, sf, "documents").select("doc_id", tx.safe_text(
    F.col("source"), F.split("text", "\n"), F.array("lang", F.nullif("source", F.lit("web")))).alias("flat"))
ORACLES["disc_safe_text"] = """SELECT doc_id, concat_ws(' ', source, replace(text, chr(10), ' '), lang,
  nullif(source, 'web')) AS flat FROM documents"""

_YEAR_TEXT = "concat('y', year(o_orderdate), ' ', year(o_orderdate), '-', o_orderkey % 3000, ', ', o_custkey, ' ', 2100 + o_orderkey % 3)"
QUERIES["disc_extract_years"] = lambda s, sf: table(s, sf, "orders").select("o_orderkey", F.array_join(
    tx.extract_years(F.expr(_YEAR_TEXT)), "|").alias("years"))
ORACLES["disc_extract_years"] = f"""SELECT o_orderkey, coalesce(list_aggregate({years_sql(_YEAR_TEXT)},
  'string_agg', '|'), '') AS years FROM orders"""

# The score of each conversation turn against its role and against the whole turn before it.


def _overlaps(s, sf):
    turns = table(s, sf, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return turns.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", tx.token_overlap(F.col("role"), F.concat_ws(" ", "role", "text")).alias("with_role"),
        tx.token_overlap(F.coalesce("text", F.lit("")), F.coalesce("before", F.lit(""))).alias("score"))


QUERIES["disc_token_overlap"] = _overlaps
_Q, _H = "coalesce(a.text, '')", "coalesce(b.text, '')"
ORACLES["disc_token_overlap"] = f"""SELECT a.conv_id, a.turn,
  round(len(list_intersect(list_distinct({_tok("a.role")}), {_tok("a.role || ' ' || coalesce(a.text, '')")})) / len(list_distinct({_tok("a.role")})), 4) AS with_role,
  CASE WHEN len({_tok(_Q)}) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(list_distinct({_tok(_Q)}), {_tok(_H)}))
    / len(list_distinct({_tok(_Q)})), 4) END AS score
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1"""

QUERIES["disc_catalog_search"] = lambda s, sf: _found(s, sf).select("query_id", "entry_id", "score", "pos")
ORACLES["disc_catalog_search"] = f"WITH {SEARCH_SQL} SELECT item_id AS query_id, entry_id, score, pos FROM found"


# Year range: seeds are customers; those with two order years have a document range.
def _year_range(s, sf):
    o = table(s, sf, "orders").groupBy(F.col("o_custkey").alias("seed_id")).agg(
        F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"),
        F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1"))
    col = "named_struct('semantic_type', {t}, 'min', {a}, 'max', {b})"
    cols = F.expr("array(" + ", ".join([
        col.format(t="'numeric'", a="'1'", b="'9'"),
        col.format(t="'datetime'", a="cast(date(d0) as string)", b="cast(date(d1) as string)"),
        col.format(t="if(seed_id % 2 = 0, 'datetime', 'numeric')",
                   a="cast(year(d0) as string)", b="cast(year(d1) as string)")]) + ")")
    r = o.select("seed_id", di.year_range(F.col("years"), cols).alias("r"))
    return r.select("seed_id", "r.year_min", "r.year_max")


QUERIES["disc_year_range"] = _year_range
ORACLES["disc_year_range"] = """WITH o AS (SELECT o_custkey AS seed_id, count(DISTINCT year(o_orderdate)) AS n,
  min(year(o_orderdate))::INT AS a, max(year(o_orderdate))::INT AS b FROM orders GROUP BY 1)
  SELECT seed_id, CASE WHEN n = 2 OR seed_id % 2 = 0 THEN a END AS year_min,
    CASE WHEN n = 2 OR seed_id % 2 = 0 THEN b END AS year_max FROM o"""

QUERIES["disc_completeness"] = lambda s, sf: _catalog(s, sf).withColumn(
    "title", F.when(F.col("entry_id") % 5 > 0, F.col("title")).otherwise("")).select(
    "entry_id", di.completeness().alias("completeness"))
ORACLES["disc_completeness"] = f"""WITH {CATALOG_SQL} SELECT entry_id, round(
  (CASE WHEN entry_id % 5 > 0 THEN 1 ELSE 0 END + 1 + 1 + 1 + CASE WHEN landing_page IS NULL THEN 0 ELSE 1 END
   + CASE WHEN download_urls IS NULL THEN 0 ELSE 1 END) / 6, 4) AS completeness FROM catalog"""


def _all_fields(s, sf):
    return _catalog(s, sf).withColumn("hay", di.searchable_text())


QUERIES["disc_field_match"] = lambda s, sf: _all_fields(s, sf).select(
    "entry_id", F.array_join(di.matched_fields(di.field_tokens(F.array(*map(F.lit, JOIN_FIELDS + SALIENT))), F.col("hay")), "|").alias("matched"))
ORACLES["disc_field_match"] = f"""WITH {CATALOG_SQL} SELECT entry_id, coalesce(list_aggregate(
  {_match_sql(JOIN_FIELDS + SALIENT, "lower(text)")}, 'string_agg', '|'), '') AS matched FROM catalog"""

QUERIES["disc_year_overlap"] = lambda s, sf: _all_fields(s, sf).select("entry_id", di.year_overlap(
    tx.extract_years(F.col("hay")), F.col("hay"), F.lit(2000), F.lit(2010)).alias("has_year_overlap"))
ORACLES["disc_year_overlap"] = f"""WITH {CATALOG_SQL} SELECT entry_id,
  len(list_filter({years_sql("lower(text)")}, lambda y: y BETWEEN 2000 AND 2010)) > 0
  OR contains(lower(text), 'year') AS has_year_overlap FROM catalog"""

QUERIES["disc_joinability"] = lambda s, sf: _scored(s, sf).select(
    "query_id", "entry_id", "joinability_score", F.array_join("matched_join_fields", "|").alias("matched_join_fields"),
    F.array_join("matched_salient_columns", "|").alias("matched_salient_columns"),
    F.array_join("years_found", "|").alias("years_found"), "has_year_overlap")
ORACLES["disc_joinability"] = f"""WITH {SCORED_SQL} SELECT query_id, entry_id, joinability_score,
  coalesce(list_aggregate(mj, 'string_agg', '|'), '') AS matched_join_fields,
  coalesce(list_aggregate(ms, 'string_agg', '|'), '') AS matched_salient_columns,
  coalesce(list_aggregate(years, 'string_agg', '|'), '') AS years_found, has_year_overlap FROM scored"""
QUERIES["disc_overall"] = lambda s, sf: _scored(s, sf).select(
    "query_id", "entry_id", "relevance_score", "metadata_completeness_score", "overall_score")
ORACLES["disc_overall"] = f"""WITH {SCORED_SQL} SELECT query_id, entry_id, relevance_score,
  metadata_completeness_score, overall_score FROM scored"""

QUERIES["disc_plan"] = lambda s, sf: di.run_plan(qq._generated(s, sf))
ORACLES["disc_plan"] = f"""{qq.HEAD_SQL}, {qq._dedupe_sql(qq.NORMAL)} SELECT seed_id, id AS query_id, query,
  target_connector AS connector, strategy FROM numbered WHERE id <= 30"""
QUERIES["disc_connector_counts"] = lambda s, sf: di.connector_counts(qq._generated(s, sf))
ORACLES["disc_connector_counts"] = f"""{qq.HEAD_SQL}, {qq._dedupe_sql(qq.NORMAL)} SELECT seed_id,
  target_connector AS connector, count(*)::BIGINT AS n FROM numbered WHERE id <= 30 GROUP BY 1, 2"""


# Landed answers: parts answer for the connector and query text they hash to.
def _route(s, sf):
    queries = qq._generated(s, sf)
    texts = F.array(*[F.lit(f"{c} {t} country year dataset") for c in ("CKAN",) for t in sorted(
        k.replace("_", " ") for k in fv.CONCEPT_PATTERNS)])
    n = len(fv.CONCEPT_PATTERNS)
    landed = table(s, sf, "part").select(
        F.lit("CKAN").alias("connector"),
        F.element_at(texts, (F.col("p_partkey") % n + 1).cast("int")).alias("query"),
        (F.floor(F.col("p_partkey") / n) + 1).cast("int").alias("pos"),
        F.col("p_partkey").alias("entry_id"))
    return di.landed_answers(queries, landed).select("seed_id", "query_id", "connector", "query", "entry_id", "pos")


QUERIES["disc_route"] = _route
_TEXTS = lits([f"CKAN {k.replace('_', ' ')} country year dataset" for k in sorted(
    fv.CONCEPT_PATTERNS, key=lambda k: k.replace("_", " "))])
ORACLES["disc_route"] = f"""{qq.HEAD_SQL}, {qq._dedupe_sql(qq.NORMAL)},
  landed AS (SELECT 'CKAN' AS connector, list_extract({_TEXTS}, (p_partkey % 9 + 1)::INT) AS query,
    (p_partkey // 9 + 1)::INT AS pos, p_partkey AS entry_id FROM part)
  SELECT seed_id, id AS query_id, connector, query, entry_id, landed.pos FROM numbered JOIN landed USING (query)
  WHERE id <= 30 AND landed.pos <= 5 AND target_connector = connector"""

# Results: events are found rows, some of them errors; a user is a seed.
QUERIES["disc_results"] = lambda s, sf: di.sorted_results(table(s, sf, "events").selectExpr(
    "user_id % 20 AS seed_id", "event_id AS query_id", "1 AS pos", "event_type = 'error' AS is_error",
    "round(least(value, 100) / 100, 4) AS overall_score", "event_type AS connector")).select(
    "seed_id", "query_id", "overall_score", "position")
ORACLES["disc_results"] = """SELECT user_id % 20 AS seed_id, event_id AS query_id, round(least(value, 100) / 100, 4) AS overall_score,
  row_number() OVER (PARTITION BY user_id % 20 ORDER BY round(least(value, 100) / 100, 4) DESC, event_id) AS position
  FROM events WHERE event_type <> 'error'"""

QUERIES["disc_result_totals"] = lambda s, sf: di.result_totals(table(s, sf, "events").selectExpr(
    "user_id % 20 AS seed_id", "event_type = 'error' AS is_error"))
ORACLES["disc_result_totals"] = """SELECT user_id % 20 AS seed_id, count(*) FILTER (event_type <> 'error') AS total_candidates,
  count(*) FILTER (event_type = 'error') AS total_errors FROM events GROUP BY 1"""

# Ranking and evaluation: a document source is a seed, its documents are candidates.
_CAND = {
    "seed_id": "source", "doc_id": "d.doc_id", "priority": "CASE WHEN d.doc_id % 6 > 0 THEN cast(d.doc_id % 6 AS int) END",
    "overall_score": "round(n_chars / (n_chars + 1500.0D), 4)",
    "relevance_score": "CASE WHEN d.doc_id % 13 > 0 THEN round((d.doc_id % 11) / 10.0D, 4) END",
    "joinability_score": "round((n_chars % 100) / 100.0D, 4)",
    "metadata_completeness_score": "round((d.doc_id % 7) / 6.0D, 4)",
}


def _cands(s, sf):
    d = table(s, sf, "documents").alias("d").join(table(s, sf, "labels").alias("l"), "doc_id", "left")
    return d.selectExpr(*[f"{e} AS {c}" for c, e in _CAND.items()],
                        "CASE WHEN quality = 1 THEN array(lang) ELSE cast(array() AS array<string>) END AS matched_salient_columns",
                        "lang AS connector")


CANDS_SQL = "cands AS (SELECT " + ", ".join(
    f"{e.replace('0D', '0::DOUBLE')} AS {c}" for c, e in _CAND.items()) + """,
  coalesce(quality = 1, false) AS salient, lang AS connector FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  marked AS (SELECT *, coalesce(priority IN (1, 2) AND coalesce(relevance_score, 0) >= 0.8::DOUBLE
    AND metadata_completeness_score >= 0.8::DOUBLE, false) AS removed,
    salient AND overall_score >= 0.55::DOUBLE AS rel FROM cands),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY overall_score DESC, coalesce(relevance_score, 0) DESC,
    joinability_score DESC, metadata_completeness_score DESC, doc_id) AS rank FROM marked WHERE NOT removed)"""


def _ranked(s, sf):
    return rk.rank(rk.keep(_cands(s, sf)), ["doc_id"])


def _judged(s, sf):
    return ev.judged(_ranked(s, sf))


QUERIES["rank_filter"] = lambda s, sf: rk.keep(_cands(s, sf)).select("seed_id", "doc_id")
ORACLES["rank_filter"] = f"WITH {CANDS_SQL} SELECT seed_id, doc_id FROM marked WHERE NOT removed"
QUERIES["rank_order"] = lambda s, sf: _ranked(s, sf).select("seed_id", "doc_id", "overall_score", "rank")
ORACLES["rank_order"] = f"WITH {CANDS_SQL} SELECT seed_id, doc_id, overall_score, rank FROM ranked"
QUERIES["rank_counts"] = lambda s, sf: rk.counts(_cands(s, sf))
ORACLES["rank_counts"] = f"""WITH {CANDS_SQL} SELECT seed_id, count(*) FILTER (NOT removed) AS filtered_candidates,
  count(*) FILTER (removed) AS removed_candidates FROM marked GROUP BY 1"""

QUERIES["eval_relevant"] = lambda s, sf: _cands(s, sf).select("doc_id", ev.relevant().alias("rel"))
ORACLES["eval_relevant"] = f"WITH {CANDS_SQL} SELECT doc_id, rel FROM marked"
QUERIES["eval_precision_at_k"] = lambda s, sf: ev.precision_at_k(_judged(s, sf))
_KS = "(VALUES (5), (10), (20)) ks(k)"
ORACLES["eval_precision_at_k"] = f"""WITH {CANDS_SQL} SELECT seed_id, k::INT AS k, round(avg(rel::INT), 4) AS precision
  FROM ranked, {_KS} WHERE rank <= k GROUP BY 1, 2"""
_AP_SQL = """hits AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS hit FROM ranked WHERE rel),
  ap AS (SELECT seed_id, round(coalesce(ap, 0), 4) AS average_precision FROM (SELECT DISTINCT seed_id FROM ranked)
    LEFT JOIN (SELECT seed_id, avg(hit / rank) AS ap FROM hits GROUP BY 1) USING (seed_id))"""
QUERIES["eval_average_precision"] = lambda s, sf: ev.average_precision(_judged(s, sf))
ORACLES["eval_average_precision"] = f"WITH {CANDS_SQL}, {_AP_SQL} SELECT * FROM ap"
QUERIES["eval_map"] = lambda s, sf: ev.mean_average_precision(_judged(s, sf))
ORACLES["eval_map"] = f"WITH {CANDS_SQL}, {_AP_SQL} SELECT round(avg(average_precision), 4) AS map FROM ap"
QUERIES["eval_ndcg_at_k"] = lambda s, sf: ev.ndcg_at_k(_judged(s, sf))
ORACLES["eval_ndcg_at_k"] = f"""WITH {CANDS_SQL}, n AS (SELECT seed_id, count(*) FILTER (rel) AS n_rel FROM ranked GROUP BY 1),
  dcg AS (SELECT seed_id, k::INT AS k, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM ranked, {_KS}
    WHERE rank <= k GROUP BY 1, 2)
  SELECT seed_id, k, CASE WHEN n_rel = 0 THEN 0.0::DOUBLE ELSE round(dcg / list_sum(list_transform(
    range(1, least(k, n_rel) + 1), lambda i: 1 / log2(i + 1))), 4) END AS ndcg FROM dcg JOIN n USING (seed_id)"""
QUERIES["eval_score_range"] = lambda s, sf: ev.score_range(_judged(s, sf))
ORACLES["eval_score_range"] = f"""WITH {CANDS_SQL} SELECT seed_id, count(*) AS total_candidates,
  count(*) FILTER (rel) AS relevant_count, round(min(overall_score), 4) AS score_min,
  round(max(overall_score), 4) AS score_max, round(avg(overall_score), 4) AS score_mean FROM ranked GROUP BY 1"""

# Integration outcomes: every order is an attempted candidate of its customer's nation.
_STATUS = """CASE o_orderstatus WHEN 'F' THEN 'integrated' WHEN 'O' THEN
  CASE WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'no_join_keys' END ELSE 'join_failed' END"""
_REASON = """CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN
  CASE WHEN o_orderkey % 4 = 0 THEN 'no download URLs' ELSE '' END END"""


def _statuses(s, sf):
    return table(s, sf, "orders").selectExpr(
        "o_custkey % 25 AS seed_id", f"{_STATUS} AS status", f"{_REASON} AS skip_reason",
        "nullif(o_orderpriority, '5-LOW') AS connector", "o_orderkey")


STATUS_SQL = f"""st AS (SELECT o_custkey % 25 AS seed_id, {_STATUS} AS status, {_REASON} AS skip_reason,
  nullif(o_orderpriority, '5-LOW') AS connector FROM orders)"""
_RATES_SQL = f"""{STATUS_SQL}, c AS (SELECT seed_id, count(*) AS candidates_eligible,
    count(*) FILTER (status = 'integrated') AS candidates_joined, count(*) FILTER (status = 'skipped') AS candidates_skipped,
    count(*) FILTER (status = 'no_join_keys') AS candidates_no_join_keys,
    count(*) FILTER (status = 'join_failed') AS candidates_failed FROM st GROUP BY 1),
  rates AS (SELECT *, candidates_eligible - candidates_skipped AS candidates_downloaded,
    round(candidates_joined / candidates_eligible, 4) AS join_success_rate,
    round((candidates_eligible - candidates_skipped) / candidates_eligible, 4) AS download_success_rate FROM c)"""
QUERIES["eval_integration_rates"] = lambda s, sf: ev.integration_rates(_statuses(s, sf))
ORACLES["eval_integration_rates"] = f"WITH {_RATES_SQL} SELECT * FROM rates"
QUERIES["eval_skip_breakdown"] = lambda s, sf: ev.skip_breakdown(_statuses(s, sf))
ORACLES["eval_skip_breakdown"] = f"""WITH {STATUS_SQL} SELECT seed_id, coalesce(nullif(skip_reason, ''), status) AS reason,
  count(*) AS n FROM st GROUP BY 1, 2"""
QUERIES["eval_connector_breakdown"] = lambda s, sf: ev.connector_breakdown(_statuses(s, sf))
ORACLES["eval_connector_breakdown"] = f"""WITH {STATUS_SQL} SELECT seed_id, coalesce(connector, 'unknown') AS connector,
  count(*) AS n FROM st GROUP BY 1, 2"""


# Completeness: customers of a nation before, the same plus suppliers' balance after.
def _augment(s, sf):
    o = table(s, sf, "orders").selectExpr(
        "o_custkey % 25 AS seed_id", "nullif(o_orderstatus, 'F') AS a",
        "nullif(o_orderpriority, '5-LOW') AS b", "CASE WHEN o_orderkey % 3 > 0 THEN 1 END AS c")

    def comp(cols):
        share = [F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols]
        return o.groupBy("seed_id").agg(*share).unpivot("seed_id", cols, "name", "completeness")
    cover = o.groupBy("seed_id").agg(F.lit(4).cast("bigint").alias("seed_columns"),
                                     F.countDistinct("b").alias("new_columns"))
    return ev.augmentation_metrics(cover, comp(["a", "b"]), comp(["a", "b", "c"]))


QUERIES["eval_augmentation"] = _augment
_AUG_SQL = """o AS (SELECT o_custkey % 25 AS seed_id, nullif(o_orderstatus, 'F') AS a, nullif(o_orderpriority, '5-LOW') AS b,
    CASE WHEN o_orderkey % 3 > 0 THEN 1 END AS c FROM orders),
  g AS (SELECT seed_id, 4::BIGINT AS seed_columns, count(DISTINCT b)::BIGINT AS new_columns,
    round((count(a) / count(*) + count(b) / count(*)) / 2, 4) AS avg_completeness_before,
    round((count(a) / count(*) + count(b) / count(*) + count(c) / count(*)) / 3, 4) AS avg_completeness_after
    FROM o GROUP BY 1),
  aug AS (SELECT *, round(new_columns / seed_columns, 4) AS coverage_gain,
    round(avg_completeness_after - avg_completeness_before, 4) AS completeness_gain FROM g)"""
ORACLES["eval_augmentation"] = f"WITH {_AUG_SQL} SELECT * FROM aug"


def _findings(s, sf):
    p10 = _judged(s, sf)
    one = ev.integration_rates(_statuses(s, sf)).join(_augment(s, sf), "seed_id")
    # The seeds of the two inputs pair up by number: sources in order, nations by key.
    lists = ev.precision_at_k(p10, [10]).select(
        (F.ascii("seed_id") % 25).cast("bigint").alias("seed_id"), F.col("precision").alias("precision_at_10"))
    lists = lists.groupBy("seed_id").agg(F.max("precision_at_10").alias("precision_at_10"))
    out = ev.findings(one.join(lists, "seed_id", "left"))
    return out.select("seed_id", F.array_join("findings", "|").alias("findings"),
                      F.array_join("recommendations", "|").alias("recommendations"))


def q(name):
    """A message as an SQL expression with its numbers filled in."""
    text = "'" + fv.MESSAGES[name].replace("'", "''") + "'"
    for slot, expr in (("{p10}", "p10::VARCHAR"), ("{download}", "round(dl * 100, 0)::INT::VARCHAR"),
                       ("{gain}", "round(cg * 100, 0)::INT::VARCHAR"), ("{columns}", "new_columns::VARCHAR"),
                       ("{downloaded}", "candidates_downloaded::VARCHAR")):
        text = f"replace({text}, '{slot}', {expr})"
    return text


QUERIES["eval_findings"] = _findings
ORACLES["eval_findings"] = f"""WITH {CANDS_SQL}, {_RATES_SQL}, {_AUG_SQL},
  p AS (SELECT seed_id, round(avg(rel::INT), 4) AS p FROM ranked WHERE rank <= 10 GROUP BY 1),
  p10 AS (SELECT (ascii(seed_id) % 25)::BIGINT AS seed_id, max(p) AS p10 FROM p GROUP BY 1),
  m AS (SELECT seed_id, coalesce(p10, 0) AS p10, download_success_rate AS dl, join_success_rate AS jr, coverage_gain AS cg,
    new_columns, candidates_downloaded FROM rates JOIN aug USING (seed_id) LEFT JOIN p10 USING (seed_id))
  SELECT seed_id, array_to_string(list_filter([
    CASE WHEN p10 >= 0.5::DOUBLE THEN {q("retrieval_ok")} ELSE {q("retrieval_low")} END,
    CASE WHEN dl < 0.2::DOUBLE THEN {q("download_low")} END, CASE WHEN jr = 0 THEN {q("join_none")} END,
    CASE WHEN cg = 0 THEN {q("coverage_none")} ELSE {q("coverage")} END], lambda x: x IS NOT NULL), '|') AS findings,
    array_to_string(list_filter([CASE WHEN p10 < 0.5::DOUBLE THEN {q("advice_retrieval")} END,
      CASE WHEN dl < 0.2::DOUBLE THEN {q("advice_download")} END,
      CASE WHEN jr = 0 THEN {q("advice_join_1")} END, CASE WHEN jr = 0 THEN {q("advice_join_2")} END],
      lambda x: x IS NOT NULL), '|') AS recommendations FROM m"""
