"""Registered queries of matching and integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions.text import norm_col, norm_value, token_set_ratio
from tablescout.operators import entities as en
from tablescout.operators import integrate as it
from tablescout.operators import matching as ma
from tablescout.plans import discovery_queries as dq
from tablescout.plans.inputs import COLUMN_NAMES, SIGNATURES_SQL, lits, signatures, table, values
from tablescout.session import cut

QUERIES, ORACLES = {}, {}


def ratio_sql(pairs: str, out: str) -> str:
    """WITH parts that add ``score`` to the table ``pairs`` of texts (a, b)."""
    def words(c):
        return f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"

    def joined(e):
        return f"coalesce(list_aggregate(list_sort({e}), 'string_agg', ' '), '')"
    return f"""{out}_w AS (SELECT DISTINCT a, b, {words("a")} AS ta, {words("b")} AS tb FROM {pairs}),
  {out}_p AS (SELECT a, b, len(ta) AS na, len(tb) AS nb, len(list_intersect(ta, tb)) AS nboth,
    len({joined("list_intersect(ta, tb)")}) AS sect,
    {joined("list_filter(ta, lambda w: NOT list_contains(tb, w))")} AS ab,
    {joined("list_filter(tb, lambda w: NOT list_contains(ta, w))")} AS ba FROM {out}_w),
  {out}_l AS (SELECT *, CASE WHEN sect > 0 THEN 1 ELSE 0 END AS gap, len(ab) AS la, len(ba) AS lb,
    list_last(list_reduce(list_filter(string_split(ab, ''), lambda c: c <> ''),
      lambda prow, ch: list_reduce(range(1, len(ba) + 1), lambda acc, j: list_append(acc,
        CASE WHEN substr(ba, j::INT, 1) = ch THEN prow[j] + 1 ELSE greatest(prow[j + 1], acc[j]) END), [0::BIGINT]),
      list_transform(range(0, len(ba) + 1), lambda z: 0::BIGINT))) AS lcs FROM {out}_p),
  {out} AS (SELECT a, b, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE WHEN nboth > 0 AND (la = 0 OR lb = 0) THEN 100.0::DOUBLE
    ELSE greatest(100.0::DOUBLE * (1 - (la + lb - 2 * lcs) / (2 * (sect + gap) + la + lb)),
      CASE WHEN sect > 0 THEN 100.0::DOUBLE * (1 - (gap + la) / (2 * sect + gap + la)) ELSE 0 END,
      CASE WHEN sect > 0 THEN 100.0::DOUBLE * (1 - (gap + lb) / (2 * sect + gap + lb)) ELSE 0 END) END AS score FROM {out}_l)"""


def norm_col_sql(e):
    return f"trim(regexp_replace(lower({e}), '[\\s_\\-.]+', ' ', 'g'))"


def norm_value_sql(e):
    return f"trim(regexp_replace(lower(coalesce({e}, '')), '\\s+', ' ', 'g'))"


# --- Text and URLs -----------------------------------------------------------------
_NAME = "concat(' ', upper(p_name), '__', p_brand, '-.', p_type, '. ')"
QUERIES["int_norm_col"] = lambda s, sf: table(s, sf, "part").select(
    "p_partkey", norm_col(F.expr(_NAME)).alias("norm"))
ORACLES["int_norm_col"] = f"SELECT p_partkey, {norm_col_sql(_NAME)} AS norm FROM part"
_VALUE = "CASE WHEN c_custkey % 9 > 0 THEN concat('  ', c_name, chr(9), ' ', chr(10), c_mktsegment, '  ') END"
QUERIES["int_norm_value"] = lambda s, sf: table(s, sf, "customer").select(
    "c_custkey", norm_value(F.expr(_VALUE)).alias("norm"))
ORACLES["int_norm_value"] = f"SELECT c_custkey, {norm_value_sql(_VALUE)} AS norm FROM customer"


def _ratio(s, sf):
    p = table(s, sf, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(token_set_ratio(
        F.lower(F.concat_ws(" ", "p_name", "p_brand")),
        F.lower(F.concat_ws(" ", "p_type", "n", "p_brand"))), 4).alias("score"))


QUERIES["int_token_set_ratio"] = _ratio
ORACLES["int_token_set_ratio"] = f"""WITH rows AS (SELECT p.p_partkey, lower(p.p_name || ' ' || p.p_brand) AS a,
    lower(p.p_type || ' ' || n.p_name || ' ' || p.p_brand) AS b FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1),
  {ratio_sql("rows", "tsr")} SELECT p_partkey, round(score, 4) AS score FROM rows JOIN tsr USING (a, b)"""

_ENDS = ["", ".csv", ".PDF", "/data.tsv.gz", "/api/list", "/wms/map.json", "/a.b/", "/x.html#top", "/file.zip;v=1"]
_URL = (f"concat(regexp_replace(url, '[?].*$', ''), element_at(array({', '.join(repr(e) for e in _ENDS)}), "
        f"cast(page_id % {len(_ENDS)} + 1 as int)), CASE WHEN page_id % 4 = 0 THEN '?a=1' ELSE '' END)")
QUERIES["int_url_class"] = lambda s, sf: table(s, sf, "pages").select("page_id", F.expr(_URL).alias("u")).select(
    "page_id", ma.url_extension(F.col("u")).alias("ext"), ma.is_api_url(F.col("u")).alias("is_api"),
    ma.url_skip_reason(F.col("u")).alias("skip_reason"),
    ma.content_skip_reason(F.when(F.col("page_id") % 3 == 0, F.lit("text/HTML")).otherwise("text/csv"),
                           F.col("page_id") * 100000).alias("content_reason"))
_URL_SQL = (f"regexp_replace(url, '[?].*$', '') || list_extract({lits(_ENDS)}, (page_id % {len(_ENDS)} + 1)::INT)"
            " || CASE WHEN page_id % 4 = 0 THEN '?a=1' ELSE '' END")
ORACLES["int_url_class"] = f"""WITH u AS (SELECT page_id, {_URL_SQL} AS u FROM pages),
  e AS (SELECT *, lower(regexp_extract(regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''),
      '^[A-Za-z]+://[^/]*', ''), ';[^/]*$', ''), '[^/](\\.[^./]+)/*$', 1)) AS ext,
    contains(regexp_replace(u, '#.*$', ''), '?') OR {" OR ".join(f"contains(lower(u), '{w}')" for w in fv.API_WORDS)} AS is_api FROM u)
  SELECT page_id, ext, is_api, CASE WHEN list_contains({lits(fv.SKIP_EXT)}, ext) THEN 'skipped non-tabular extension: ' || ext
    WHEN is_api AND NOT list_contains({lits(fv.TABULAR_EXT + fv.ARCHIVE_EXT)}, ext) THEN 'skipped API/service URL' END AS skip_reason,
    CASE WHEN page_id % 3 = 0 THEN 'skipped content-type: text/html'
      WHEN page_id * 100000 > 10485760 THEN 'skipped: file exceeds 10 MB' END AS content_reason FROM e"""

QUERIES["int_eligible_topk"] = lambda s, sf: ma.eligible(dq._ranked(s, sf), 0.3).select(
    "seed_id", "doc_id", "index")
ORACLES["int_eligible_topk"] = f"""WITH {dq.CANDS_SQL}, ok AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY rank)::INT AS index
  FROM ranked WHERE overall_score >= 0.3::DOUBLE) SELECT seed_id, doc_id, index FROM ok WHERE index <= 50"""

# --- Planning: customers are seeds, their orders are candidate datasets -------------------
CAND_NAMES = ["Country", "ISO Code", "Year", "gdp usd", "Population Total", "life-expectancy",
              "Region Name", "Income", "currency.code", "sku", "sector name", "rainfall_mm", "rank",
              "notes text", "Country Name", "score", "value", "hospital beds", "employees"]
_CAND_NAME = f"element_at(array({', '.join(repr(c) for c in CAND_NAMES)}), cast(l_partkey % {len(CAND_NAMES)} + 1 as int))"
_CAND_VALUE = ("CASE WHEN l_linenumber % 2 = 0 THEN concat(' ', lower(o_orderpriority)) "
               "WHEN l_linenumber % 3 = 0 THEN o_orderpriority ELSE l_returnflag END")


def _lines(s, sf):
    o = table(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("seed_id"),
                                      "o_orderpriority")
    return table(s, sf, "lineitem").join(o, "l_orderkey").selectExpr(
        "seed_id", "l_orderkey AS dataset_id", "l_linenumber", f"{_CAND_NAME} AS col", f"{_CAND_VALUE} AS value")


def _cand_cols(s, sf):
    """The candidate columns as the table that opening the candidates leaves behind; several steps read it."""
    return cut(_lines(s, sf).groupBy("seed_id", "dataset_id", "col").agg(F.min("l_linenumber").alias("cand_pos")), "cand-cols")


def _cand_pos(df):
    """A total order of the columns: the first line, then the name."""
    return df.withColumn("cand_pos", F.struct("cand_pos", "col"))


def _seed_cols(s, sf):
    return signatures(s, sf).select("seed_id", "columns")


def _priority(s, sf):
    sig = signatures(s, sf)
    years = F.filter("columns", lambda c: c == "year")
    ents = F.filter("columns", lambda c: c.isin("country_name", "region"))
    return sig.select("seed_id", ma.priority_keys(F.col("identifiers"), years, ents).alias("columns"))


def _mapping(s, sf, cols=None):
    return ma.match_columns(_seed_cols(s, sf), _cand_pos(cols if cols is not None else _cand_cols(s, sf)))


def _pairs(s, sf, cols=None):
    return ma.match_columns(_priority(s, sf), _cand_pos(cols if cols is not None else _cand_cols(s, sf))).select(
        "seed_id", "dataset_id", "col", "seed_col")


def _seed_values(s, sf):
    name = F.element_at(F.array(*[F.lit(c) for c in COLUMN_NAMES]),
                        (F.col("o_orderkey") % len(COLUMN_NAMES) + 1).cast("int"))
    return table(s, sf, "orders").select(
        F.col("o_custkey").alias("seed_id"), name.alias("seed_col"), F.col("o_orderpriority").alias("value"))


def _overlaps(s, sf, cols=None):
    return ma.value_overlap(cut(_pairs(s, sf, cols), "pairs"), _seed_values(s, sf), _lines(s, sf).select("dataset_id", "col", "value"))


def _keys(s, sf, cols=None):
    """The key verdicts as the table that planning leaves behind."""
    return cut(ma.join_keys(_overlaps(s, sf, cols)), "keys")


def _new(s, sf, keys=None, cols=None):
    cols = cols if cols is not None else _cand_cols(s, sf)
    keys = keys if keys is not None else _keys(s, sf, cols)
    return ma.new_attributes(_cand_pos(cols), keys.filter("is_key"), _mapping(s, sf, cols), _seed_cols(s, sf))


def _owned(s, sf, keys=None, cols=None):
    cols = cols if cols is not None else _cand_cols(s, sf)
    keys = keys if keys is not None else _keys(s, sf, cols)
    keyed = keys.filter("is_key").select("seed_id", "dataset_id").distinct()
    return ma.first_owner(_new(s, sf, keys, cols).join(keyed, ["seed_id", "dataset_id"], "left_semi").withColumn(
        "rank", F.col("dataset_id")))


def _statuses(s, sf):
    cands = table(s, sf, "orders").selectExpr(
        "o_custkey AS seed_id", "o_orderkey AS dataset_id", "o_orderkey % 6 AS n_urls",
        "CASE WHEN o_orderstatus <> 'P' THEN concat('http://example.org/', o_orderkey, '.csv') END AS usable_url")
    cols = _cand_cols(s, sf)
    keys = _keys(s, sf, cols)
    return ma.statuses(cands, keys, _owned(s, sf, keys, cols))


_CN_SQL = f"list_extract({lits(CAND_NAMES)}, (l_partkey % {len(CAND_NAMES)} + 1)::INT)"
LINES_SQL = f"""lines AS (SELECT o_custkey AS seed_id, l_orderkey AS dataset_id, l_linenumber, {_CN_SQL} AS col,
    {_CAND_VALUE} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  cand_cols AS (SELECT seed_id, dataset_id, col, min(l_linenumber) AS cand_pos FROM lines GROUP BY 1, 2, 3)"""
PRIORITY_SQL = """prio AS (SELECT seed_id, list_distinct_ordered AS columns FROM (SELECT seed_id,
    list_concat(identifiers, list_concat(list_filter(columns, lambda c: c = 'year' AND NOT list_contains(identifiers, c)),
      list_filter(columns, lambda c: c IN ('country_name', 'region') AND NOT list_contains(identifiers, c)))) AS list_distinct_ordered FROM sig))"""
_NAME_PAIRS = f"""name_pairs AS (SELECT c.col, s.seed_col, {norm_col_sql("c.col")} AS a, {norm_col_sql("s.seed_col")} AS b
    FROM {values([(c,) for c in CAND_NAMES])} c(col), {values([(c,) for c in COLUMN_NAMES])} s(seed_col)),
  {ratio_sql("name_pairs", "tsr")},
  name_scores AS (SELECT col, seed_col, round(score, 6) AS score FROM name_pairs JOIN tsr USING (a, b) WHERE score >= 60)"""


def _mapping_sql(source, out):
    return f"""{out}_all AS (SELECT seed_id, unnest(columns) AS seed_col, unnest(range(len(columns))) AS sp FROM {source}),
  {out}_best AS (SELECT c.*, seed_col, score FROM cand_cols c JOIN {out}_all USING (seed_id) JOIN name_scores n USING (col, seed_col)
    QUALIFY row_number() OVER (PARTITION BY seed_id, dataset_id, col ORDER BY score DESC, sp) = 1),
  {out} AS (SELECT * FROM {out}_best QUALIFY row_number() OVER (PARTITION BY seed_id, dataset_id, seed_col ORDER BY cand_pos, col) = 1)"""


_CANON = "CASE WHEN try_cast({e} AS DOUBLE) IS NOT NULL AND try_cast({e} AS DOUBLE) = floor(try_cast({e} AS DOUBLE)) THEN try_cast({e} AS DOUBLE)::BIGINT::VARCHAR ELSE {e} END"


def domain_sql(e):
    return norm_value_sql(_CANON.format(e=e))


PLAN_SQL = f"""{SIGNATURES_SQL}, {LINES_SQL}, {PRIORITY_SQL}, {_NAME_PAIRS},
  {_mapping_sql("sig", "mapping")}, {_mapping_sql("prio", "pairs")},
  known AS (SELECT DISTINCT seed_id, name AS seed_col, {domain_sql("value")} AS norm FROM cells),
  asked AS (SELECT p.seed_id, p.dataset_id, p.col, p.seed_col, {domain_sql("v.value")} AS norm FROM
    (SELECT DISTINCT dataset_id, col, value FROM lines WHERE value IS NOT NULL) v JOIN pairs p USING (dataset_id, col)),
  shares AS (SELECT a.seed_id, dataset_id, col, seed_col, round(count(k.norm) / count(*), 4) AS overlap
    FROM asked a LEFT JOIN known k USING (seed_id, seed_col, norm) GROUP BY 1, 2, 3, 4),
  keys AS (SELECT *, overlap >= 0.05::DOUBLE AS is_key FROM shares),
  taken AS (SELECT DISTINCT seed_id, {norm_col_sql("name")} AS norm FROM cols),
  fresh AS (SELECT c.*, {norm_col_sql("c.col")} AS norm FROM cand_cols c
    WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE is_key AND k.seed_id = c.seed_id AND k.dataset_id = c.dataset_id AND k.col = c.col)
      AND NOT EXISTS (SELECT 1 FROM mapping m WHERE m.seed_id = c.seed_id AND m.dataset_id = c.dataset_id AND m.col = c.col)
      AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.seed_id = c.seed_id AND t.norm = {norm_col_sql("c.col")})),
  keyed AS (SELECT DISTINCT seed_id, dataset_id FROM keys WHERE is_key),
  owned AS (SELECT f.* FROM fresh f JOIN keyed USING (seed_id, dataset_id)
    QUALIFY dataset_id = min(dataset_id) OVER (PARTITION BY seed_id, norm)),
  outcome AS (SELECT o_custkey AS seed_id, o_orderkey AS dataset_id, CASE WHEN o_orderkey % 6 = 0 OR o_orderstatus = 'P' THEN 'skipped'
      WHEN k.dataset_id IS NULL THEN 'no_join_keys' WHEN n.dataset_id IS NULL THEN 'join_failed' ELSE 'integrated' END AS status,
    CASE WHEN o_orderkey % 6 = 0 THEN 'no download URLs' WHEN o_orderstatus = 'P' THEN 'no downloadable tabular file found'
      WHEN k.dataset_id IS NULL THEN 'no join keys matched' WHEN n.dataset_id IS NULL THEN 'no new attributes to add' ELSE '' END AS skip_reason
    FROM orders LEFT JOIN keyed k ON k.seed_id = o_custkey AND k.dataset_id = o_orderkey
    LEFT JOIN (SELECT DISTINCT seed_id, dataset_id FROM owned) n ON n.seed_id = o_custkey AND n.dataset_id = o_orderkey)"""

QUERIES["int_match_columns"] = lambda s, sf: _mapping(s, sf).select(
    "seed_id", "dataset_id", "col", "seed_col", F.round("score", 4).alias("score"))
ORACLES["int_match_columns"] = f"""WITH {PLAN_SQL} SELECT seed_id, dataset_id, col, seed_col, round(score, 4) AS score FROM mapping"""
QUERIES["int_priority_keys"] = lambda s, sf: _priority(s, sf).select(
    "seed_id", F.array_join("columns", "|").alias("columns"))
ORACLES["int_priority_keys"] = f"""WITH {SIGNATURES_SQL}, {PRIORITY_SQL} SELECT seed_id,
  coalesce(list_aggregate(columns, 'string_agg', '|'), '') AS columns FROM prio"""
QUERIES["int_overlap_values"] = lambda s, sf: _overlaps(s, sf).select(
    "seed_id", "dataset_id", "col", "seed_col", "overlap")
ORACLES["int_overlap_values"] = f"WITH {PLAN_SQL} SELECT seed_id, dataset_id, col, seed_col, overlap FROM shares"


def _ranges(s, sf):
    o = table(s, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_totalprice").alias("cand_min"), F.max("o_totalprice").alias("cand_max"))
    c = table(s, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    seed = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("seed_min"), F.max("c_acctbal").alias("seed_max"))
    return ma.numeric_overlap(c.select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").join(
        seed, "c_nationkey")).select("c_custkey", "overlap")


QUERIES["int_overlap_numeric"] = _ranges
ORACLES["int_overlap_numeric"] = """WITH o AS (SELECT o_custkey, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1),
  n AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
  SELECT c_custkey, CASE WHEN b < lo OR a > hi THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS overlap
  FROM customer JOIN n USING (c_nationkey) LEFT JOIN o ON o_custkey = c_custkey"""
QUERIES["int_join_keys"] = lambda s, sf: _keys(s, sf).select(
    "seed_id", "dataset_id", "col", "seed_col", "is_key", "reason")
ORACLES["int_join_keys"] = f"""WITH {PLAN_SQL} SELECT seed_id, dataset_id, col, seed_col, is_key,
  CASE WHEN NOT is_key THEN 'value overlap too small' END AS reason FROM keys"""
QUERIES["int_new_attributes"] = lambda s, sf: _new(s, sf).select("seed_id", "dataset_id", "col", "norm")
ORACLES["int_new_attributes"] = f"WITH {PLAN_SQL} SELECT seed_id, dataset_id, col, norm FROM fresh"
QUERIES["int_fold"] = lambda s, sf: _owned(s, sf).select("seed_id", "dataset_id", "col", "norm")
ORACLES["int_fold"] = f"WITH {PLAN_SQL} SELECT seed_id, dataset_id, col, norm FROM owned"
QUERIES["int_status"] = lambda s, sf: _statuses(s, sf).select("seed_id", "dataset_id", "status", "skip_reason")
ORACLES["int_status"] = f"WITH {PLAN_SQL} SELECT seed_id, dataset_id, status, skip_reason FROM outcome"
QUERIES["int_status_counts"] = lambda s, sf: ma.status_counts(_statuses(s, sf))
ORACLES["int_status_counts"] = f"""WITH {PLAN_SQL} SELECT seed_id, count(*) AS candidates_eligible,
  count(*) FILTER (status = 'integrated') AS candidates_integrated, count(*) FILTER (status = 'skipped') AS candidates_skipped,
  count(*) FILTER (status = 'no_join_keys') AS candidates_no_join, count(*) FILTER (status = 'join_failed') AS candidates_failed
  FROM outcome GROUP BY 1"""

# --- Entities: noisy part names against the part names --------------------------------------
_NOISE = """CASE p_partkey % 6 WHEN 0 THEN concat(' ', upper(p_name), ' ') WHEN 1 THEN concat(p_name, ' ', lower(p_type))
  WHEN 2 THEN concat(substr(p_name, 1, 3), substr(p_name, 5)) WHEN 3 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
  WHEN 4 THEN lower(concat(p_brand, ' ', p_type)) ELSE concat('xx', reverse(p_name)) END"""


def _resolved(s, sf):
    part = table(s, sf, "part")
    seeds = part.select(F.lit("p_name").alias("domain"), norm_value(F.col("p_name")).alias("norm"),
                        F.col("p_partkey").alias("pos"))
    cands = part.select(F.lit("p_name").alias("domain"), norm_value(F.expr(_NOISE)).alias("norm"))
    return en.resolve(seeds, cands)


QUERIES["int_entity_resolve"] = lambda s, sf: _resolved(s, sf).select(
    "norm", "seed_norm", F.round("score", 4).alias("score"))


def _resolve_sql(seeds, cands, out):
    return f"""{out}_pairs AS (SELECT c.norm AS a, s.norm AS b, s.pos FROM {cands} c, {seeds} s
      WHERE c.norm <> '' AND s.norm <> ''),
  {ratio_sql(f"{out}_pairs", f"{out}_tsr")},
  {out} AS (SELECT a AS norm, b AS seed_norm, CASE WHEN a = b THEN 100.0::DOUBLE ELSE score END AS score
    FROM {out}_pairs JOIN {out}_tsr USING (a, b) WHERE score >= 60
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY a = b DESC, round(score, 6) DESC, pos, b) = 1)"""


ORACLES["int_entity_resolve"] = f"""WITH sv AS (SELECT {norm_value_sql("p_name")} AS norm, min(p_partkey) AS pos FROM part GROUP BY 1),
  cv AS (SELECT DISTINCT {norm_value_sql(_NOISE)} AS norm FROM part), {_resolve_sql("sv", "cv", "best")}
  SELECT norm, seed_norm, round(score, 4) AS score FROM best"""

# Words of the benchmark, each without its second letter, against the words of all documents.


def _words(s, sf, name, word, pos):
    text = table(s, sf, name).select(pos.alias("pos"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    return text.filter("w <> ''").groupBy(F.lit("word").alias("domain"), word.alias("norm")).agg(F.min("pos").alias("pos"))


def _word_domains(s, sf):
    seeds = _words(s, sf, "documents", F.col("w"), F.col("doc_id"))
    typo = F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)"))
    return seeds, _words(s, sf, "benchmark", typo, F.lit(0)).select("domain", "norm")


def _word_visits(s, sf):
    *_, opened = en.resolve_with_visits(*_word_domains(s, sf))
    return en.visit_report(opened)


# Too many pairs for SQL; tests hold the operator against brute force.
QUERIES["int_entity_words"] = lambda s, sf: en.resolve(*_word_domains(s, sf)).select("norm", "seed_norm", F.round("score", 4).alias("score"))
QUERIES["int_entity_visits"] = _word_visits

# --- Execution: orders enriched with customers -------------------------------------------
PAGE = "http://example.org/customers"
_SEED = {"order_id": "o_orderkey", "cust_id": "CASE WHEN o_orderkey % 50 > 0 THEN o_custkey END",
         "priority": "CASE WHEN o_orderkey % 40 > 0 THEN o_orderpriority END", "o_totalprice": "o_totalprice"}
_CUST = {"customer_ref": "CASE WHEN c_custkey > 0 THEN cast(c_custkey AS string) ELSE 'unknown' END", "c_name": "c_name",
         "c_nationkey": "c_nationkey", "c_acctbal": "CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END"}
_PRIO = {"Priority": """CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '-', ' ')
  WHEN 2 THEN concat('level ', o_orderpriority, '!') END""", "row_id": "o_orderkey"}


def _select(s, sf, name, cols):
    return table(s, sf, name).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def _select_sql(name, cols):
    return "SELECT " + ", ".join(f"{e.replace('AS string', 'AS VARCHAR')} AS {c}" for c, e in cols.items()) + f" FROM {name}"


CUSTOMER_PLAN = it.JoinPlan("customer", [("customer_ref", "cust_id")], ["c_name", "c_nationkey", "c_acctbal"], PAGE)


def seed_orders(s, sf):
    return _select(s, sf, "orders", _SEED)


def customers(s, sf):
    return _select(s, sf, "customer", _CUST)


def _augmented(s, sf):
    return it.join_candidate(seed_orders(s, sf), customers(s, sf), CUSTOMER_PLAN)


AUG_SQL = f"""seed AS ({_select_sql("orders", _SEED)}), cust AS ({_select_sql("customer", _CUST)}),
  aug AS (SELECT seed.*, c_name, c_nationkey, c_acctbal, CASE WHEN c_name IS NOT NULL THEN '{PAGE}' END AS c_name__source,
    CASE WHEN c_nationkey IS NOT NULL THEN '{PAGE}' END AS c_nationkey__source,
    CASE WHEN c_acctbal IS NOT NULL THEN '{PAGE}' END AS c_acctbal__source
    FROM seed LEFT JOIN cust ON seed.cust_id IS NOT DISTINCT FROM try_cast("customer_ref" AS BIGINT))"""


def _harmonised(s, sf):
    plan = it.JoinPlan("p", [("Priority", "priority"), ("row_id", "order_id")], ["row_id"], seed_order="order_id")
    _, right = it.with_keys(seed_orders(s, sf), _select(s, sf, "orders", _PRIO), plan)
    return right.select("row_id", F.col("_r0").alias("text_key"), F.col("_r1").alias("number_key"))


QUERIES["int_harmonise_keys"] = _harmonised
ORACLES["int_harmonise_keys"] = f"""WITH seed AS ({_select_sql("orders", _SEED)}), cand AS ({_select_sql("orders", _PRIO)}),
  sv AS (SELECT {norm_value_sql("priority")} AS norm, min(order_id) AS pos FROM seed GROUP BY 1),
  cv AS (SELECT DISTINCT {norm_value_sql('"Priority"')} AS norm FROM cand), {_resolve_sql("sv", "cv", "best")}
  SELECT row_id, CASE WHEN "Priority" IS NOT NULL THEN coalesce(seed_norm, {norm_value_sql('"Priority"')}) END AS text_key,
    row_id AS number_key FROM cand LEFT JOIN best ON norm = {norm_value_sql('"Priority"')}"""

QUERIES["int_left_join"] = lambda s, sf: _augmented(s, sf).select(
    "order_id", "cust_id", "c_name", "c_nationkey", "c_acctbal")
ORACLES["int_left_join"] = f"WITH {AUG_SQL} SELECT order_id, cust_id, c_name, c_nationkey, c_acctbal FROM aug"
QUERIES["int_provenance"] = lambda s, sf: _augmented(s, sf).select(
    "order_id", "c_name__source", "c_nationkey__source", "c_acctbal__source")
ORACLES["int_provenance"] = f"""WITH {AUG_SQL} SELECT order_id, c_name__source, c_nationkey__source, c_acctbal__source FROM aug"""
QUERIES["int_rows_matched"] = lambda s, sf: it.rows_matched(_augmented(s, sf), "c_name")
ORACLES["int_rows_matched"] = f"WITH {AUG_SQL} SELECT count(c_name) AS rows_matched FROM aug"


def _expected(s, sf):
    left, right = it.with_keys(seed_orders(s, sf), customers(s, sf), CUSTOMER_PLAN)
    return en.fan_out(left.select(F.col("_l0").alias("k")), right.select(F.col("_r0").alias("k")), ["k"])


QUERIES["int_fan_out"] = _expected
ORACLES["int_fan_out"] = f"WITH {AUG_SQL} SELECT count(*)::BIGINT AS expected_rows FROM aug"


def _completeness(s, sf):
    a, cols = _augmented(s, sf), list(_SEED)
    before = it.completeness(seed_orders(s, sf), cols).withColumnRenamed("completeness", "before")
    after = it.completeness(a, cols).withColumnRenamed("completeness", "after")
    return before.join(after, "column").select("column", F.round("before", 6).alias("before"),
                                                F.round("after", 6).alias("after"))


QUERIES["int_completeness"] = _completeness
ORACLES["int_completeness"] = f"WITH {AUG_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column, round((SELECT count({c}) / count(*) FROM seed), 6) AS before,
    round((SELECT count({c}) / count(*) FROM aug), 6) AS after""" for c in _SEED)


def _coverage(s, sf):
    a = _augmented(s, sf)
    cover = it.coverage(list(_SEED), a.columns)
    filled = it.completeness(a, [c for v in cover.values() for c in v])
    role = F.when(F.col("column").endswith("__source"), "provenance").otherwise("added")
    return filled.select("column", role.alias("role"), F.round("completeness", 6).alias("completeness"))


QUERIES["int_coverage"] = _coverage
ORACLES["int_coverage"] = f"WITH {AUG_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}{x}' AS column, '{r}' AS role, round(count({c}{x}) / count(*), 6) AS completeness FROM aug"
    for c in CUSTOMER_PLAN.new_columns for x, r in (("", "added"), ("__source", "provenance")))


# Two sources give values for the same orders.
def _source_cells(s, sf):
    o = table(s, sf, "orders")
    a = o.selectExpr("o_orderkey AS seed_key", "'a' AS source", "inline(array(named_struct('attribute', 'priority', 'value', o_orderpriority), "
                     "named_struct('attribute', 'customer', 'value', cast(o_custkey as string))))")
    b = o.selectExpr("o_orderkey AS seed_key", "'b' AS source", "inline(array(named_struct('attribute', 'priority', 'value', "
                     "CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 3 > 0 THEN concat(lower(o_orderpriority), ' ') END), "
                     "named_struct('attribute', 'customer', 'value', concat(cast(o_custkey + if(o_orderkey % 11 = 0, 1, 0) as string), '.0'))))")
    return a.unionByName(b)


QUERIES["int_conflicts"] = lambda s, sf: ma.conflict_rate(ma.conflicts(_source_cells(s, sf)))
ORACLES["int_conflicts"] = """WITH p AS (SELECT o_orderkey % 7 = 0 AS bad FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 > 0)
  SELECT 'priority' AS attribute, count(*) AS compared, count(*) FILTER (bad) AS conflicting, round(avg(bad::INT), 4) AS conflict_rate FROM p
  UNION ALL SELECT 'customer', count(*), count(*) FILTER (o_orderkey % 11 = 0), round(avg((o_orderkey % 11 = 0)::INT), 4) FROM orders"""


QUERIES["int_report"] = lambda s, sf: ma.report(cut(_statuses(s, sf), "statuses")).select(
    "seed_id", "candidates_eligible", "candidates_integrated", F.array_join(F.transform(
        "candidates", lambda c: F.concat_ws(":", c["dataset_id"].cast("string"), c["status"], c["skip_reason"])), "|").alias("candidates"))
ORACLES["int_report"] = f"""WITH {PLAN_SQL} SELECT seed_id, count(*) AS candidates_eligible,
  count(*) FILTER (status = 'integrated') AS candidates_integrated,
  string_agg(dataset_id || ':' || status || ':' || skip_reason, '|' ORDER BY dataset_id) AS candidates FROM outcome GROUP BY 1"""
