"""Registered queries of query generation: one seed per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators import querygen as qg
from tablescout.plans.inputs import SIGNATURES_SQL, table, values
from tablescout.plans.inputs import signatures as signature_rows
from tablescout.session import cut

Y0, Y1 = fv.YEAR_RANGE
COLS = ["seed_id", "query", "target_connector", "strategy", "priority"]
CONN = fv.SOURCE_CONNECTOR

DIMS_SQL = f"""
src(sp, source, connector) AS (SELECT * FROM {values([(i, s, CONN[s]) for i, s in enumerate(fv.SOURCES)])}),
ext(sp, source, connector) AS (SELECT * FROM {values([(i, s, CONN[s]) for i, s in enumerate(fv.EXTENDED_SOURCES)])}),
topics(concept, tp, topic) AS (SELECT * FROM {values([(c, i, t) for c, ts in fv.CONCEPT_TOPICS.items() for i, t in enumerate(ts)])}),
syn(col, yp, synonym) AS (SELECT * FROM {values([(c, i, s) for c, ss in fv.SYNONYMS.items() for i, s in enumerate(ss)])}),
terms(jp, term) AS (SELECT * FROM {values(list(enumerate(fv.JOIN_TERMS)))}),
templates(mp, t, connector) AS (SELECT * FROM {values([(i, t.replace('{years}', f'{Y0} {Y1}'), c) for i, (t, c) in enumerate(fv.DIRECT_TEMPLATES)])}),
covered(word) AS (SELECT * FROM {values([(w,) for w in fv.COVERED_WORDS])}),
con AS (SELECT seed_id, unnest(concepts) AS concept, unnest(range(len(concepts))) AS cp FROM sig),
ids AS (SELECT seed_id, unnest(identifiers) AS ident, unnest(range(len(identifiers))) AS ip FROM sig),
nam AS (SELECT seed_id, unnest(columns) AS col, unnest(range(len(columns))) AS np FROM sig),
reg AS (SELECT seed_id, unnest(regions[1:2]) AS region, unnest(range(len(regions[1:2]))) AS rp FROM sig WHERE regions IS NOT NULL)
"""


def signatures(spark, sf):
    """The signatures as the table that profiling leaves behind."""
    return cut(signature_rows(spark, sf), "signatures")


def _branch(select: str, source: str, strategy: str, priority: int, branch: int, order: str,
            connector: str = "connector", concept: str = "NULL", tier: str = "NULL") -> str:
    return (f"SELECT seed_id, {select} AS query, {connector} AS target_connector, "
            f"'{strategy}' AS strategy, {priority}::INT AS priority, {branch} AS branch, "
            f"[{order}]::INT[] AS pos, {concept}::VARCHAR AS concept, {tier}::INT AS fallback_tier "
            f"FROM {source}")


BRANCHES = {
    "qgen_direct_platform": (qg.direct_platform, _branch(
        "replace(t, '{concept}', replace(concept, '_', ' '))", "con, templates", "direct_platform", 1, 0, "cp, mp",
        concept="concept")),
    "qgen_concept_source": (qg.concept_source, _branch(
        f"topic || ' ' || source || ' {Y0} {Y1}'", "con JOIN topics USING (concept), src WHERE tp < 4",
        "concept_x_source", 1, 1, "cp, tp, sp", concept="concept")),
    "qgen_joinability": (qg.joinability, _branch(
        f"replace(ident, '_', ' ') || ' ' || term || ' ' || source || ' {Y0} {Y1}'",
        "ids, terms, src", "joinability", 2, 2, "ip, jp, sp")),
    "qgen_entity_sample": (qg.entity_sample, _branch(
        "'countries ' || list_aggregate(country_names[1:3], 'string_agg', ', ') || "
        f"' cross-country dataset ' || source || ' {Y0} {Y1}'",
        "sig, src WHERE sp < 2 AND country_names IS NOT NULL",
        "joinability_entity_sample", 2, 3, "sp")),
    "qgen_augmentation": (qg.augmentation, _branch(
        f"topic || ' ' || region || ' ' || source || ' {Y0} {Y1}'",
        "con JOIN topics USING (concept) JOIN reg USING (seed_id), src WHERE sp < 2 AND NOT EXISTS "
        "(SELECT 1 FROM covered WHERE contains(lower(topic), word))",
        "augmentation", 3, 4, "cp, tp, rp, sp", concept="concept")),
    "qgen_synonym": (qg.synonym, _branch(
        f"synonym || ' by country year ' || source || ' {Y0} {Y1}'",
        "nam JOIN syn USING (col), src", "synonym", 2, 5, "np, yp, sp")),
    "qgen_fallback_t1_topics": (qg.tier1_topics, _branch(
        "topic || ' ' || source || ' country dataset'", "con JOIN topics USING (concept), src",
        "fallback_tier1_no_year", 4, 6, "cp, tp, sp", concept="concept", tier="1")),
    "qgen_fallback_t1_join": (qg.tier1_join, _branch(
        "replace(ident, '_', ' ') || ' ' || term || ' ' || source", "ids, terms, src",
        "fallback_tier1_join_no_year", 4, 7, "ip, jp, sp", tier="1")),
    "qgen_fallback_t2": (qg.tier2, " UNION ALL ".join([
        _branch("topic || ' country dataset open data'", "con JOIN topics USING (concept), ext",
                "fallback_tier2_extended_sources", 5, 8, "cp, tp, sp", concept="concept", tier="2"),
        _branch("synonym || ' country open dataset'", "nam JOIN syn USING (col), ext WHERE sp < 3",
                "fallback_tier2_synonym_extended", 5, 9, "np, yp, sp", tier="2"),
        _branch("replace(ident, '_', ' ') || ' cross-country open data'", "ids, ext",
                "fallback_tier2_join_extended", 5, 10, "ip, sp", tier="2")])),
}
NORMAL = ["qgen_direct_platform", "qgen_concept_source", "qgen_joinability",
          "qgen_entity_sample", "qgen_augmentation", "qgen_synonym"]
TIERS = ["qgen_fallback_t1_topics", "qgen_fallback_t1_join", "qgen_fallback_t2"]


def _dedupe_sql(names: list[str], extra: str = "") -> str:
    union = " UNION ALL ".join(f"({BRANCHES[n][1]})" for n in names)
    return f"""raw AS ({union}), uniq AS (
      SELECT * FROM raw {extra} QUALIFY row_number() OVER (
        PARTITION BY seed_id, lower(trim(query)) ORDER BY branch, pos) = 1),
    numbered AS (SELECT *, row_number() OVER (
        PARTITION BY seed_id ORDER BY priority, branch, pos)::INT AS id FROM uniq)"""


HEAD_SQL = f"WITH {SIGNATURES_SQL}, {DIMS_SQL}"
FIELDS = ", ".join(COLS)

QUERIES, ORACLES = {}, {}
for _key, (_fn, _sql) in BRANCHES.items():
    QUERIES[_key] = lambda spark, sf, fn=_fn: fn(signatures(spark, sf)).select(*COLS)
    ORACLES[_key] = f"{HEAD_SQL} SELECT {FIELDS} FROM ({_sql})"


def _normal(spark, sf):
    return qg.union_dedupe(signatures(spark, sf), *[BRANCHES[n][0].items for n in NORMAL])


def _generated(spark, sf):
    return qg.generate(signatures(spark, sf))


def _normal_and_fallback(spark, sf):
    sig = signatures(spark, sf)
    return qg.generate(sig).unionByName(qg.fallback(sig, qg.sufficiency(_feedback(spark, sf))))


QUERIES["qgen_union_dedupe"] = lambda spark, sf: _normal(spark, sf).select(*COLS)
ORACLES["qgen_union_dedupe"] = f"{HEAD_SQL}, {_dedupe_sql(NORMAL)} SELECT {FIELDS} FROM uniq"
QUERIES["qgen_order_ids"] = lambda spark, sf: _generated(spark, sf).select("id", *COLS)
ORACLES["qgen_order_ids"] = f"{HEAD_SQL}, {_dedupe_sql(NORMAL)} SELECT id, {FIELDS} FROM numbered"


# Feedback: a customer's orders stand for scored candidates of their connectors.
def _candidates(spark, sf):
    names = F.array(*[F.lit(c) for c in fv.REACHABLE_CONNECTORS])
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("seed_id"),
        F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("connector"),
        F.when(F.col("o_orderstatus") != "F", F.array(F.col("o_orderpriority"))).otherwise(
            F.array().cast("array<string>")).alias("matched_join_fields"),
        F.round(F.col("o_totalprice") / 1000000, 4).alias("relevance_score"))


def _tried(spark, sf):
    names = F.array(*[F.lit(c) for c in fv.REACHABLE_CONNECTORS])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seed_id"), F.explode(names).alias("target_connector"))


def _feedback(spark, sf):
    return qg.feedback(_tried(spark, sf), _candidates(spark, sf))


_NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in fv.REACHABLE_CONNECTORS) + "]"
FEEDBACK_SQL = f"""
cand AS (SELECT o_custkey AS seed_id, list_extract({_NAMES_SQL}, (o_orderkey % 6 + 1)::INT) AS connector,
    o_orderstatus <> 'F' AS joinable, round(o_totalprice / 1000000, 4) AS rel FROM orders),
tried AS (SELECT c_custkey AS seed_id, unnest({_NAMES_SQL}) AS connector FROM customer),
found AS (SELECT seed_id, count(*) AS total, count(*) FILTER (joinable) AS joinable, avg(rel) AS rel FROM cand GROUP BY 1),
silent AS (SELECT seed_id, string_agg(connector, '|' ORDER BY connector) AS failed FROM
    (SELECT DISTINCT seed_id, connector FROM tried EXCEPT SELECT seed_id, connector FROM cand) GROUP BY 1),
fb AS (SELECT seed_id, coalesce(total, 0)::BIGINT AS total_candidates, coalesce(joinable, 0)::BIGINT AS joinable_count,
    coalesce(rel, 0.0)::DOUBLE AS avg_relevance, connectors_tried, coalesce(failed, '') AS failed_connectors
  FROM (SELECT seed_id, string_agg(connector, '|' ORDER BY connector) AS connectors_tried FROM tried GROUP BY 1)
  LEFT JOIN found USING (seed_id) LEFT JOIN silent USING (seed_id)),
suff AS (SELECT seed_id, failed, len(failed) = 0 AS is_sufficient, least(len(failed), 2)::INT AS relaxation_level FROM (
  SELECT seed_id, list_filter([
    CASE WHEN total_candidates < 5 THEN 'too_few_candidates: got ' || total_candidates || ', need 5' END,
    CASE WHEN share < 0.4::DOUBLE THEN 'low_joinability: ' || round(share * 100, 0)::INT || '% joinable, need 40%' END,
    CASE WHEN avg_relevance < 0.3::DOUBLE THEN 'low_relevance: avg score ' || printf('%.2f', round(avg_relevance, 2)) || ', need 0.30' END
  ], lambda x: x IS NOT NULL) AS failed
  FROM (SELECT *, CASE WHEN total_candidates > 0 THEN joinable_count / total_candidates ELSE 0 END AS share FROM fb)))
"""

QUERIES["qgen_feedback"] = lambda spark, sf: _feedback(spark, sf).select(
    "seed_id", "total_candidates", "joinable_count", F.round("avg_relevance", 9).alias("avg_relevance"),
    F.array_join("connectors_tried", "|").alias("connectors_tried"),
    F.array_join("failed_connectors", "|").alias("failed_connectors"))
ORACLES["qgen_feedback"] = f"""WITH {FEEDBACK_SQL} SELECT seed_id, total_candidates, joinable_count,
  round(avg_relevance, 9) AS avg_relevance, connectors_tried, failed_connectors FROM fb"""
QUERIES["qgen_sufficiency"] = lambda spark, sf: qg.sufficiency(_feedback(spark, sf)).withColumn(
    "failed_checks", F.array_join("failed_checks", "|"))
ORACLES["qgen_sufficiency"] = f"""WITH {FEEDBACK_SQL} SELECT seed_id,
  coalesce(list_aggregate(failed, 'string_agg', '|'), '') AS failed_checks, is_sufficient, relaxation_level FROM suff"""


def _fallback(spark, sf):
    return qg.fallback(signatures(spark, sf), qg.sufficiency(_feedback(spark, sf)))


QUERIES["qgen_fallback"] = lambda spark, sf: _fallback(spark, sf).select("id", *COLS, "fallback_tier")
ORACLES["qgen_fallback"] = f"""{HEAD_SQL}, {FEEDBACK_SQL},
  {_dedupe_sql(TIERS, "JOIN suff USING (seed_id) WHERE fallback_tier <= relaxation_level")}
  SELECT id, {FIELDS}, fallback_tier FROM numbered"""

QUERIES["qgen_summary"] = lambda spark, sf: qg.summary(_normal_and_fallback(spark, sf))
ORACLES["qgen_summary"] = f"""{HEAD_SQL}, {FEEDBACK_SQL}, {_dedupe_sql(NORMAL)},
  raw2 AS ({" UNION ALL ".join(f"({BRANCHES[n][1]})" for n in TIERS)}),
  uniq2 AS (SELECT raw2.* FROM raw2 JOIN suff USING (seed_id) WHERE fallback_tier <= relaxation_level
    QUALIFY row_number() OVER (PARTITION BY seed_id, lower(trim(query)) ORDER BY branch, pos) = 1),
  everything AS (SELECT seed_id, strategy, target_connector, concept, fallback_tier FROM uniq
    UNION ALL SELECT seed_id, strategy, target_connector, concept, fallback_tier FROM uniq2),
  tagged AS (SELECT seed_id, 'strategy' AS dimension, strategy AS key FROM everything
    UNION ALL SELECT seed_id, 'target_connector', target_connector FROM everything
    UNION ALL SELECT seed_id, 'concept', concept FROM everything
    UNION ALL SELECT seed_id, 'fallback_tier', fallback_tier::VARCHAR FROM everything)
  SELECT seed_id, dimension, key, count(*)::BIGINT AS n FROM tagged WHERE key IS NOT NULL GROUP BY 1, 2, 3"""

QUERIES["qgen_head_per_strategy"] = lambda spark, sf: qg.heads(_generated(spark, sf)).select(
    "seed_id", "strategy", "id", "query")
ORACLES["qgen_head_per_strategy"] = f"""{HEAD_SQL}, {_dedupe_sql(NORMAL)}
  SELECT seed_id, strategy, id, query FROM numbered
  QUALIFY row_number() OVER (PARTITION BY seed_id, strategy ORDER BY id) <= 5"""
