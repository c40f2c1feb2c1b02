"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import (
    alignment,
    decontamination,
    html_extraction,
    language_id,
    near_dedup,
    packing,
    periodic_runs,
    substring_dedup,
    token_counts,
    token_files,
    topk_search,
    toxicity,
    url_filters,
)
from tablescout.session import cut, new_folder

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wide(x):
        return x.cast("double")

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf"))))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * wide(x))).alias("v"))
    return topk_search.top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _rest(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_rest(4) == 2, F.lit(False))
    out = language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), docs.filter(~held))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_rest(3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = toxicity.score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), docs.filter(~held).select("doc_id", "text"), labels)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "n_words", "kept_id", "removed")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, per_cent=85)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = cut(found.withColumn("groups_sha256", groups).drop("groups"), "aligned")
    return alignment.weighed(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text goes on periodically from some word, as the digest query wants it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("h div 10")
    words = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    words = words.withColumn("n", F.nullif(F.size("w").cast("long"), F.lit(0).cast("long")))
    words = words.withColumn("a", g % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    altered = F.expr("array_join(transform(w, (x, i) -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return words.select("doc_id", F.when(F.col("p").isNotNull(), altered).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # equal quotients give equal doubles, and different ones of less than 2^26 words different doubles
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"] / r["period"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), folder, end_id=2)
    return token_files.read_ids(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_topk_search, op2_html_extraction, op3_token_counts, op4_language_id, op5_toxicity, op6_substring_dedup,
    op7_url_filters, op8_packing, op9_decontamination, op10_near_dedup, op11_alignment, op12_periodic_runs, op13_token_files)}


def _url_sql() -> str:
    hosts = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.HOST_RULES)
    rules = ", ".join(f"('{url_filters.regex(p)}', {v == 'block'})" for p, v in url_filters.PATTERN_RULES)
    letters = f"'{url_filters.UPPER}', '{url_filters.LOWER}'"
    return f"""
WITH hosts(h, p, v) AS (VALUES {hosts}), rules(re, block) AS (VALUES {rules}),
u AS (SELECT DISTINCT url FROM pages),
a AS (SELECT url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {letters}) AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT url, arg_max(hosts.h || hosts.p, length(hosts.h || hosts.p)) AS rule, arg_max(v, length(hosts.h || hosts.p)) AS v
      FROM a JOIN hosts ON (a.host = hosts.h OR ends_with(a.host, '.' || hosts.h)) AND starts_with(a.path, hosts.p) GROUP BY url),
r AS (SELECT url, bool_and(block) AS blocked FROM u JOIN rules ON regexp_matches(translate(url, {letters}), re) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(h.v, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM pages JOIN a ON pages.url IS NOT DISTINCT FROM a.url LEFT JOIN h ON pages.url = h.url LEFT JOIN r ON pages.url = r.url"""


_TOPK_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES = {"op1_topk_search": _TOPK_SQL, "op7_url_filters": _url_sql(), "op10_near_dedup": _NEAR_SQL}
