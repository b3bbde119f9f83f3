"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, html_text, licenses, mixing, secrets, simhash, spelling, suffix_tree, token_counts, toxicity, url_filter, vectors

from .common import small_batches

#: Hosts with one of these words between dots and hyphens are the block list of ``op1_url_filter``.
LISTED_WORDS = ("casino", "pills", "spam", "bets", "adult", "ads")
#: The vocabulary file of ``op9_token_counts``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("host"))
    blocked = hosts.where(F.col("host").rlike(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))
    return url_filter.filter_urls(pages, blocked).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, _table(spark, sf_dir, "labels")).drop("text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.train(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # its many jobs share no shuffle
    return suffix_tree.lm_scores(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _rules_sql() -> str:
    fits = [
        (h + p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))")
        for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in fits)
    listed = f"regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)')"
    return f"""
        WITH split AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages)
        SELECT page_id, host, path, {rule} AS rule,
               {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
        FROM split"""


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
g AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1)
SELECT g.vec_id, coalesce(n.n, 0) AS n_links, g.component_id, g.vec_id = g.component_id AS kept FROM g LEFT JOIN n ON n.a = g.vec_id"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY ALL HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n_lang FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(CAST(n AS HUGEINT), 0) AS n_all
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (n_all + v) AS p,
             1 + (1000000000 * (total + 1)) // (n_lang + v) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _rules_sql(), "op4_near_vectors": VECTORS_SQL, "op11_divergence": DIVERGENCE_SQL}
