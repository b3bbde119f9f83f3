"""Retrieval, tagging and log queries over documents, vectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mercata.operators import logs, text
from mercata.sources.star import Star

from .registry import register

WORDS = {"license": ["apache", "mit license", "cc by"], "secret": ["password", "token", "akia"]}


@register(
    "rag_chunk",
    """
WITH clean AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM documents),
cut AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1000 THEN [0] ELSE range(0, length(t), 800) END) AS a FROM clean WHERE t <> ''),
p AS (SELECT doc_id, a, substr(t, CAST(a + 1 AS INTEGER), 1000) AS text FROM cut)
SELECT doc_id AS source, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, text
FROM p WHERE trim(text) <> ''""",
)
def rag_chunk(s: Star) -> DataFrame:
    return text.chunk_table(s.raw("documents"), "doc_id", "text")


def vectors(s: Star) -> DataFrame:
    return s.raw("embeddings").select("vec_id", F.col("label").alias("source"), F.col("embedding").alias("v"))


def query_vectors(s: Star) -> DataFrame:
    return vectors(s).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))


HITS = """
WITH e AS (SELECT vec_id, label AS source, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT vec_id AS query, v AS qv FROM e WHERE vec_id % 50 = 0),
sc AS (SELECT query, vec_id, source, round(coalesce(list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS score FROM e, q),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM sc),
ff AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, vec_id) AS s FROM nn WHERE n <= 20),
hits AS (SELECT query, vec_id, source, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ff WHERE s = 1)
"""


@register("rag_topk", HITS + "SELECT * FROM hits WHERE rank <= 4")
def rag_topk(s: Star) -> DataFrame:
    return text.top_hits(vectors(s), query_vectors(s))


@register("rag_dedupe", HITS + "SELECT query, source, rank FROM hits WHERE rank <= 3")
def rag_dedupe(s: Star) -> DataFrame:
    """At most three citations of a query, the first of each source."""
    hits = text.top_hits(vectors(s), query_vectors(s))
    first = hits.withColumn("c", F.row_number().over(W.partitionBy("query", "source").orderBy("rank"))).where("c = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("rank"))).where("rank <= 3").select("query", "source", "rank")


SCORES = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ex AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS cv FROM ex GROUP BY 1),
sc AS (SELECT vec_id, c.label, round(coalesce(list_dot_product(v, cv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cv, cv)), 0), 0), 6) AS score FROM e, c),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM sc)
"""


def centroids(s: Star) -> DataFrame:
    """The mean vector of each label."""
    parts = s.raw("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    return packed.select("label", F.transform("c", lambda x: x["m"]).alias("c"))


@register("vec_nearest", SCORES + "SELECT vec_id, score, CASE WHEN score >= 0.3 THEN label END AS label FROM b WHERE n = 1")
def vec_nearest(s: Star) -> DataFrame:
    return text.nearest_label(vectors(s), centroids(s))


@register("vec_label_scores", SCORES + "SELECT vec_id, label, score FROM b")
def vec_label_scores(s: Star) -> DataFrame:
    """The score of every label, not of the nearest alone."""
    return text.label_scores(vectors(s), centroids(s))


def _tag_sql(words: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL), ',')"


@register("tag_entities", "SELECT doc_id, " + ", ".join(f"{_tag_sql(ws)} AS {k}" for k, ws in WORDS.items()) + " FROM documents")
def tag_entities(s: Star) -> DataFrame:
    found = s.raw("documents").select("doc_id", text.tags(F.col("text"), WORDS).alias("t"))
    return found.select("doc_id", *[F.array_join(F.col("t")[k], ",").alias(k) for k in WORDS])


@register("text_fold", f"SELECT doc_id, md5(regexp_replace(translate(lower(text), '{text.MARKED}', '{text.PLAIN}'), '{text.LOOSE_MARKS}', '', 'g')) AS folded FROM documents")
def text_fold(s: Star) -> DataFrame:
    return s.raw("documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@register(
    "mask_literals",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '''[^'']*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g')) AS masked FROM documents",
)
def mask_literals(s: Star) -> DataFrame:
    return s.raw("documents").select("doc_id", F.md5(text.mask_literals(F.col("text"))).alias("masked"))


def log(s: Star) -> DataFrame:
    failed = F.col("event_type") == "error"
    return s.raw("events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("route"), "ts", F.col("value").alias("duration"), failed.alias("is_error"), "event_id",
        F.when(failed, 500).otherwise(200).alias("status"), F.get_json_object("props", "$.k").cast("long").alias("rows"),
    )


@register(
    "log_stats",
    """
WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-08'),
t AS (SELECT event_type, count(*) AS n FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10)
SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors,
       round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 2) AS error_pct, round(avg(value), 4) AS avg_duration,
       (SELECT string_agg(concat(event_type, '=', n), ',' ORDER BY n DESC, event_type) FROM t) AS top_routes FROM e""",
)
def log_stats(s: Star) -> DataFrame:
    told = logs.summary(log(s).where("ts >= TIMESTAMP_NTZ'2024-01-08'"))
    return told.withColumn("top_routes", F.array_join(F.transform("top_routes", lambda r: F.concat(r["route"], F.lit("="), r["requests"].cast("string"))), ","))


@register(
    "log_route_metrics",
    """SELECT event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(count(*) AS BIGINT) AS requests, round(avg(value), 4) AS avg_duration,
       CAST(sum(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1, 2""",
)
def log_route_metrics(s: Star) -> DataFrame:
    return logs.route_metrics(log(s))


#: The limiter hit by hit: a key's allowed times in the window so far, oldest first, are handed from hit to hit.
LIMITER = """
WITH RECURSIVE n AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT event_id, key, i, [t] AS hits, true AS allowed FROM n WHERE i = 1
  UNION ALL
  SELECT event_id, key, i, CASE WHEN len(h) < 2 THEN list_append(h, t) ELSE h END AS hits, len(h) < 2 AS allowed
  FROM (SELECT n.*, list_filter(r.hits, lambda x: n.t - x <= 3600000000) AS h FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1))
"""


@register("log_limiter", LIMITER + "SELECT event_id, key, allowed, CAST(2 - len(hits) AS INTEGER) AS remaining FROM r")
def log_limiter(s: Star) -> DataFrame:
    """Whether a limiter of two hits an hour admits each event of a user, and how many it would admit next."""
    return logs.limiter(log(s), limit=2, seconds=3600).select("event_id", "key", "allowed", "remaining")


@register("log_over_quota", LIMITER + "SELECT event_id, key FROM r WHERE NOT allowed")
def log_over_quota(s: Star) -> DataFrame:
    return logs.over_quota(log(s), limit=2, seconds=3600).select("event_id", "key")


@register(
    "log_sessions",
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, CAST(count(*) AS BIGINT) AS requests FROM n GROUP BY user_id, s""",
)
def log_sessions(s: Star) -> DataFrame:
    out = logs.sessions(log(s))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "last")})
