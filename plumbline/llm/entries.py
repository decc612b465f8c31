"""The operators' queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, cotraining, hosts, jaccard, katz, mixing, rendering, repetition, search, toxicity
from plumbline.llm.common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.quantised(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op5_multiple_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the labels of its id say low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return hosts.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.render_pages(table(spark, sf_dir, "pages"))


def op9_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op10_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_tree, op2_maxscore, op3_suffix_repetition, op4_cotraining, op5_multiple_instance, op6_katz_backoff, op7_host_reputation, op8_html_layout, op9_splitting_tree, op10_prefix_tree, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_maxscore": OP2_SQL, "op7_host_reputation": OP7_SQL, "op10_prefix_tree": OP10_SQL}


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1]::HUGEINT * p[2]::HUGEINT, 0))), 0) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.r <> v.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP7_SQL = r"""
WITH own AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS u FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM own),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
ruled AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS rule_verdict
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
suffixes(s) AS (VALUES {suffixes}),
bad AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
named AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'gs') AS name FROM parsed),
cut AS (
  SELECT name, CASE WHEN regexp_matches(name, '^[0-9.]+$|[\[\]:]') THEN 0 ELSE coalesce(max(len(string_split(s, '.'))), 1) END AS labels
  FROM (SELECT DISTINCT name FROM named) LEFT JOIN suffixes ON name = s OR ends_with(name, '.' || s) GROUP BY name),
h AS (
  SELECT name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
    CASE WHEN labels = 0 THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -labels - 1, -1), '.') END AS domain,
    CASE WHEN labels = 0 THEN '' ELSE array_to_string(list_slice(string_split(name, '.'), -labels, -1), '.') END AS suffix
  FROM named JOIN cut USING (name) LEFT JOIN bad USING (page_id) GROUP BY name, labels),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
r AS (SELECT (coalesce(sum(bad), 0) + 0.2) / (coalesce(sum(n), 0) + 2.0) AS p, coalesce(sum(n), 0) + 2.0 AS t FROM s),
s0 AS (SELECT s.*, r.p, r.t FROM s, r), ms AS (SELECT least(1000, greatest(2, coalesce(CASE WHEN coalesce(sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) / sum(n), 0) <= 0 THEN 1000.0 ELSE sum(n * p * (1 - p)) / sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) - 1 END, 1000))) AS m FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (bad + least(m, t) * p) / (n + least(m, t)) AS p, n + least(m, t) AS t FROM s0, ms),
d0 AS (SELECT d.*, s1.p, s1.t FROM d JOIN s1 USING (suffix)), md AS (SELECT least(1000, greatest(2, coalesce(CASE WHEN coalesce(sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) / sum(n), 0) <= 0 THEN 1000.0 ELSE sum(n * p * (1 - p)) / sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) - 1 END, 1000))) AS m FROM d0 WHERE n > 0),
d1 AS (SELECT domain, suffix, (bad + least(m, t) * p) / (n + least(m, t)) AS p, n + least(m, t) AS t FROM d0, md),
h0 AS (SELECT h.*, d1.p, d1.t FROM h JOIN d1 USING (domain, suffix)), mh AS (SELECT least(1000, greatest(2, coalesce(CASE WHEN coalesce(sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) / sum(n), 0) <= 0 THEN 1000.0 ELSE sum(n * p * (1 - p)) / sum(n * ((bad / n - p) ** 2 - p * (1 - p) / n)) - 1 END, 1000))) AS m FROM h0 WHERE n > 0),
h1 AS (SELECT name, (bad + least(m, t) * p) / (n + least(m, t)) AS p, n + least(m, t) AS t FROM h0, mh)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN p - 1.645 * sqrt(p * (1 - p) / (t + 1)) > 0.35 THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN ruled USING (page_id) LEFT JOIN h1 USING (name)
""".replace("{suffixes}", ", ".join(f"('{s}')" for s in hosts.SUFFIXES))

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents JOIN c ON c.d = documents.doc_id LEFT JOIN n USING (doc_id)
"""
