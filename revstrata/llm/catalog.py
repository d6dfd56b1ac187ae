"""The subpackage's queries by name, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange, bpe, hnsw, kd_search, mixing, ngram_join, sharding, substring_dedup, token_counts, toxicity, warc_zst

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document that is similar to another."""
    return ngram_join.ngram_links(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op10_ngram_jaccard_join"] = op10_ngram_jaccard_join
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL["op10_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b, o / (x.n + y.n - o) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o / (x.n + y.n - o) >= 0.5),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id)
SELECT a AS doc_id, any_value(class_id) AS class_id, count(*) AS n_links, least(a, coalesce(min(b) FILTER (jaccard = 1), a)) AS copy_id FROM e JOIN c ON c.doc_id = a GROUP BY a
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    return bpe.decode(bpe.encoded_documents(_table(spark, sf_dir, "documents")))


QUERIES["op2_bpe"] = op2_bpe


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies stay together; characters are balanced over the shards."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op3_sharding"] = op3_sharding
SQL["op3_sharding"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS key, coalesce(length(text), 0) AS size FROM documents),
g AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS rn FROM (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY key)),
r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS shard, [CAST(0 AS BIGINT) FOR i IN range({sharding.SHARDS})] AS loads
      UNION ALL
      SELECT x.rn, x.key, x.shard, list_transform(x.loads, lambda v, i: CASE WHEN i = x.shard + 1 THEN v + x.size ELSE v END)
      FROM (SELECT g.rn, g.key, g.size, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER) AS shard, r.loads FROM r JOIN g ON g.rn = r.rn + 1) x)
SELECT doc_id, shard FROM d JOIN r USING (key)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of at least 50 words but its first occurrence."""
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op4_substring_dedup"] = op4_substring_dedup
_WS = " \\t\\n\\x0b\\f\\r"
SQL["op4_substring_dedup"] = f"""
WITH p AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, lead FROM
           (SELECT doc_id, regexp_extract_all(text, '[^{_WS}]+[{_WS}]*') AS p, strlen(regexp_extract(text, '^[{_WS}]*')) AS lead FROM documents)),
w AS (SELECT doc_id, i, regexp_extract(piece, '^[^{_WS}]+') AS word,
      CAST(lead + sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(piece) AS INTEGER) AS b FROM p),
v AS (SELECT doc_id, i, b, lead(b + strlen(word), 49) OVER d AS e, lead(i, 49) OVER d AS l,
      md5(array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) AS k
      FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, first_value(doc_id) OVER k AS fd, first_value(i) OVER k AS fi FROM v WHERE l IS NOT NULL WINDOW k AS (PARTITION BY k ORDER BY doc_id, i)),
h AS (SELECT * FROM f WHERE doc_id <> fd OR i <> fi),
c AS (SELECT *, CASE WHEN fd = lag(fd) OVER o AND i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c)
SELECT doc_id, min(b) AS start_byte, CAST(max(e) AS INTEGER) AS end_byte, CAST(max(i) - min(i) + 50 AS INTEGER) AS n_words, min(fd) AS first_doc_id FROM s GROUP BY doc_id, span
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document, by a model fitted on labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES["op6_toxicity"] = op6_toxicity


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit at which one of them changes."""
    return token_counts.limits(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


QUERIES["op7_token_counts"] = op7_token_counts


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of as many tokens as there are, from the sources' own shares to those flattened by a square root."""
    return mixing.curriculum(_table(spark, sf_dir, "documents"))


QUERIES["op9_mixing"] = op9_mixing
SQL["op9_mixing"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0) AS tokens, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
s AS (SELECT source, sum(tokens) AS supply FROM t GROUP BY source),
p AS (SELECT source, CAST(supply AS DOUBLE) AS supply, CAST(sum(supply) OVER () AS DOUBLE) AS budget, CAST(supply AS DOUBLE) / CAST(sum(supply) OVER () AS DOUBLE) AS share FROM s),
w AS (SELECT *, share / sum(share) OVER () AS a, sqrt(share) / sum(sqrt(share)) OVER () AS b FROM p),
d AS (SELECT *, (a + b) / 2 AS demand FROM w),
c AS (SELECT t.*, sum(tokens) OVER (PARTITION BY source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t),
e AS (SELECT c.*, d.* EXCLUDE (source), unnest(range(0, CAST(greatest(1, ceil(budget * demand / supply - 1e-9)) AS BIGINT))) AS epoch FROM c JOIN d USING (source)),
y AS (SELECT *, (before + epoch * supply) / budget AS y FROM e)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, round(least(2 * y / (a + sqrt(greatest(a * a + 2 * (b - a) * y, 0))), 1), 9) AS position FROM y WHERE y < demand + 1e-12
"""


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors, among all of them, of every vector whose id is divisible by 20."""
    return kd_search.knn(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


QUERIES["op1_knn"] = op1_knn
SQL["op1_knn"] = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {kd_search.K}
"""


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 10 nearest other vectors, among all of them, of every vector whose id is divisible by 20."""
    return hnsw.ann(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


QUERIES["op5_hnsw"] = op5_hnsw


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to dictionary-compressed archives in the shared folder and read from them again."""
    folder = os.path.join(_exchange.shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    warc_zst.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc_zst.pages_of(warc_zst.read(spark, folder))


QUERIES["op8_warc"] = op8_warc
SQL["op8_warc"] = """
SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, md5(coalesce(html, '')) AS payload_md5, CAST(NULL AS VARCHAR) AS error FROM pages
"""
