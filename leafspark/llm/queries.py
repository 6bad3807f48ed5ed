"""The operators over their whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import decontaminate, html_text, lm, media, mixing, pii, quality, sharding, simhash, substring_dedup
from leafspark.llm.common import least_hashed, table

#: Shares of tokens by language, for mixing.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of the labelled table with their language as the domain: at most mixing.SAMPLE, by least hash of
    the id."""
    some = least_hashed(labels.select("doc_id").where("doc_id is not null").distinct(), F.xxhash64("doc_id"), mixing.SAMPLE)
    return docs.join(F.broadcast(some), "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_decontamination, op3_pii, op4_media, op5_substring, op6_html, op7_sharding, op8_mixing, op9_lm, op10_quality)
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    regexp_extract_all(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS p
  FROM documents
),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM x GROUP BY doc_id),
r AS (SELECT doc_id, min(k) AS a, max(k) AS z FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM x) GROUP BY doc_id, run),
o AS (
  SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS hit_spans
  FROM (SELECT doc_id, length(array_to_string(p[1:a], '')) - length(w[a]) AS s, length(array_to_string(p[1:z], '')) AS e FROM r JOIN d USING (doc_id)) GROUP BY doc_id
),
t AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id)
""",
    "op5_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
x AS (SELECT doc_id, list(i) AS starts FROM s JOIN f USING (g) WHERE doc_id > least GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM (SELECT doc_id, unnest(starts) AS i FROM x)),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT d.doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN c ON c.doc_id = d.doc_id AND c.k = p WHERE c.k IS NULL)
  GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}
