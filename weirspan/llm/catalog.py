"""Registered queries of the corpus operators and, where SQL can say the same, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirspan.llm import decontaminate, line_dedup, lm_score, neighbours, packing, pii, quotes, resampling, sharding, simhash, substrings, toxicity, whitening
from weirspan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if check:
            CHECKS[name] = check
        return f

    return keep


@register("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op7_simhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents
), occ AS (
  SELECT rid, doc_id, md5(text) AS digest, source, place, trim(lines[place], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS place FROM d)
), said AS (
  SELECT *, words >= 50 AS long FROM (SELECT *, len(string_split_regex(line, '[ \\t\\v\\f\\r]+')) AS words FROM occ WHERE line <> '') WHERE words >= 3
), gone AS (
  SELECT line, min(struct_pack(none := doc_id IS NULL, doc_id := doc_id, digest := digest, place := place)) AS first FROM said GROUP BY line, long
  HAVING count(DISTINCT CASE WHEN long THEN concat('d', doc_id, ':', digest) WHEN source IS NULL THEN 'n' ELSE concat('s', source) END) >= CASE WHEN long THEN 2 ELSE 3 END
), dropped AS (
  SELECT s.rid, s.place FROM said s JOIN gone g USING (line) WHERE struct_pack(none := s.doc_id IS NULL, doc_id := s.doc_id, digest := s.digest, place := s.place) <> g.first
), counted AS (
  SELECT rid, count(*) AS n, list(place) AS places FROM dropped GROUP BY rid
), kept AS (
  SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, coalesce(n, 0) AS n_removed,
    CASE WHEN n IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda p: NOT list_contains(places, p)), lambda p: lines[p]), chr(10)) END AS text
  FROM d LEFT JOIN counted USING (rid)
)
SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(n_removed AS INT) AS n_removed, CAST(length(text) AS INT) AS kept_chars, sha256(text) AS text_sha256 FROM kept
"""


@register("op10_distinct_site_lines", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_at AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0
), item_span AS (
  SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS span FROM item_at
), doc_at AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT size FROM item_span) WHERE len(w) >= size
), hit AS (
  SELECT DISTINCT rid, pos, x.size, item_id FROM (SELECT rid, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS span FROM doc_at) x JOIN item_span s ON x.size = s.size AND x.span = s.span
), word AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM hit) GROUP BY rid
), item AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (rid) LEFT JOIN item USING (rid)
"""


@register("op8_winnowing_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_balanced_label_propagation")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op3_hidden_markov_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@register("op4_boosted_tree_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_disclosing_terms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@register("op9_nn_descent")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@register("op1_quotation_linking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS span FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35)
), again AS (
  SELECT span FROM win GROUP BY span HAVING count(*) > 1
), gone AS (
  SELECT rid, list(DISTINCT p) AS places FROM (SELECT rid, unnest(range(pos, pos + 35)) AS p FROM win JOIN again USING (span)) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(places, p)), lambda p: w[p]), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""


@register("op11_repeated_passages", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op12_shifted_cholesky_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), texts AS (
  SELECT rid, w FROM d UNION ALL SELECT NULL, w FROM b
), run AS (
  SELECT rid, array_to_string(w[pos:pos + n - 1], ' ') AS feature, count(*) AS c
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM texts CROSS JOIN range(1, 4) r(n) WHERE len(w) >= n) GROUP BY ALL
), named AS (
  SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM run)
), bucketed AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
  FROM named CROSS JOIN crc
), counted AS (
  SELECT bucket, coalesce(sum(c) FILTER (WHERE rid IS NOT NULL), 0) AS s, coalesce(sum(c) FILTER (WHERE rid IS NULL), 0) AS t FROM run JOIN bucketed USING (feature) GROUP BY bucket
), total AS (
  SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM counted
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS g FROM counted CROSS JOIN total
), weighed AS (
  SELECT rid, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * g) AS BIGINT) AS weight FROM run JOIN bucketed USING (feature) JOIN gain USING (bucket) WHERE rid IS NOT NULL GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (rid)
), drawn AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""


@register("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
