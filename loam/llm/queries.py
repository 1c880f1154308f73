"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, filter_audit, html_extract, license_scan, lm_score, minhash, packing, pii, quality_net, quality_rules, repeats, resample, urlfilter
from .common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(lm_score.blocked_documents(spark, f"{sf_dir}/documents.parquet"), block="block")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge_urls(pages, urlfilter.listed_pages(pages), urlfilter.RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of each document that it shares with others: where it is, and the least doc_id that has it."""
    return repeats.repeated_passages(table(spark, sf_dir, "documents")).drop("tag", "doc_key")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and representative: documents of one class are linked by similarities of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scored = resample.score_documents(docs.select("doc_id", "text"), target).drop("text")
    return resample.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_decontaminate": op2_decontaminate,
        "op3_url_filter": op3_url_filter,
        "op4_html_text": op4_html_text,
        "op5_pack": op5_pack,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_quality": op7_quality,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_pii": op9_pii,
        "op10_quality_rules": op10_quality_rules,
        "op11_resample": op11_resample,
        "op12_license_scan": op12_license_scan,
        "op13_filter_audit": op13_filter_audit,
    }


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM cut
), keyed AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)'))) AS kept,
         list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS unwanted
  FROM parts
), canon AS (
  SELECT page_id, host, path, unwanted,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM keyed
), bad AS (
  SELECT DISTINCT canonical FROM canon WHERE unwanted AND canonical IS NOT NULL
), rules(verdict, rule, dom, below) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM canon, rules WHERE (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, below) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, CASE WHEN bad.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, bad.canonical IS NOT NULL AS listed
FROM canon c LEFT JOIN best b USING (page_id) LEFT JOIN bad ON bad.canonical = c.canonical
"""


OP2_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM (SELECT unnest(range(256))::UBIGINT AS n)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), places AS (
  SELECT doc_id, unnest(w) AS word FROM doc_words
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT word, list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UBIGINT) AS bytes
        FROM (SELECT word FROM places UNION SELECT word FROM item_words)), crc_table
), s AS (
  SELECT bucket, count(*) AS n FROM places JOIN buckets USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM item_words JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000) / ((s.n + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), (SELECT count(*)::DOUBLE AS all_s FROM places), (SELECT count(*)::DOUBLE AS all_t FROM item_words)
), weights AS (
  SELECT doc_id, sum(gain) AS weight FROM places JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM words LEFT JOIN labels USING (doc_id)
), failing AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM judged GROUP BY 1, 2
), orders AS (
  SELECT [v.f, w.f, x.f, y.f, z.f] AS o FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) v, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) w, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) x,
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) y, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), steps AS (
  SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), counted AS (
  SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS filter,
         sum(n) FILTER (WHERE NOT list_has_any(fails, o[1:step])) AS kept,
         sum(n) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS removed,
         sum(n) FILTER (WHERE list_contains(fails, o[step]) AND list_has_any(fails, o[1:step - 1])) AS redundant,
         sum(n) FILTER (WHERE fails = [o[step]]) AS unique_fails,
         sum(good) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS good_lost,
         sum(toxic) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS toxic_lost
  FROM failing, steps GROUP BY part, o, step
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_url_filter": OP3_SQL, "op11_resample": OP11_SQL, "op13_filter_audit": OP13_SQL}
