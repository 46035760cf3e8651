"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowline.llm import url_filter
from stowline.llm.decontamination import contamination
from stowline.llm.filter_audit import filter_audit
from stowline.llm.html_text import extract_text
from stowline.llm.kd_shards import shard_documents
from stowline.llm.near_dup import near_duplicates
from stowline.llm.packing import pack
from stowline.llm.periodic_runs import periodic_runs
from stowline.llm.pii import personal_data
from stowline.llm.quality import judge_documents
from stowline.llm.tables import table
from stowline.llm.token_count import count_tokens
from stowline.llm.token_files import read_files, write_files
from stowline.llm.warc import archived_pages

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SEQUENCE = 2048
SHARDS = 16


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge_urls(pages, URL_RULES, model)


def op2_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op3_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_documents(table(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest, files = write_files(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return read_files(spark, manifest, files, "doc_id", docs.schema["doc_id"].dataType.simpleString())


def op9_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = shard_documents(table(spark, folder, "documents"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END_ID, SEQUENCE)


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(table(spark, folder, "documents"))


QUERIES = {
    name: function for name, function in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}

_WORDS6 = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT d, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d, n
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d, n)
"""

_OP6 = f"""
WITH doc AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
item AS (SELECT item_id, {_WORDS6} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM item_window),
doc_window AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc JOIN sizes ON len(w) >= k)
),
hit AS (SELECT doc_id, item_id, i, k FROM doc_window JOIN item_window USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS7 = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP7 = f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, {_WORDS7} AS w FROM documents
),
line AS (
  SELECT doc_id, host, text, i, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n,
         substr(md5(array_to_string(regexp_extract_all(
           translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\\x20\\x09-\\x0D]+'), ' ')), 1, 16) AS plain
  FROM (SELECT doc_id, host, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, ls[i] AS l FROM doc)
),
dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM line WHERE n > 0 GROUP BY doc_id, l) GROUP BY doc_id
),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)
),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
),
host_line AS (SELECT host, text, plain, sum(n) AS n FROM (SELECT DISTINCT host, text, i, plain, n FROM line WHERE n > 0) GROUP BY host, text, plain),
shared AS (SELECT host, plain FROM host_line GROUP BY host, plain HAVING count(*) > 20),
held AS (
  SELECT host, text, sum(n) AS n, array_to_string(list_sort(list(plain))[1:2], ' ') AS least FROM host_line JOIN shared USING (host, plain) GROUP BY host, text
),
keyed AS (
  SELECT host, text, CASE WHEN len({_WORDS7}) - n < len({_WORDS7}) * 0.2 THEN least ELSE 'text ' || text END AS key FROM held
),
host_keys AS (
  SELECT host, count(DISTINCT coalesce(key, 'text ' || text)) AS t FROM (SELECT DISTINCT host, text FROM doc) LEFT JOIN keyed USING (host, text) GROUP BY host
),
often AS (
  SELECT host, plain FROM (
    SELECT host, plain, count(DISTINCT key) AS c FROM host_line JOIN shared USING (host, plain) JOIN keyed USING (host, text) GROUP BY host, plain
  ) JOIN host_keys USING (host)
  WHERE c > 20 AND c > t * 0.05
),
gone AS (SELECT doc_id, sum(n) AS n FROM line JOIN often USING (host, plain) GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_frequent_words
  FROM doc LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= n_words * 0.2 AS kept
FROM facts
"""

_OP12 = f"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS7} AS w FROM documents),
first AS (SELECT text, min(doc_id) AS lo FROM doc GROUP BY text),
mark AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask
  FROM doc JOIN first USING (text) LEFT JOIN mark USING (doc_id)
),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a JOIN letter b ON b.bit <> a.bit JOIN letter c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letter d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letter e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step)
),
counted AS (
  SELECT part, filter_order, step::INT AS step, bit,
         coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM cell CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

ORACLE = {"op4_warc": _OP4, "op6_decontamination": _OP6, "op7_quality": _OP7, "op12_filter_audit": _OP12}
