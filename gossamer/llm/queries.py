"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import article, bpe, garbled, leaks, lines, seen, sentences, spam, variants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "responses")).select("request_id")


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """The garbled pages with the text restored where it can be."""
    return garbled.garbled(table(spark, d, "responses"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_in([(table(spark, d, "url_queue"), "url_queue", "entry_id", "u"), (table(spark, d, "hash_log"), "hash_log", "rec_id", "ha_hv")])


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    a = seen.error_rate(table(spark, d, "url_queue"), "url_queue", "entry_id", "u")
    return a.unionByName(seen.error_rate(table(spark, d, "hash_log"), "hash_log", "rec_id", "ha_hv"))


def p2_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last fifth of the URLs, by arrival, against the sealed index of all earlier ones."""
    q = table(spark, d, "url_queue").select("entry_id", "u")
    last = q.agg(F.max("entry_id")).first()[0] or 0
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = seen.seal(q.filter(F.col("entry_id") <= 0.8 * last), "u", shards)
    return seen.seen_in_index(q.filter(F.col("entry_id") > 0.8 * last), "url_queue", "entry_id", "u", index, shards)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_groups(
        [
            (table(spark, d, "responses"), "responses", "request_id", variants.url_form(F.col("page_url"))),
            (table(spark, d, "aliases"), "aliases", "alias_id", variants.alias_form(F.col("hid"), F.col("alias_id"), F.col("alias"))),
            (table(spark, d, "hosts"), "hosts", "hid", variants.host_form(F.col("hostname"))),
        ]
    )


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row for each group of copies: its smallest id and the number of records."""
    return p3_found(spark, d).groupBy("tab", "keep_id").agg((F.count(F.lit(1)) + 1).alias("copies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_line_numbers(table(spark, d, "responses"))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each site with the pages they stand in."""
    return lines.repeated_lines(table(spark, d, "responses")).withColumnRenamed("source", "queue_id")


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages without the repeated lines."""
    return lines.without_repeated_lines(table(spark, d, "responses"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return article.article_lines(table(spark, d, "responses"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "responses"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Leaked and reworded passages with the measures that tell them."""
    return leaks.similar_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


P2 = """
SELECT 'url_queue' AS tab, entry_id AS rec_id FROM (SELECT entry_id, min(entry_id) OVER (PARTITION BY u) AS m FROM url_queue WHERE u IS NOT NULL) WHERE entry_id > m
UNION ALL
SELECT 'hash_log' AS tab, rec_id FROM (SELECT rec_id, min(rec_id) OVER (PARTITION BY ha_hv) AS m FROM hash_log WHERE ha_hv IS NOT NULL) WHERE rec_id > m
"""


P5 = r"""
WITH l AS (
  SELECT DISTINCT request_id, queue_id, unnest(generate_series(0, len(string_split(page, chr(10))) - 1)) AS line_no, unnest(string_split(page, chr(10))) AS line
  FROM responses WHERE page IS NOT NULL AND queue_id IS NOT NULL),
s AS (SELECT request_id, queue_id, line_no, trim(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{B}]+', ' ', 'g')) AS shown FROM l),
c AS (SELECT queue_id, shown, count(DISTINCT request_id) AS n FROM s WHERE regexp_matches(shown, '\p{L}') GROUP BY ALL HAVING n >= 10)
"""
P5_FOUND = P5 + "SELECT s.request_id, CAST(s.line_no AS INTEGER) AS line_no FROM s JOIN c USING (queue_id, shown)"
P5_LINES = P5 + "SELECT queue_id, shown AS line, n FROM c"


def _grams(table: str, key: str, n: int, joined: bool, where: str) -> str:
    """Runs of ``n`` words, or of ``n`` joined letters and digits, of each text."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    if joined:
        return f"SELECT DISTINCT {key}, substr(j, k, {n}) AS g FROM (SELECT {key}, j, unnest(range(1, length(j) - {n} + 2)) AS k FROM (SELECT {key}, array_to_string({words}, '') AS j FROM {table} WHERE {where}) WHERE length(j) >= {n})"
    return f"SELECT DISTINCT {key}, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n} + 2)) AS k FROM (SELECT {key}, {words} AS w FROM {table} WHERE {where}) WHERE len(w) >= {n})"


P9 = " UNION ".join(
    f"SELECT doc_id, item_id FROM ({_grams('documents', 'doc_id', n, zh, 'text IS NOT NULL')}) JOIN ({_grams('eval_items', 'item_id', n, zh, f'text IS NOT NULL AND (lang = {chr(39)}zh{chr(39)}) = {zh}')}) USING (g)" for n, zh in ((10, False), (20, True))
)


def oracle_sql() -> dict[str, str]:
    late = P2.split("UNION ALL")[0] + " AND entry_id > 0.8 * (SELECT max(entry_id) FROM url_queue)"
    return {"p2_found": P2, "p2_new_batch": late, "p5_found": P5_FOUND, "p5_lines": P5_LINES, "p9_found": P9}
