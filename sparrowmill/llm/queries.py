"""The registered queries of the llm operators: each applies one to its whole table, with production parameters.

Three have SQL twins.  The others' results depend on fitted models, draws, positions in texts or files, which SQL can't express; tests
compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowmill.llm import decontam, html_text, langid, mixing, neardup, packing, pii, quality, substring, warc
from sparrowmill.llm.common import read_table, shuffle_partitions


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(spark, read_table(spark, sf_dir, "pages"), shuffle_partitions(spark))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, ~langid.held_out("doc_id")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read_table(spark, sf_dir, "documents"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_files(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_pii, op2_html_text, op3_warc, op4_language, op5_mixing, op6_near_duplicates, op7_token_packing, op8_quality, op9_decontamination, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": r"""
WITH s AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
     t AS (SELECT x, max(page_id) AS top FROM s GROUP BY x),
     d AS (SELECT x, top, list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(1, 6), lambda j: (instr('0123456789abcdef', substr(x, CAST(5 * k + j AS INTEGER), 1)) - 1)), lambda a, b: a * 16 + b)) AS v FROM t)
SELECT s.page_id, s.url, CAST(s.payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((d.v[CAST(1 + i // 4 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN s.page_id = d.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN s.page_id <> d.top THEN d.top END AS refers_to
FROM s JOIN d ON s.x = d.x""",
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS g FROM w WHERE len(ws) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
     e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     r(i, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.b, r.m FROM r JOIN both_ways ON r.i = both_ways.a),
     k AS (SELECT i, min(m) AS component_id FROM r GROUP BY i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents AS d JOIN k ON k.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
     g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i : i + 19], ' '))) AS g FROM d WHERE len(ws) >= 20),
     f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS late FROM g),
     x AS (SELECT w.doc_id, w.pos, w.word, coalesce(max(CASE WHEN f.late THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
           FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.pos = w.pos),
     y AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(y.n_words, 0) AS n_words, CAST(coalesce(y.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON y.doc_id = d.doc_id""",
}
