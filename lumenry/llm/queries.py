"""The training-data operators as queries over the given tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import bpe_verify, chat_repair, compress_quality, decontaminate, html_text, language_id, line_rules, near_dup, substring_dedup, token_codes
from lumenry.llm.common import crc_of_id, materialize, table


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rules(table(spark, sf_dir, "documents"))


def op3_bpe_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_verify.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), length=50)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 4 == 2
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    sample = compress_quality.sample_labels(labels)  # at most TRAIN_ROWS rows of each label
    learned = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled-sample")
    model = compress_quality.fit(learned, totals=compress_quality.count_labels(docs, labels))
    return compress_quality.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_codes, op2_line_rules, op3_bpe_verify, op4_substring_dedup, op5_language_id, op6_chat_repair, op7_decontaminate, op8_html_text, op9_compress_quality, op10_near_dup, pipeline)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT doc_id, s FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, s), unnest(range(0, 3)) AS t(j) GROUP BY 1),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, coalesce(source, '') AS source, line, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n_docs FROM (SELECT coalesce(source, '') AS source, doc_id FROM documents) GROUP BY 1),
often AS (SELECT source, k, count(DISTINCT doc_id) AS c FROM ln GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {line_rules.MOST_DOCS}),
freq AS (SELECT source, k FROM often JOIN hosts USING (source) WHERE 100 * c > {line_rules.MOST_SHARE} * n_docs),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u, sum(length(line)) AS total, coalesce(sum(length(line)) FILTER ((source, k) IN (SELECT (source, k) FROM freq)), 0) AS removed FROM ln GROUP BY 1),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_chars_removed, coalesce(total, 0) AS total FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * n_chars_removed > {line_rules.MOST_REMOVED} * total AS kept, n_chars_removed FROM base
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS f FROM win GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN firsts USING (h), unnest(range(0, 50)) AS t(j) WHERE f < doc_id),
words AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = words.doc_id AND hit.p = words.p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM iw) AS ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)),
hits AS (SELECT doc_id, i, iw.k AS k, item FROM dw JOIN iw ON iw.s = dw.s AND iw.k = dw.k),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, unnest(range(0, k)) AS t(j) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say it: tokenizers, trained models, HTML and the turn automaton are held against brute force in tests."""
    return {"op2_line_rules": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_decontaminate": OP7_SQL, "op10_near_dup": OP10_SQL}
