"""Quality rules on words and on lines that many documents of a host share, all in DataFrame functions.

Lines are normalised (lower case, single spaces) and hashed; for each host and hash the documents are counted. A line in
more than ``most_docs`` documents of the host and more than ``most_share`` percent of them is removed, and a document that
loses more than ``most_removed`` percent of its characters is rejected as depleted. A document's own counts are array
functions of its row and shuffle nothing; repeated windows are found by sorting their hashes, so very long texts cost
n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
MOST_DOCS, MOST_SHARE, MOST_REMOVED = 4, 5, 70


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("text", SPACE), lambda x: x != "").alias("words"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", NOT_SPACE + "+", ""))).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        _lines(F.col("text")).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("line_chars"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    windows = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    window = lambda i: F.struct(F.xxhash64(F.get("hashed", i), F.get("hashed", i + 1), F.get("hashed", i + 2)).alias("h"), i.alias("p"))
    kept = ["doc_id", "line_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(*kept, F.sort_array(F.transform(windows, window)).alias("sorted"))
    same = lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]) | (F.get("sorted", i + 1)["h"] == x["h"])
    rows = rows.select(*kept, F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("at", start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    rows = rows.select(*kept, covered.alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def _line_key(host: str, line: Column) -> Column:
    return F.xxhash64(_host(host), F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))))


def hashed_lines(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, at, k, chars, first) of each line with a word: k hashes host and normalised line, at the host alone; first:
    the row's first of its kind."""
    rows = docs.select("doc_id", F.col(host), _lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", F.xxhash64(_host(host)).alias("at"), F.sort_array(F.transform("lines", lambda x: F.struct(_line_key(host, x).alias("k"), F.char_length(x).alias("chars")))).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct(x["k"].alias("k"), x["chars"].alias("chars"), F.when(F.get("lines", i - 1)["k"] == x["k"], 0).otherwise(1).alias("first")))
    return rows.select("doc_id", "at", F.inline(marked))


def _frequent(docs: DataFrame, host: str, lines: DataFrame, most_docs: int, most_share: int) -> DataFrame:
    """Hashes of lines in too many documents of their host: rows of one doc_id are one document, rows without are none.

    Only lines in more rows than ``most_docs`` can be in more documents, so only theirs are counted by doc_id.
    """
    hosts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(_host(host)).alias("at")).distinct().groupBy("at").agg(F.count("*").alias("of"))
    often = lines.groupBy("k").agg(F.sum("first").alias("rows")).filter(F.col("rows") > most_docs).select("k")
    pairs = lines.filter("first = 1 and doc_id is not null").join(often, "k", "left_semi").select("k", "at", "doc_id").distinct()
    counts = pairs.groupBy("k", "at").agg(F.count("*").alias("docs")).filter(F.col("docs") > most_docs)
    return counts.join(hosts, "at").filter(100 * F.col("docs") > most_share * F.col("of")).select("k")


def rules(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, most_share: int = MOST_SHARE, most_removed: int = MOST_REMOVED) -> DataFrame:
    """The base rules' columns, then kept and n_chars_removed.

    ``kept`` is false if the base rules fail or the document is depleted. A null host is the host "". What rows of one
    doc_id lose is added up, and rows without a doc_id are never depleted.
    """
    lines = materialize(hashed_lines(docs, host), "lines")
    frequent = _frequent(docs, host, lines, most_docs, most_share)
    removed = lines.join(frequent, "k", "left_semi").groupBy("doc_id").agg(F.sum("chars").alias("removed"))
    # written, as filters on its columns would else be pushed into the array functions and repeat them for each element
    joined = materialize(base_rules(docs), "base-rules").join(removed, "doc_id", "left")
    depleted = F.coalesce(100 * F.col("removed") > most_removed * F.col("line_chars"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("removed", F.lit(0)).alias("n_chars_removed"))


def clean(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, most_share: int = MOST_SHARE) -> DataFrame:
    """Documents (doc_id, text) with the frequent lines taken out; the rows of one doc_id are pooled, null text stays null.

    The removed hashes of a document are gathered by doc_id, which its own lines bound.
    """
    lines = materialize(hashed_lines(docs, host), "lines")
    frequent = _frequent(docs, host, lines, most_docs, most_share)
    gone = lines.join(frequent, "k", "left_semi").groupBy("doc_id").agg(F.collect_set("k").alias("gone"))
    joined = docs.select("doc_id", host, "text").join(gone, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", _line_key(host, x))), "\n")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
