"""From documents to tokens: language, near duplicates, repeated passages, benchmark passages, tokens.

Each stage reads what its predecessor kept, as a written table. SQL can't express the stages (trained machines, MinHash,
byte-pair merges), so tests hold them against brute force instead. Empty tables stay empty; columns beside doc_id and text
are carried and may have any name; null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.llm import bpe_verify, decontaminate, language_id, near_dup, substring_dedup
from lumenry.llm.common import crc_of_id, materialize, table

ORACLE_SQL = None
#: Documents of which more than this share is benchmark passages go altogether.
MOST_HIT = 0.5
#: Documents whose language has a lower score go: two families of two languages give 0.25 where nothing can be told.
LEAST_SCORE = 0.4


def _others(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list[str]]:
    """``docs`` as doc_id, text and renamed other columns, whose names then clash with nothing; and their own order."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    safe = tuple(f"_other{i}" for i in range(len(names)))
    return docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(s) for c, s in zip(names, safe, strict=True))), safe, names


def _back(rows: DataFrame, text: str, safe: tuple[str, ...], names: list[str], order: list[str]) -> DataFrame:
    """The columns of documents in their order; n_chars follows the text."""
    of = {"doc_id": F.col("doc_id"), "text": F.col(text)} | {c: F.col(s) for c, s in zip(names, safe, strict=True)}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col(text).isNull(), of["n_chars"]).otherwise(F.char_length(text).cast("bigint"))
    return rows.select(*(of[c].alias(c) for c in order))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go, and those whose language scores under LEAST_SCORE.

    Learns from documents whose crc32 mod 4 isn't 2. Where nothing can be learned, no language can be told.
    """
    model = language_id.fit(docs.filter(crc_of_id() % 4 != 2))
    given, safe, names = _others(docs)
    kept = language_id.predict(given, model, *safe, keep_text=True).filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return _back(kept, "text", safe, names, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component at similarity 0.8 on five-word shingles.

    Of rows with one doc_id that of the least text stays, any of them if texts are the same; rows without a doc_id stay.
    """
    verdicts = near_dup.near_duplicates(docs, size=5, percent=80).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    told = materialize(verdicts.filter("doc_id is not null and (not kept or n > 1)"), "verdicts")
    order = [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.join(told.select("doc_id"), "doc_id", "left_anti").select(*order)
    again = told.filter("kept").select("doc_id")
    if again.isEmpty():
        return rest
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return rest.unionByName(docs.join(again, "doc_id", "left_semi").withColumn("_once", once).filter("_once = 1").select(*order))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-word windows that an earlier one has."""
    given, safe, names = _others(docs)
    return _back(substring_dedup.dedup(given, 50, keep_text=True, carry=safe), "kept_text", safe, names, docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that mostly consist of them go."""
    given, safe, names = _others(docs)
    rows = decontaminate.decontaminate(given, table(spark, sf_dir, "benchmark"), 10, MOST_HIT, keep_text=True, carry=safe)
    return _back(rows.filter((F.col("n_hit") == 0) | F.col("kept_text").isNotNull()), "kept_text", safe, names, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and hashes of its ids and decoded text."""
    return bpe_verify.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
