"""The pipeline's stages, each on what its predecessor kept."""

from __future__ import annotations

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lumenry.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, None, 0), (900_002, "12 34", "en", "s", 5), (None, "the words of a document without an id", "en", "s", 37)], docs.schema)
    docs, texts = docs.unionByName(extra), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        docs = stage(spark, before, DATA)
        assert docs.columns == before.columns, name
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 900_001 not in texts["language"] and 900_002 not in texts["language"] and None in texts["language"]
    assert set(texts["near_duplicates"]) < set(texts["language"])
    assert set(texts["repeated_passages"]) == set(texts["near_duplicates"])
    assert any(t != texts["near_duplicates"][d] for d, t in texts["repeated_passages"].items())
    assert any(t != texts["repeated_passages"][d] for d, t in texts["benchmark_passages"].items())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.tokens(spark, docs, DATA).collect():
        ids = tok.encode(texts["benchmark_passages"][r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_stages_of_empty_tables_and_repeated_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.limit(0), DATA)
        assert got.columns == docs.columns and got.count() == 0, name
    assert corpus_pipeline.tokens(spark, docs.limit(0), DATA).count() == 0
    rows = [(1, "one two three four five six seven", "en", "s", 9), (1, "one two three four five six seven", "en", "t", 9), (1, "an other text", "en", "u", 9), (5, None, None, None, None)]
    rows += [(None, "one two three four five six seven", "en", "v", 1), (9, "one two three four five six seven", "en", "w", 2)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), DATA).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in kept) == [(0, rows[0][1], 1), (1, "an other text", 9), (5, "", 0)]
    clash = docs.withColumns({"spans": docs.doc_id, "verdicts": docs.text, "k1": docs.text, "_other0": docs.doc_id, "lang_pred": docs.text, "score": docs.n_chars})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clash.limit(30).write.mode("overwrite").parquet(str(tmp_path / "c"))
        assert stage(spark, spark.read.parquet(str(tmp_path / "c")), DATA).columns == clash.columns, name
