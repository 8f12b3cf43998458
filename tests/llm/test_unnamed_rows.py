"""Rows without an id are decontaminated."""

import corpus_pipeline
from llm_support import documents
from postweave.llm import queries

TEXTS = ["a b c", "a x c", "b c d", None]


def folder_of(spark, tmp_path):
    docs = documents(spark, TEXTS).select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.union(docs.selectExpr("cast(null as bigint)", *docs.columns[1:]))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_query_and_stage_search_rows_without_id(spark, tmp_path):
    folder = folder_of(spark, tmp_path)
    found = queries.op9_decontamination(spark, folder).collect()
    expected = [(3, 2, True), (3, 0, False), (3, 2, True), (0, 0, False)]
    for ours in ([r for r in found if r["doc_id"] is None], [r for r in found if r["doc_id"] is not None]):
        assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in ours) == sorted(expected)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, folder).select("doc_id", "text").collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in (
        (1, "a x c"), (3, None), (None, "a x c"), (None, None)))
