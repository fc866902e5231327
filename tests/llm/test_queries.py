"""The registered queries and the pipeline on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from tablewright.llm.queries import QUERIES
from tablewright.scratch import written


def test_queries_return_a_row_for_each_document(spark, sf):
    tables = {"op7_warc": "pages"}
    others = ("op9_decontaminate", "op11_divergence", "op12_prefixes")
    for name, run in QUERIES.items():
        rows = run(spark, sf)
        n = spark.read.parquet(f"{sf}/{tables.get(name, 'documents')}.parquet").count()
        if name == "op2_pack":
            assert rows.where("piece = 0").count() == n
        elif name not in others:
            assert rows.count() == n, name


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where("piece = 0").count() == before
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_one_of_each_group_stays(spark, small):
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, small.union(small.limit(20)), "").collect()}
    from tablewright.llm.jaccard import jaccard_components

    assert kept == {r.component_id for r in jaccard_components(small).collect()}
    again = corpus_pipeline.keep_one_of_each_group(spark, small.union(small), "")
    assert again.count() == len(kept)


def test_stages_keep_columns_of_any_name(spark, sf):
    """Names that operators use for columns of their own come through unchanged."""
    names = ["score", "spans", "base", "n_hex", "_assign", "_clean", "_text_hash", "_nth", "_rest", "a.b", "component_id"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns, name
    wrong = " OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)
    assert docs.count() > 0 and docs.where(wrong).count() == 0
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_masked_texts_hold_no_secret_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect()}
    from tablewright.llm import secret_scan

    rows = secret_scan.scan_secrets(docs).select("doc_id", "text", "spans").collect()
    assert len(rows) == len(masked)
    for r in rows:
        out, at = "", 0
        for s in r.spans:
            if s.start >= at:
                out += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert masked[r.doc_id] == (out + (r.text or "")[at:])
