import corpus_pipeline
from tidemark.llm import stages
from tidemark.llm.common import written


def test_stages_pass_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), "test")
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= ids and kept and docs.count() == len(kept)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = kept
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == ids and set(columns) < set(out.columns) and out.where("text is null").count() == 0


def test_passages_go_from_the_text_and_its_length(spark, sf):
    p = " ".join(f"passage{k * k % 91}x{k}" for k in range(60))
    docs = spark.createDataFrame([(1, p, "en", "a", len(p)), (2, f"{p} tail of two", "en", "a", len(p) + 12), (3, p, "en", "a", len(p)), (4, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in stages.drop_repeated_passages(spark, docs, sf).collect()}
    assert out[1]["text"] == p and out[2]["n_chars"] == len(out[2]["text"]) < 60 and 3 not in out and out[4]["text"] is None


def test_odd_rows_in_every_stage(spark, odd, none, sf):
    docs = odd.selectExpr("*", "'en' AS lang", "length(text) AS n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns, name
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0
