import corpus_pipeline
from tidemark.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = docs.count()
        assert after <= before, name
        if name == "quality":
            kept = {r["doc_id"] for r in docs.collect()}
            assert all(d in kept for d, q in labels.items() if q == 1)
        if name == "near_duplicates":
            again = simhash.near_duplicates(docs)
            assert again.where("doc_id <> component_id").count() == 0
        before = after
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(done) == before and all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in done)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_all_stages_hold_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
