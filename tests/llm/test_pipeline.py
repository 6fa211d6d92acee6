import corpus_pipeline as C

from seamline.llm import decontamination as D
from seamline.llm import lines, ngram_join, quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = C.quality_rules(spark, docs, SF)
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()
    cleaned = C.line_dedup(spark, kept, SF)
    want = {r.row.doc_id: r.text for r in lines.drop_boilerplate(kept).collect()}
    rows = cleaned.collect()
    assert cleaned.columns == columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    one = C.near_duplicates(spark, cleaned, SF)
    classes = {r.class_id for r in ngram_join.ngram_join(cleaned).collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == classes and one.count() == len(classes)
    clean = C.benchmark_decontamination(spark, one, SF)
    leaks = {r.doc_id for r in D.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == classes - leaks
    pieces = C.run(spark, SF)
    assert {r.doc_id for r in pieces.collect()} == classes - leaks


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
