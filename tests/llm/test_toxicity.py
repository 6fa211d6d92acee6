import random

from pyspark.sql import functions as F

from seamline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = X.op10_toxicity(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    above = sum((b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.95 and sum(r.predicted for r in bad) > 0.85 * len(bad) and sum(r.predicted for r in good) < 0.02 * len(good)


def made(spark, n=400, kinds=(0, 1)):
    r = random.Random(1)
    rows = []
    for i in range(n):
        toxic = r.choice(kinds)
        words = [f"w{r.randrange(500)}" for _ in range(60)] + ["you grobble", "Grobbling you"] * (3 * toxic)
        r.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    docs = [(i, t, "x", 1.0) for i, t, _ in rows] + [(None, "you grobble", "x", 1.0), (n, None, "x", 1.0), (n + 1, "", "x", 1.0), (0, rows[0][1], "x", 1.0), (n + 2, "word " * 40_000, "x", 1.0)]
    labels = [(i, x) for i, _, x in rows] + [(None, 1), (5, None), (n + 9, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_odd_rows_get_scores(spark):
    docs, labels = made(spark)
    rows = X.score(docs, labels).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.held_out and truth.get(r.doc_id) is not None)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_one_class_no_labels_no_rows(spark):
    docs, labels = made(spark, 60, (0,))
    assert {round(r.score, 6) for r in X.score(docs, labels.filter("doc_id < 60")).collect()} != set()
    assert {r.score for r in X.score(docs, labels.limit(0)).collect()} == {0.5}
    assert X.score(docs.limit(0), labels).collect() == []


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = made(spark)
    flipped = labels.withColumn("toxic", F.when(X.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in X.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b
