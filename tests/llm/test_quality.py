import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from seamline.llm import quality as Q

ODD = [None, "", " \t\n", "a b c a b c", "x\x1cy\x85z", "é É!! #$% <b>|", "a\n\na\n a\nb\n", "one two\n" * 40, "\u00a0 w \u3000", "w " * 300, "A.B?C! " * 60]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), len(lines), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[!?.,;:]", text))]


def test_measures():
    got = Q.measures(pa.array([t or "" for t in ODD], pa.large_string()))
    assert [list(map(int, r)) for r in zip(*got)] == [brute(t) for t in ODD]


def test_sketch_buckets_bound_the_error(spark):
    df = spark.range(1, 200_000, 37).selectExpr("id as x").withColumn("b", F.expr(Q.bucket("x"))).withColumn("low", F.expr(Q.bucket_floor("b")))
    assert df.filter("low > x or low * 32 < x * 31 - 32").count() == 0
    assert df.filter("x < 64 and low <> x").count() == 0


def docs(spark):
    good = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}x{k}" for k in range(80 + i % 9)), "en", "s" if i % 2 else None) for i in range(80)]
    bad = [(1000, " ".join(f"W{k}### $$$" for k in range(90)), "en", "s"), (1001, " ".join(f"WORD{chr(65 + k % 26)}{chr(65 + k // 26)}!!" for k in range(90)), "en", "s"), (1002, "short", "en", "s"), (1003, "same " * 90, "en", None), (1004, None, None, None)]
    return spark.createDataFrame([(*r, 5, True, "c") for r in good + bad + good[:1]], "doc_id long, text string, lang string, source string, n_words int, kept boolean, limit_symbols string")


def test_verdicts_and_repeated_rows(spark):
    rows = Q.judge(docs(spark)).collect()
    assert len(rows) == 86
    assert {r.doc_id for r in rows if not r.kept} == {1000, 1001, 1002, 1003, 1004}
    assert {r.doc_id for r in rows if r.base_failed} == {1002, 1003, 1004}


def test_filter_keeps_columns_that_clash(spark):
    df = docs(spark)
    kept = Q.keep_good(df)
    assert kept.schema == df.schema and kept.count() == 81 and {r.kept for r in kept.collect()} == {True}
    assert Q.keep_good(df.limit(0)).count() == 0 and Q.judge(df.limit(0)).count() == 0
