"""Every pipeline stage on null, empty, repeated and very long rows and on clashing column names."""

import random

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "host", "path", "_row", "n_lines", "n_dropped", "_n_lines", "key", "bands", "n_words", "kept", "limit_symbols", "class_id", "component", "drop", "score", "doc"]


def odd(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    plain = [" ".join(word() for _ in range(80)) for _ in range(6)]
    rows = [
        (1, plain[0], "en", "a"), (1, plain[0], "en", "a"), (2, None, None, None), (3, "", "en", None), (None, plain[1], None, "a"), (None, None, None, None), (4, plain[2], None, None), (5, plain[2], "de", "b"),
        (6, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(60_000)), "en", "a"), (7, "\n" * 50 + plain[3], "", ""), (8, plain[4] + " \u0130. \u03a3", "en", "a"), (9, "\t \n", "en", "a"),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *CLASHES) for d, t, lang, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    rows = docs.collect()
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert all(tuple(r[5:]) == tuple(CLASHES) for r in found), name
        assert {r.doc_id for r in found} <= {r.doc_id for r in rows}, name
        assert 6 in {r.doc_id for r in found}, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = C.quality_rules(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "4", "5", "6", "7", "8", "None"]
    cleaned = C.line_dedup(spark, docs, SF).collect()
    assert sorted(str((r.doc_id, r.text)) for r in cleaned) == sorted(str((r.doc_id, r.text)) for r in rows)
    single = C.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "2", "3", "4", "6", "7", "8", "9", "None", "None"]
    clean = C.benchmark_decontamination(spark, docs, SF).collect()
    assert len(clean) == len(rows)
    pieces = C.packed(spark, docs, SF)
    assert sum(r.length for r in pieces.collect()) == sum(r.doc_tokens for r in pieces.filter("start = 0").collect())
    assert pieces.filter("start = 0").count() == len(rows) and C.packed(spark, docs.limit(0), SF).count() == 0
