"""Counts at every prefix are those of the model's library."""

import random

import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from sentencepiece import SentencePieceProcessor

from seamline.llm import prefix_tokens as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=T.model_path())


def texts(pieces):
    r = random.Random(11)
    found = ["", " ", "  a", "▁", "a" * 700, " " * 600, "\n\n\t", "日本語テキスト", "😀x😀", "<s> hi </s> <0x0A> <unk>", "ﬁ Ⅳ é é", "A\x00b", "ab" * 300 + " x"]
    for _ in range(120):
        found.append("".join(r.choice(pieces) for _ in range(r.randrange(1, 12))))
        found.append("".join(r.choice("ab  eè\nß日t") for _ in range(r.randrange(60))))
        found.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(r.randrange(40))))
    return found


def test_every_prefix_by_the_library(library):
    own = T.Pieces(T.model_path())
    some = texts(own.text)
    counts, sizes = own.prefixes(pa.array(some, pa.large_string()))
    end = 0
    for text, n in zip(some, sizes.tolist()):
        want = library.encode([text[: i + 1] for i in range(len(text))])
        assert counts[end : end + n].tolist() == [len(x) for x in want], text
        end += n
    assert end == len(counts)


def test_long_runs_side_by_side_and_one_by_one(monkeypatch):
    own = T.Pieces(T.model_path())
    some = pa.array(["abcde" * 40, "x" * 300, "", "thethethe" * 30], pa.large_string())
    whole = own.prefixes(some)[0].tolist()
    monkeypatch.setattr(T, "LONG", 3)
    assert own.prefixes(some)[0].tolist() == whole


def test_query_on_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in T.op11_prefix_tokens(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        text, own = r.text or "", got[r.doc_id]
        n = len(library.encode(text))
        assert (own.n_bytes, own.n_tokens, own.over_limit) == (len(text.encode()), n, n > 4096)
        assert own.fits_chars == len(text) if n <= 4096 else own.fits_chars < len(text) and len(library.encode(text[: own.fits_chars])) <= 4096


def test_limits_from_stored_counts(spark, library):
    rows = [(1, "the internationalization of  prefixes"), (2, ""), (3, None), (None, "x" * 50), (1, "the internationalization of  prefixes"), (4, "é\n" * 5)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, counts string")
    stored = T.count_prefixes(docs, T.model_path(), limit=5, keep_counts=True)
    found = stored.select("*", T.prefix_within(F.col("counts"), F.lit(5)).alias("within"), T.tokens_of_prefix(F.col("counts"), F.lit(7)).alias("seven")).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(a) for a, _ in rows)
    for r in found:
        text = next(b for a, b in rows if a == r.doc_id) or ""
        best = max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 5)
        assert (r.within, r.fits_chars, r.seven) == (best, best, len(library.encode(text[:7])))
    assert T.count_prefixes(docs.limit(0), T.model_path()).count() == 0
