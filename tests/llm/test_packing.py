import math

import numpy as np

from seamline.llm import packing as P

TEXTS = [None, "", " \n", "The cat's tail. THE CAT, İstanbul ΑΣ <|endoftext|> don't 12,5 e.g. 東京", "a " * 9000, "word " * 4095, "x" * 5000] + [f"text {i} " * (i * 7 % 300) for i in range(120)]


def pack(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, offset int")
    return P.harmonic_pack(df.repartition(2), P.vocabulary(), **more).collect()


def test_every_id_once_in_order_and_gapless(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.vocabulary())
    rows = pack(spark, TEXTS)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        pieces, at = sorted(docs[i], key=lambda r: r.start), 0
        for p in pieces:
            assert p.start == at and p.length == len(p.ids) // 4
            at += p.length
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist()
        assert got == own.encode(text or "", add_special_tokens=False).ids + [2]
        assert {p.doc_tokens for p in pieces} == {at}
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.03 * total


def test_cut():
    for tokens in [*range(1, 5000, 7), 4096, 8192, 12289]:
        sizes = P.cut(tokens, 4096, 32)
        assert sum(sizes) == tokens and max(sizes) <= 4096 and len(sizes) <= tokens // 4096 + 4


def test_small_capacity_and_empty_table(spark):
    rows = pack(spark, TEXTS[:6], capacity=64, slack=4)
    assert max(r.length for r in rows) <= 64
    assert pack(spark, []) == []


def test_every_letter_before_a_stop_has_the_tokenizers_ids():
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.vocabulary())
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" and (c < 0x3400 or 0xF900 <= c < 0x1FFFF or c % 97 == 0)]
    texts = ["İ.", "Aİ, x İ. y", "\u0958, \ufb1d.", "ß. ẞ, ǆ. ŉ,"] + [" ".join(f"{x}. a{x}, {x}" for x in letters[k : k + 200]) for k in range(0, len(letters), 200)]
    ids, counts = P.WordTokens(P.vocabulary())(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == own.encode(text, add_special_tokens=False).ids


def test_query_has_the_tokenizers_ids(spark):
    import zlib

    from tokenizers import Tokenizer

    own, sf = Tokenizer.from_file(P.vocabulary()), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.op3_harmonic_packing(spark, sf).collect()
    seen = dict.fromkeys(texts, 0)
    for r in rows:
        ids = np.array([*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert all(seen[d] == len(own.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items())


def test_word_table_that_forgets():
    import pyarrow as pa

    small, large = P.WordTokens(P.vocabulary(), most=200), P.WordTokens(P.vocabulary())
    for k in range(6):
        texts = pa.array([" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}, the." for i in range(k * 20, k * 20 + 80))], pa.large_string())
        for a, b in zip(small(texts), large(texts)):
            assert a.tolist() == b.tolist()
    assert len(small.known) < 400 and math.isfinite(len(large.known))
