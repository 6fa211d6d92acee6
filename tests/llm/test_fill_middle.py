"""Fill-in-middle: the split keeps every unit, and outputs give the text back."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from seamline.llm import fill_middle as M


def plain(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_against_a_plain_version(spark):
    r = random.Random(3)
    alphabet = ["a", "Bc", " ", "\n", "\r\n", "é", "é", "😀", "\U00010348", "<", ">", "P", "<S", "1", "\t", " ", "\x00", "Z" * 30]
    texts = ["", None, "a", " ", "\n", "abc", "😀", "a\n", "\n\n", "x<P>y", "<S>", "a<M", "word " * 20_000] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[20], rows[20]], "doc_id long, text string, form string, n long")
    made = M.fill_in_middle(docs)
    got = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert all(x.back == x.text for x in got)
    assert sorted(((x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got), key=str) == sorted((plain(d, t or "") for d, t, *_ in [*rows, rows[20], rows[20]]), key=str)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0


def test_another_grammar(spark):
    digits = spark.createDataFrame([("12a 3",), ("",), ("x",)], "text string")
    assert [r[0] for r in digits.select(M.pieces_of(F.col("text"), M.Units("0-9"))).collect()] == [["12", "a", " ", "3"], [], ["x"]]
