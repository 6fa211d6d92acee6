import math
import random
from collections import Counter

import pyarrow as pa

from seamline.llm import decontamination as D


def sample(seed):
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(120)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(words) for _ in range(n)) + "."
    items = [(i, f"{text(r.randrange(8, 30)).capitalize()} {text(r.randrange(3, 12)).capitalize()}") for i in range(40)] + [(90, ""), (91, "?!"), (92, None), (93, "one"), (94, "Only one sentence here of several words.")]
    docs = []
    for _ in range(60):
        parts = [text(r.randrange(1, 200))]
        if r.random() < 0.6:
            parts.insert(r.randrange(2), r.choice(items[:40])[1].upper() if r.random() < 0.3 else r.choice(items[:40])[1])
        docs.append("\n".join(parts))
    return items, [*docs, "", " ", items[0][1].split(".")[0], "only one sentence here of several words"]


def test_search_against_plain_bm25(spark):
    items, docs = sample(1)
    index = D.Index.of([x for x in items if D.plain_words(x[1])])
    counts = [Counter(q + a) for q, a in zip(index.questions, index.answers)]
    n, mean = len(counts), sum(sum(c.values()) for c in counts) / len(counts)
    df = Counter(t for c in counts for t in c)
    terms = index.terms.to_pylist()
    pairs = [(p, terms.index(t)) for p, d in enumerate(docs) for t in sorted(set(D.plain_words(d)) & set(terms))]
    pairs.sort()
    import numpy as np

    for threshold in (0.3, 0.6, 0.9):
        index = D.Index.of([x for x in items if D.plain_words(x[1])], threshold)
        got = {(int(p), int(i)): s for p, i, s in zip(*D.search(index, np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]), threshold))}
        for p, d in enumerate(docs):
            words = set(D.plain_words(d))
            for i, c in enumerate(counts):
                w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, f in c.items()}
                score = sum(x for t, x in w.items() if t in words) / sum(w.values())
                if abs(score - threshold) > 1e-6:
                    assert ((p, i) in got) == (score >= threshold)


def plain_matches(items, docs, whole):
    """(text number, item id) to best score and overlaps: BM25 of every window by plain loops."""
    split = {k: D.question_and_answer(t) for k, (_, t) in enumerate(items)}
    mean, out = whole.words / whole.items, {}
    for i, d in enumerate(docs):
        words = D.plain_words(d)
        for k, (q, a) in split.items():
            c = Counter(q + a)
            w = {t: math.log(1 + (whole.items - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, f in c.items()}
            for s in range(0, max(1, len(words)), whole.span):
                window = words[s : s + 2 * whole.span]
                score = sum(x for t, x in w.items() if t in window) / sum(w.values())
                found = score, D.overlap(q, window), D.overlap(a, window)
                if score >= D.THRESHOLD - 1e-9 and found[1] >= D.QUESTION and found[2] >= D.ANSWER:
                    out[i, items[k][0]] = max(out.get((i, items[k][0]), (0, 0, 0)), found)
    return {k: tuple(round(x, 9) for x in v) for k, v in out.items()}


def test_matches_against_plain_windows():
    for seed in (2, 7):
        items, docs = sample(seed)
        good = [x for x in items if D.plain_words(x[1])]
        counts = [Counter(w for part in D.question_and_answer(t) for w in part) for _, t in good]
        whole = D.Whole(len(good), sum(sum(c.values()) for c in counts), max(sum(c.values()) for c in counts), Counter(t for c in counts for t in c))
        index = D.Index.of(good)
        got = {(r, index.ids[i]): tuple(round(x, 9) for x in v) for (r, i), v in D.matches(pa.array(docs, pa.large_string()), index).items()}
        want = plain_matches(good, docs, whole)
        assert got == want and len(got) > 20
        # every text that holds an item as it is, is found
        for i, d in enumerate(docs):
            words = D.plain_words(d)
            for k, text in good:
                own = D.plain_words(text)
                assert (i, k) in got or not any(words[s : s + len(own)] == own for s in range(len(words) - len(own) + 1))
        # the same in parts
        parts = [D.Index.of(good[k : k + 7], whole=whole) for k in range(0, len(good), 7)]
        assert {(r, x.ids[i]): tuple(round(y, 9) for y in v) for x in parts for (r, i), v in D.matches(pa.array(docs, pa.large_string()), x).items()} == want


def test_an_item_is_found_in_its_own_text_whatever_its_script():
    items = [(1, "ΣΟΦΟΣ ΛΟΓΟΣ ΤΙΣ ΕΣΤΙΝ ΟΔΟΣ. ΟΥΔΕΙΣ ΟΙΔΕΝ ΟΔΟΣ."), (2, "İSTANBUL İL İÇİN NERESİ. İZMİR İLİ OLUR BU."), (3, "e\u0301te\u0301 ou hiver. C'est l\u2019e\u0301te\u0301, _oui_.")]
    texts = [t for _, t in items] + [items[0][1].lower(), "x " * 50_000 + items[1][1] + " y" * 50_000]
    index = D.Index.of(items)
    assert {(r, index.ids[i]) for r, i in D.matches(pa.array(texts, pa.large_string()), index)} >= {(0, 1), (1, 2), (2, 3), (4, 2)}


def test_tables(spark):
    items, docs = sample(3)
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(500, None, "x"), (None, items[0][1], "x"), (501, items[0][1], "x"), (501, items[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.contaminated(df, bench).collect()
    assert sum(r.doc_id == 501 and r.item_id == 0 for r in found) == 2 and any(r.doc_id is None for r in found)
    assert sorted(set((str(r.doc_id), r.item_id) for r in D.contaminated(df, bench).collect())) == sorted(set((str(r.doc_id), r.item_id) for r in found))
    clean = D.decontaminate(df, bench)
    bad = {r.doc_id for r in found}
    assert clean.schema == df.schema and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, *_ in rows if d not in bad)
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0 and D.decontaminate(df, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_cover_all(spark):
    items, docs = sample(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = next(D.indexes(bench))
    parts = list(D.indexes(bench, most_items=7))
    assert [i for x in parts for i in x.ids] == whole.ids and max(len(x.ids) for x in parts) <= 7
    assert {x.span for x in parts} == {whole.span}
    impacts = lambda x: {(x.ids[i], t): round(float(v), 9) for k, t in enumerate(x.terms.to_pylist()) for i, v in zip(x.item[x.at[k] : x.at[k + 1]], x.impact[x.at[k] : x.at[k + 1]])}
    assert {k: v for x in parts for k, v in impacts(x).items()} == impacts(whole)
