import random

from seamline.llm import ngram_join as N


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    n = len(rows)
    sets = [grams(t or "") for _, t in rows]
    like = [[i != j and bool(sets[i]) and rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if like[i][j]:
                    label[i] = min(label[i], label[j])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    out = []
    for i, (d, t) in enumerate(rows):
        texts = {rows[j][1] for j in range(n) if like[i][j] and rows[j][1] != t}
        out.append((d, None if d is None else least[label[i]], sum(like[i]), len(texts)))
    return out


def sample(seed, copies=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, ""), (4, None), (5, "one two"), (6, "one two"), (None, " ".join(base)), (7, " \n "), (8, "one"), (9, " ".join(word() for _ in range(2000)))]
    for i in range(copies):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = word()
        rows.append((100 + i, " ".join(w)))
    for i in range(20):
        rows.append((300 + i, " ".join(word() for _ in range(30))))
    r.shuffle(rows)
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, bands string")
    return sorted(map(tuple, N.ngram_join(df, **more).collect()), key=str)


def test_against_brute_force(spark):
    rows = sample(1)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_large_components_by_bucket_and_blocks(spark):
    rows = sample(2)
    assert run(spark, rows, block=6) == sorted(brute(rows), key=str)


def test_components_with_hubs_and_long_paths(spark):
    from seamline.llm.components import components

    r = random.Random(4)
    edges = [(0, k) for k in range(1, 300)] + [(k, 5000) for k in range(400, 600)] + [(k, k + 1) for k in range(1000, 1130)] + [(250, 450), (None, 3), (7, 7)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(300)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for hub in (5, 100, 10_000):
        assert {x.node: x.component for x in components(df, hub).collect()} == {k: find(k) for k in label}
    assert components(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    rows = sample(3, 10) + [(1, sample(3, 10)[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows if d is not None], "doc_id long, text string, copies int")
    kept = N.keep_one(df).collect()
    classes = {c for d, c, _, _ in run(spark, [x for x in rows if x[0] is not None])}
    assert sorted(r.doc_id for r in kept) == sorted(classes)


def test_bands_reach_recall():
    b, r = N.bands_for()
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 256
