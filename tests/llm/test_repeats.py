import random
import sys

import numpy as np

from seamline.llm import repeats as R


def brute(rows):
    seen, order, out = {}, sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)), {}
    texts = [(t or "").encode() for _, t in rows]
    for i in order:
        for p in range(len(texts[i]) - 99):
            w, at = texts[i][p : p + 100], (rows[i][0] if rows[i][0] is not None else sys.maxsize, p)
            seen[w] = min(seen.get(w, at), at)
    for i in order:
        gone = np.zeros(len(texts[i]), bool)
        for p in range(len(texts[i]) - 99):
            if seen[texts[i][p : p + 100]] < (rows[i][0] if rows[i][0] is not None else sys.maxsize, p):
                gone[p : p + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = (rows[i][0], len(texts[i]), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(texts[i], np.uint8)[~gone]))
    return sorted(out.values(), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, anchor string, until int").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.until) for s in r.spans], bytes(r.kept)) for r in R.remove_repeats(df, **more).collect()), key=str)


def sample(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 160, 400, 90)]
    rows = [(1, None), (2, ""), (3, shared[0]), (4, shared[0]), (5, "ab" * 200), (6, "ab" * 90 + text(50)), (7, "x" * 350), (None, shared[3]), (8, text(3000))]
    for i in range(40):
        parts = [text(r.randrange(0, 150)) if r.random() < 0.5 else r.choice(shared)[r.randrange(3) : 1000 - r.randrange(3)] for _ in range(r.randrange(1, 6))]
        rows.append((10 + i, "".join(parts)))
    rows += [(60, rows[12][1]), (0, rows[15][1]), (61, shared[4] + "\x00" + shared[4] + shared[4][1:])]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed)
        assert run(spark, rows) == brute(rows)


def test_without_broadcasts(spark):
    rows = sample(3)
    assert run(spark, rows, most_broadcast=0) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    base = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(90)] = word()
        rows.append((i, " ".join(w)[r.randrange(120) :][: r.randrange(90, 900)]))
    want = brute(rows)
    assert run(spark, rows, most=2) == want and run(spark, rows, most=9, most_broadcast=0) == want
    for name in ("SAMPLED", "HEAVY"):
        monkeypatch.setattr(R, name, 1)
    assert run(spark, rows, most=5) == want and run(spark, sample(1)) == brute(sample(1))


def test_repeated_rows_and_empty_table(spark):
    r = random.Random(5)
    text = "".join(r.choice("abc") for _ in range(300))
    assert run(spark, [(1, text), (1, text)]) == [(1, 300, [], text.encode())] * 2
    assert run(spark, []) == []


def test_rows_without_an_id_of_their_own(spark):
    r = random.Random(9)
    a, b, c, d = ("".join(r.choice("abcdef") for _ in range(600)) for _ in range(4))
    rows = [(1, a[:200]), (None, a), (None, b), (None, c), (None, c)]
    assert run(spark, rows) == sorted([(1, 200, [], a[:200].encode()), (None, 600, [(0, 200)], a[200:].encode()), (None, 600, [], b.encode()), (None, 600, [], c.encode()), (None, 600, [(0, 600)], b"")], key=str)
    # in other surroundings, and in rows that share a doc_id
    rows = [(1, a[:150]), (2, d[:300] + a[:150] + d[300:]), (2, b + c), (2, d[:300] + a[:150] + d[300:]), (3, c), (None, b[50:] + a[20:170]), (None, "x" + b[50:])]
    got = run(spark, rows)
    cut = d[:300] + d[300:]
    assert [x for x in got if x[0] == 2] == sorted([(2, 750, [(300, 450)], cut.encode())] * 2 + [(2, 1200, [], (b + c).encode())], key=str)
    assert [x[3] for x in got if x[0] == 3] == [b""] and sorted(x[3] for x in got if x[0] is None) == sorted([a[150:170].encode(), b"x"])
    assert run(spark, rows, most_broadcast=0) == got


def test_columns_agree_with_comparison():
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 2, (60, R.WIDTH)).astype(np.uint8)
    grid[20:40, 30:150] = grid[10, 30:150]
    left, right, rank = np.full(60, R.LEFT), np.full(60, R.LENGTH), rng.permutation(60)
    left[22], right[25] = 30, 60
    got = R.earlier_windows(grid, left, right, rank)
    for j in range(R.LEFT + 1):
        ok = [i for i in range(60) if j >= R.LEFT - left[i] and j + 100 <= R.LEFT + right[i]]
        for i in range(60):
            want = i in ok and any(rank[k] < rank[i] and (grid[k, j : j + 100] == grid[i, j : j + 100]).all() for k in ok)
            assert got[i, j] == want
