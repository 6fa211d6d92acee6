"""The trie and its totals equal those of a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

from seamline.llm import prefix_trie as T


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :] for c, v in own.items()}
    nodes = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].add(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, members in nodes.items():
        below, leaves, saved = [k], 0, 0
        while below:
            x = below.pop()
            leaves += not children[x]
            saved += (len(nodes[x]) - 1) * len(x[-1][1]) if x else 0
            below += children[x]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth long")
    got = T.prefix_trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_random_conversations(spark):
    r = random.Random(7)
    rows = []
    for c in [*range(40), *range(100, 130), *range(250, 290), -5, -100]:
        for t in range(r.choice([1, 2, 3, 5, 6, 7, 8, 9])):
            rows.append((c, t if r.random() < 0.97 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ccc😀"])))
    rows += [(None, 1, "user", "lost"), rows[0], rows[0], (500, 3, "user", "é" * 50_000)]
    assert found(spark, rows) == plain(rows)


def test_copies_and_a_ladder(spark, monkeypatch):
    """Many copies end in one node over several blocks; conversations that each go on where another ends make a long way to peel."""
    monkeypatch.setattr(T, "BLOCK", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(7)]
    rows += [(2000 + k, t, "user", f"step {t}") for k in range(9) for t in range(6 + k)]
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
