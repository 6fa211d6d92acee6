from collections import Counter, defaultdict

from seamline.llm import lines as L


def brute(rows, ratio, more):
    total, on = Counter(), defaultdict(set)
    for k, (_, host, text) in enumerate(rows):
        host = host or ""
        total[host] += 1
        for x in (text or "").split("\n") if text is not None else []:
            if x.strip(" ").strip(" \t\n\x0b\x0c\r"):
                on[host, x.strip(" ")].add(k)
    bad = {key for key, pages in on.items() if len(pages) - 1 > ratio * (total[key[0]] + more)}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if ((h or ""), x.strip(" ")) not in bad)) for d, h, t in rows]


def test_against_brute_force(spark):
    rows = [(i, "a" if i % 3 else None, "\n".join(["menu ", f"body {i}", " menu", "", f"half {i % 2}", "\t"])) for i in range(30)]
    rows += [(100, "a", None), (101, "b", ""), (102, "b", "menu"), (103, None, "x\r\ny"), (None, "a", "menu\nlast"), (0, None, "menu\nagain"), (104, "a", "menu"), (105, "b", "menu\n" + "very long " * 30_000 + "\n" * 999)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, n_lines int, row string")
    for broadcast in (0, 1000):
        got = L.drop_boilerplate(df, ratio=0.6, more_pages=1, most_broadcast=broadcast)
        assert [*got.columns, *got.select("row.*").columns] == ["row", "text", "n_lines", "n_dropped", *df.columns]
        assert sorted(((r.row.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, 0.6, 1), key=str)
    whole = {r.row.doc_id: r.text for r in L.drop_boilerplate(df, ratio=0.6, more_pages=1).collect()}
    assert whole[104] == "" and whole[100] is None


def test_empty_table(spark):
    assert L.drop_boilerplate(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_small_hosts(spark):
    """A shared line goes also on hosts of three and four pages; two pages and a page's own lines stay."""
    rows = [(10 * n + k, f"h{n}", f"own {n} {k}\nmenu") for n in range(1, 8) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.row.doc_id: r.text for r in L.drop_boilerplate(df).collect()}
    assert got == {d: t if s in ("h1", "h2") else t.split("\n")[0] for d, s, t in rows}
