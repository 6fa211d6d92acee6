"""Feature fronts against all masks, shadow tests on planted features, and tuning runs that are killed."""

import itertools

import numpy as np
import pytest

from seamline.operators import fronts as R
from seamline.operators import tuning as T


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(8)
    y = r.integers(2, size=400)
    x = r.normal(size=(400, 10)) + np.outer(y, [2, 1.5, 1, 0.5, 0.3, 0, 0, 0, 0, 0.1])
    x[:, 4] += x[:, 0]
    names = [f"x{i}" for i in range(10)]
    rows = [(i, *map(float, v), str(t), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(900, *[None] * 10, "1", 1.0), (901, *[1.0] * 10, None, 0.0)]
    return x, y, names, spark.createDataFrame(rows, f"id long, {', '.join(f'{c} double' for c in names)}, label string, y double").repartition(4)


@pytest.mark.parametrize("fewer", [True, False, None])
def test_fronts_by_all_masks(labelled, fewer):
    x, y, names, df = labelled
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def distance(s):
        axes = np.linalg.eigh(np.cov(z[:, s].T, bias=True).reshape(len(s), len(s)))[1][:, ::-1][:, :2]
        return float(np.linalg.norm((z[y == 0][:, s].mean(axis=0) - z[y == 1][:, s].mean(axis=0)) @ axes))

    masks = [list(s) for k in range(1, 11) for s in itertools.combinations(range(10), k)]
    aims = np.array([(distance(s), {True: -len(s), False: len(s), None: 0}[fewer]) for s in masks])
    want = sorted(([names[c] for c in masks[i]] for i in R.fronts_of(aims)[0]), key=lambda s: (len(s), s))
    got = R.feature_fronts(df, names, "label", fewer)
    assert sorted((s for s, _ in got), key=lambda s: (len(s), s)) == want
    assert all(abs(d - distance([names.index(c) for c in s])) < 1e-9 for s, d in got)


def test_fronts_where_tasks_have_no_rows(labelled):
    _, _, names, df = labelled
    few = lambda rows: [(s, round(d, 9)) for s, d in R.feature_fronts(rows, names[:3], "label", generations=3)]
    assert few(df.coalesce(1).repartitionByRange(8, "label")) == few(df)


def test_crowding():
    assert R.crowding(np.array([[0.0, 3.0], [1.0, 2.0], [3.0, 0.0]])).tolist() == [np.inf, 2.0, np.inf]


def test_planted_features_are_kept(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0), (7000, None, 1.0, 1.0, 1.0, 1.0, 0.0)], "id long, a double, b double, c double, d double, e double, y double")
    found = R.shadow_test(df, list("abcde"), "y", "id", rounds=20, trees=20, depth=4)
    assert [(f, v) for f, v, *_ in found][:2] == [("a", "kept"), ("b", "kept")]
    assert all(v != "kept" for _, v, *_ in found[2:]) and [v for _, v, *_ in found[2:]].count("refused") >= 2
    assert R.shadow_test(df.limit(0), ["a"], "y", "id") == [("a", "open", 0, 0)]


def test_a_killed_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 3) * 50 + i % 5, float(i % 3) * 20) for i in range(150)], "id long, a double, b double")
    space = [{"method": "kmeans", "clusters": k, "scaler": "standard", "projection": None} for k in (2, 3, 4)]
    calls = []

    def judge(c, dies_at=None):
        calls.append(c)
        if len(calls) == dies_at:
            raise KeyboardInterrupt
        if c["clusters"] == 4 and c["method"] == "mixture":
            raise ValueError("no fit")
        return 1.0 - abs(c["clusters"] - 3) / 10, 0.3

    folder = str(tmp_path / "run")
    with pytest.raises(KeyboardInterrupt):
        T.tune(df, ["a", "b"], "id", space, folder, judge=lambda c: judge(c, 5))
    before = len(calls) - 1
    table = T.tune(df, ["a", "b"], "id", space, folder, keep=1, judge=judge).collect()
    tried = [(r.stage, r.key) for r in table]
    assert len(set(tried)) == len(tried) and len(calls) - 1 == len(tried) and before == 4
    assert [r.score for r in table if r.stage == "coarse"] == [0.9, 1.0, 0.9]
    assert T.tune(df, ["a", "b"], "id", space, folder, keep=1, judge=judge).count() == len(table) == len(calls) - 1
    assert T.tune(df, ["a", "b"], "id", space, str(tmp_path / "early"), keep=1, patience=1, judge=judge).filter("stage = 'coarse'").count() == 3
    assert T.tune(df.limit(0), ["a", "b"], "id", space, str(tmp_path / "none")).count() == 0


def test_three_groups_are_found(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 3) * 50 + i % 5, float(i % 3) ** 2 * 20) for i in range(150)] + [(None, 1.0, 1.0), (999, None, 1.0)], "id long, a double, b double")
    space = [{"method": "kmeans", "clusters": k, "scaler": "standard", "projection": None} for k in (2, 3)]
    table = T.tune(df, ["a", "b"], "id", space, str(tmp_path / "run"), keep=1, patience=1)
    best = max((r for r in table.collect() if r.score is not None), key=lambda r: r.score)
    assert '"clusters": 3' in best.candidate and best.score > 0.8 and abs(best.smallest - 1 / 3) < 0.01
