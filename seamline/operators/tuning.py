"""A tuning run of clusterings whose candidates are a table: it narrows in stages, stops early and goes on where it was ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import sample_size
from .selection import _finite

RESULT = "stage string, place int, key string, candidate string, score double, smallest double, seconds double, error string"
METHODS = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}
SCALERS = {"standard": lambda: StandardScaler(withMean=True), "robust": lambda: RobustScaler(withCentering=True), "minmax": MinMaxScaler, "none": None}


def key_of(candidate: dict) -> str:
    """The same for equal settings in any order."""
    return hashlib.sha256(json.dumps(candidate, sort_keys=True).encode()).hexdigest()[:16]


def fine_space(best: list[dict], least: int = 2) -> list[dict]:
    """The settings around the best ones: one cluster fewer and more, and the other methods; each once, the best's own first."""
    found: dict[str, dict] = {}
    for c in best:
        around = [c, *({**c, "clusters": c["clusters"] + d} for d in (-1, 1)), *({**c, "method": m} for m in METHODS)]
        for x in around:
            if x["clusters"] >= least:
                found.setdefault(key_of(x), x)
    return list(found.values())


def sampled(df: DataFrame, features: list[str], id: str, most: int) -> DataFrame:
    """At most ``most`` finite rows as vectors, those with the least hashes of their id, so that stages and restarts see the same rows."""
    good = _finite(df, features).filter(F.col(id).isNotNull())
    rows = good.orderBy(F.xxhash64(F.col(id).cast("string")), F.col(id).cast("string")).limit(most)
    return VectorAssembler(inputCols=features, outputCol="raw").transform(rows.select(*(F.col(f).cast("double").alias(f) for f in features))).select("raw")


def silhouette(rows: DataFrame, candidate: dict, seed: int = 42) -> tuple[float, float]:
    """Mean silhouette of one candidate on ``rows``, and its smallest cluster's share; no value where it finds a single cluster."""
    scaled, made = "raw", rows
    scaler = SCALERS[candidate["scaler"]]
    if scaler:
        made, scaled = scaler().setInputCol("raw").setOutputCol("scaled").fit(made).transform(made), "scaled"
    if candidate.get("projection"):
        made, scaled = PCA(k=int(candidate["projection"]), inputCol=scaled, outputCol="axes").fit(made).transform(made), "axes"
    model = METHODS[candidate["method"]](featuresCol=scaled, k=candidate["clusters"], seed=seed).fit(made)
    told = model.transform(made).persist()
    try:
        sizes = [r["count"] for r in told.groupBy("prediction").count().collect()]
        if len(sizes) < 2:
            return float("nan"), 1.0
        return ClusteringEvaluator(featuresCol=scaled).evaluate(told), min(sizes) / sum(sizes)
    finally:
        told.unpersist()


class Run:
    """The table of a run's results in ``folder``, one small file for each candidate, written when it is done."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = spark.read.schema(RESULT).parquet(folder).collect() if there else []
        self.done = {(r.stage, r.key): r for r in rows}

    def result(self, stage: str, place: int, candidate: dict, judge: Callable[[dict], tuple[float, float]]):
        import time

        at = (stage, key_of(candidate))
        if at not in self.done:
            began, score, smallest, error = time.time(), None, None, None
            try:
                score, smallest = judge(candidate)
                score = None if score != score else float(score)
            except Exception as e:  # a candidate that can't be fitted is a result too
                error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200]
            row = (stage, place, at[1], json.dumps(candidate, sort_keys=True), score, smallest, time.time() - began, error)
            made = self.spark.createDataFrame([row], RESULT)
            made.coalesce(1).write.mode("append").parquet(self.folder)
            self.done[at] = made.first()
        return self.done[at]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.done.values(), key=lambda r: (r.stage, r.place)), RESULT)


def tune(df: DataFrame, features: list[str], id: str, space: list[dict], folder: str, keep: int = 2, patience: int = 6, gain: float = 0.001, least_share: float = 0.0, judge: Callable | None = None) -> DataFrame:
    """Results (RESULT) of a run: stage ``coarse`` tries ``space`` on a small sample, stage ``fine`` the settings around the ``keep`` best on a larger one.

    Samples have ``sample_size`` rows for the most clusters asked for, 1,500 at
    most in the coarse stage and 5,000 in the fine one: silhouettes compare
    samples, which is the method. A stage ends early once ``patience``
    candidates in a row don't beat the best by ``gain``. A result counts only if
    its smallest cluster has ``least_share`` of the rows. Each result is written
    to ``folder`` at once; a run that was killed is started again by the same
    call and fits nothing twice. A candidate that fails has its error and no
    score. Equal scores go by place. Without rows or candidates there are none.
    """
    run, n = Run(df.sparkSession, folder), df.count()

    def stage(name: str, candidates: list[dict], most: int) -> list[dict]:
        if not candidates or not n:
            return []
        rows = sampled(df, features, id, sample_size(n, max(c["clusters"] for c in candidates), most)).persist()
        own = judge or (lambda c: silhouette(rows, c))
        best, since, found = None, 0, []
        try:
            for place, c in enumerate(candidates):
                r = run.result(name, place, c, own)
                if r.score is not None and r.smallest >= least_share:
                    found.append((r.score, -place, c))
                better = bool(found) and found[-1][2] is c and (best is None or r.score > best + gain)
                best, since = (r.score, 0) if better else (best, since + 1)
                if since >= patience:
                    break
        finally:
            rows.unpersist()
        return [c for _, _, c in sorted(found, key=lambda x: x[:2], reverse=True)]

    good = stage("coarse", space, 1500)
    stage("fine", fine_space(good[:keep]), 5000)
    return run.table()
