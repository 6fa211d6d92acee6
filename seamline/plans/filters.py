"""Queries that filter traces and transform profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signal import DB4
from ..operators import filters as K
from .common import SAMPLES, rounded, traces


def _samples(df, name, digits=5):
    return df.select("vec_id", F.posexplode("a").alias("i", "x")).select("vec_id", "i", rounded("x", digits).alias(name))


def denoise(spark, sf_dir):
    t = traces(spark, sf_dir)
    return _samples(t.select("vec_id", K.denoised(F.col("a"), levels=1).alias("a")), "x")


def denoise_all(spark, sf_dir):
    t = traces(spark, sf_dir)
    return _samples(t.select("vec_id", K.denoised(F.col("a"), soft=False).alias("a")), "x")


def zero_phase(spark, sf_dir):
    t = traces(spark, sf_dir)
    return _samples(t.select("vec_id", K.zero_phase(F.col("a"), 3, 0.2).alias("a")), "x")


def _both(spark, sf_dir, kind):
    return K.transformed(traces(spark, sf_dir), ["label"], "vec_id", kind, "a")


def cosine(spark, sf_dir):
    return _both(spark, sf_dir, "cosine").select("label", "vec_id", F.posexplode("re").alias("k", "x")).select("label", "vec_id", "k", rounded("x", 4).alias("x"))


def spectrum(spark, sf_dir):
    size = F.zip_with("re", "im", lambda x, y: F.sqrt(x * x + y * y))
    return _both(spark, sf_dir, "fourier").select("label", "vec_id", F.posexplode(size).alias("k", "x")).select("label", "vec_id", "k", rounded("x", 4).alias("x"))


def attenuated(spark, sf_dir):
    """Profiles without their upper half of frequencies along samples, put together again."""
    z = _both(spark, sf_dir, "fourier")
    low = lambda c: F.transform(c, lambda x, k: F.when(k <= 16, x).otherwise(0.0))
    back = K.transformed(z.select("label", "vec_id", low(F.col("re")).alias("re"), low(F.col("im")).alias("im")), ["label"], "vec_id", "fourier_back", "re", "im", samples=64)
    return _samples(back.withColumnRenamed("re", "a"), "x", 4)


_DB4 = f"[{', '.join(f'{x}::double' for x in DB4)}]"
_PROFILE = f"with {SAMPLES}, pl as (select vec_id, row_number() over (partition by label order by vec_id) - 1 as r, count(*) over (partition by label) as m from t)"

QUERIES = {
    "trace_denoise": (denoise, f"""with {SAMPLES}, f as (select i as j, lo[i + 1] as lo, case when i % 2 = 1 then lo[8 - i] else -lo[8 - i] end as hi from (select {_DB4} as lo), (select unnest(range(0, 8)) as i)),
        c as (select t.vec_id, k, sum(lo * a[1 + case when q < 0 then -1 - q when q >= 64 then 127 - q else q end]) as c, sum(hi * a[1 + case when q < 0 then -1 - q when q >= 64 then 127 - q else q end]) as d
          from t, (select k, j, 2 * k + 1 - j as q, lo, hi from f, (select unnest(range(0, 35)) as k)) group by 1, 2),
        s as (select vec_id, median(abs(d)) / 0.6745 * sqrt(2 * ln(35)) as t from c group by 1), u as (select vec_id, k, c, sign(d) * greatest(abs(d) - t, 0) as d from c join s using (vec_id))
        select vec_id, cast(i as int) as i, round(sum(c * lo + d * hi), 5) as x from u, (select unnest(range(0, 64)) as i), f where j = 7 - (i + 6 - 2 * k) group by 1, 2"""),
    "trace_denoise_levels": (denoise_all, None),
    "trace_zero_phase": (zero_phase, None),
    "profile_cosine": (cosine, f"""{_PROFILE}, s as (select vec_id, label, k, sum(x * cos(pi() * (i + 0.5) * k / 64)) * case when k = 0 then sqrt(1 / 64.0::double) else sqrt(2 / 64.0::double) end as c from p, (select unnest(range(0, 64)) as k) group by vec_id, label, k)
        select s.label, v.vec_id, cast(k as int) as k, round(sum(c * cos(pi() * (w.r + 0.5) * v.r / v.m)) * case when v.r = 0 then sqrt(1.0 / v.m) else sqrt(2.0 / v.m) end, 4) as x
        from s join pl w on w.vec_id = s.vec_id join t on t.label = s.label join pl v on v.vec_id = t.vec_id group by s.label, v.vec_id, k, v.r, v.m"""),
    "profile_spectrum": (spectrum, f"""{_PROFILE}, s as (select vec_id, label, k, sum(x * cos(2 * pi() * i * k / 64)) as re, -sum(x * sin(2 * pi() * i * k / 64)) as im from p, (select unnest(range(0, 33)) as k) group by all),
        z as (select s.label, v.vec_id, k, 2 * pi() * ((w.r * v.r) % v.m) / v.m as g, re, im from s join pl w on w.vec_id = s.vec_id join t on t.label = s.label join pl v on v.vec_id = t.vec_id)
        select label, vec_id, cast(k as int) as k, round(sqrt(power(sum(re * cos(g) + im * sin(g)), 2) + power(sum(im * cos(g) - re * sin(g)), 2)), 4) as x from z group by 1, 2, 3"""),
    "profile_attenuated": (attenuated, f"""with {SAMPLES}, s as (select vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) as re, -sum(x * sin(2 * pi() * i * k / 64)) as im from p, (select unnest(range(0, 17)) as k) group by all)
        select vec_id, cast(i as int) as i, round(sum((re * cos(2 * pi() * i * k / 64) - im * sin(2 * pi() * i * k / 64)) * case when k = 0 then 1 else 2 end) / 64, 4) as x from s, (select unnest(range(0, 64)) as i) group by 1, 2"""),
}
